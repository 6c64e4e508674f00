"""Language-model scores of a hierarchical Pitman-Yor model, learned from the whole corpus.

Every word has a restaurant of the words that follow it (``order`` 2, see ``word_pairs``); all of them share
the words' own restaurant as parent. Whenever a word opens a table there, it is spelled by a hierarchy
of byte restaurants, in which the context of three bytes backs off to two, to one, to none, and at last to a
uniform choice. Contexts with the same suffix share a parent. Older bytes of a context are kept as
residues, which fixes the number of byte restaurants (``SLOTS``) whatever the corpus holds; those of words
grow with it. The end of a text is the empty word. So every string of bytes has a probability, known or
not: ``log10_prob`` is the text's, and the perplexity follows it. ``score`` takes all words that training
never saw as one outcome, like the base score, whose probability is what the model leaves to them together.

Seating is sampled by Gibbs sweeps: given the tables of everything else, all tables of each dish are
drawn anew, customer by customer (in blocks of a sixteenth once 64 sit), and the tables of the words
become the customers of the spelling restaurants. Predictive probabilities are averaged over the
sweeps after burn-in. Contexts are seated between two such rounds: the first, on plain counts, gives the
probabilities they start from; the second has their tables as customers.

Counts never meet the driver. The corpus is read once, into blocks: a block's own vocabulary with its
counts, and its documents as numbers of that vocabulary. Words are merged over one shuffle, and each
block gets back its own words' counts and probabilities; neither texts nor occurrences are shuffled by
word, so a word that fills a third of the corpus is one row for each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.storage import bounded_batches, drop_path, free_shuffles, new_path, partitions

from . import word_pairs
from .langid import fold
from .seating import STRENGTH, discount_of, pack, pack_planes, seat, unpack, unpack_planes

#: Bytes of text in a block; the restaurants of one, two and three bytes of context.
BLOCK_BYTES = 12 << 20
TWO, THREE = 32, 4
SLOTS = 256 * TWO * THREE
SWEEPS, BURN_IN, SEED = 4, 2, 11
#: Fixed values of the base score.
ADD, FOLDS = 0.1, 10
_SPACE = 32
#: Bytes as words have them: A-Z in lower case, white space as a space.
_FOLDED = bytes(_SPACE if 9 <= b <= 13 else b for b in bytes(range(256)).lower())
_CHUNK = 8192
_IDX_BITS = 24


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, starts): restaurant and byte of every step of every word, its end (a space) included."""
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    one = np.concatenate(([_SPACE], data[:-1]))
    two = np.where(one == _SPACE, _SPACE, np.concatenate(([_SPACE], one[:-1])))
    three = np.where(two == _SPACE, _SPACE, np.concatenate(([_SPACE], two[:-1])))
    return ((one * TWO + two % TWO) * THREE + three % THREE) * 256 + data, starts


class Spelling:
    """The byte restaurants. Levels from none to three bytes of context; arrays are (restaurants, 256).

    A sweep's state is what its seating says of each level: which dishes are served, their own share,
    and what each restaurant leaves to its parent. Tasks get states, which are small, and rebuild the
    dense predictive probabilities from them.
    """

    sizes = (1, 256, 256 * TWO, SLOTS)
    above = (None, 256, TWO, THREE)

    def __init__(self):
        self.predict = self.predictions([])
        self.tables = [np.zeros(n) for n in self.sizes]
        self.state, self.kept = [], []

    @classmethod
    def predictions(cls, state: list) -> list[np.ndarray]:
        out = []
        for level, size in enumerate(cls.sizes):
            above = np.repeat(out[-1], cls.above[level], axis=0) if level else np.full((1, 256), 1 / 256, np.float32)
            if state:
                keys, own, back = state[level]
                above = above * back[:, None]
                above.reshape(-1)[keys] += own
            out.append(above)
        return out

    @classmethod
    def log10(cls, states: list) -> np.ndarray:
        """Logarithms of the longest contexts' predictive probabilities, averaged over the states."""
        table = cls.predictions(states[0] if states else [])[3]
        for state in states[1:]:
            table = table + cls.predictions(state)[3]
        return np.log10(table / max(1, len(states))).reshape(-1)

    def sweep(self, keys: np.ndarray, counts: np.ndarray, seed: int, keep: bool) -> None:
        """Draw all tables anew, from the longest context to none, then renew the predictive probabilities."""
        state = []
        for level in (3, 2, 1, 0):
            room, byte = keys >> 8, keys & 255
            parent = self.predict[level - 1][room // self.above[level], byte] if level else np.full(len(keys), 1 / 256)
            d = discount_of(int((counts == 1).sum()), int((counts == 2).sum()))
            base = (STRENGTH + d * self.tables[level][room]) * parent
            seeds = keys.astype(np.uint64) * np.uint64(4) + np.uint64(level) + np.uint64(seed << 40)
            tables = seat(counts, base, d, seeds)
            self.tables[level] = np.bincount(room, tables, minlength=self.sizes[level])
            total = STRENGTH + np.bincount(room, counts, minlength=self.sizes[level])
            back = (STRENGTH + d * self.tables[level]) / total
            state.append((keys.astype(np.int32), ((counts - d * tables) / total[room]).astype(np.float32), back.astype(np.float32)))
            if level:
                opened = np.bincount((room // self.above[level]) << 8 | byte, tables)
                keys = np.flatnonzero(opened)
                counts = np.rint(opened[keys]).astype(np.int64)
        self.state = state[::-1]
        self.predict = self.predictions(self.state)
        if keep:
            self.kept.append(self.state)


#: The table that a process rebuilt last, by the name of the states it came from.
_REBUILT: dict[str, np.ndarray] = {}


def _table(named_states: tuple[str, list]) -> np.ndarray:
    name, states = named_states
    if name not in _REBUILT:
        _REBUILT.clear()
        _REBUILT[name] = Spelling.log10(states)
    return _REBUILT[name]


def _words_of(texts: pa.LargeBinaryArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, lower-cased and numbered by first occurrence, and how many each text has."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if offsets[-1] > offsets[0] else b""
    offsets = offsets - offsets[0]
    data = np.frombuffer(data.translate(_FOLDED), np.uint8)
    inside = data != _SPACE
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    fresh[begins] = inside[begins]
    ends = np.append(np.flatnonzero(fresh[inside]), np.count_nonzero(inside))
    lengths = np.diff(np.searchsorted(np.flatnonzero(fresh), offsets))
    data = data[inside]
    del inside, fresh
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64, copy=False)), pa.py_buffer(data)])
    return words.dictionary_encode(), lengths


def _blocks(kind: pa.DataType, block_bytes: int):
    names = ["kind", "word", "pos", "cnt", "ids", "held", "lengths", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, held, texts, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            block = (part << 17) + number
            joined = pa.concat_arrays(texts)
            texts.clear()
            words, lengths = _words_of(joined)
            del joined
            every, n = words.indices.to_numpy(), len(words.dictionary)
            counts = np.bincount(every[np.repeat(~np.array(held, bool), lengths)], minlength=n).astype(np.int64)
            empty = lambda k, m: pa.nulls(m, k)
            lists = [pa.list_(kind), pa.list_(pa.bool_()), pa.list_(pa.int64())]
            for at in range(0, n, 50_000):
                m = min(50_000, n - at)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), words.dictionary.slice(at, m).cast(pa.binary()), pa.array((block << _IDX_BITS) + np.arange(at, at + m)), pa.array(counts[at : at + m]), *[empty(k, m) for k in lists], empty(pa.binary(), m), empty(pa.binary(), m)], names)
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), empty(pa.binary(), 1), pa.array([block << _IDX_BITS]), pa.array([n]), pa.array([ids], lists[0]), pa.array([held], lists[1]), pa.array([lengths], lists[2]), pa.array([pack((every & 0xFFFF).astype("<u2"))], pa.binary()), pa.array([pack((every >> 16).astype("<u2"))], pa.binary())], names)
            number, size = number + 1, 0
            ids.clear()
            held.clear()
            pa.default_memory_pool().release_unused()

        for batch in batches:
            column = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            ends, at = np.concatenate(([0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64))), 0
            while at < batch.num_rows:
                # up to the row that fills the block
                to = min(int(np.searchsorted(ends[1:], ends[at] + block_bytes - size)) + 1, batch.num_rows)
                ids += batch.column(0).slice(at, to - at).to_pylist()
                held += batch.column(2).slice(at, to - at).to_pylist()
                texts.append(column.slice(at, to - at))
                size, at = size + int(ends[to] - ends[at]), to
                if size >= block_bytes:
                    yield from flush()
        if ids:
            yield from flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by word to a row for each word: its count, and where the blocks keep it (in rows of up to ``_CHUNK``)."""

    def out(words, numbers, counts, firsts, lists) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([words, pa.array(numbers, pa.int64()), pa.array(counts, pa.int64()), pa.array(firsts, pa.bool_()), lists], ["word", "g", "c", "first", "places"])

    open_word, open_count, open_places = None, 0, []
    number = (TaskContext.get().partitionId() << 32) + 1

    def closed() -> Iterator[pa.RecordBatch]:
        if open_word is not None:
            places = np.concatenate(open_places)
            for at in range(0, len(places), _CHUNK):
                yield out(pa.array([open_word], pa.binary()), [number], [open_count], [at == 0], pa.array([places[at : at + _CHUNK]], pa.list_(pa.int64())))

    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column(0))
        ends = np.asarray(runs.run_ends)
        starts = np.concatenate(([0], ends[:-1]))
        places, counts = batch.column(1).to_numpy(), np.add.reduceat(batch.column(2).to_numpy(), starts)
        first, last = runs.values[0].as_py(), len(ends) - 1
        if first == open_word:
            open_count += int(counts[0])
            open_places.append(places[: ends[0]])
            done = 1
        else:
            done = 0
        if last >= done:  # the open word has ended; the batch's last one stays open
            if open_word is not None:
                yield from closed()
                number += 1
            if last > done:
                offsets = np.concatenate((starts[done:last], [ends[last - 1]])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(places[offsets[0] : offsets[-1]]))
                yield out(runs.values.slice(done, last - done), np.arange(number, number + last - done), counts[done:last], np.ones(last - done, bool), lists)
                number += last - done
            open_word, open_count, open_places = runs.values[last].as_py(), int(counts[last]), [places[starts[last] :]]
    yield from closed()


def _regrouped(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _word_seed(logp: np.ndarray, counts: np.ndarray, sweep: int) -> np.ndarray:
    return logp.view(np.uint64) ^ (counts.astype(np.uint64) << np.uint64(8)) ^ np.uint64(sweep << 3 | 1)


def _spelled_as(words: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and starts of the words' steps, and the words' log10 probabilities."""
    keys, starts = spelled(words)
    return keys, starts, np.add.reduceat(table[keys].astype(np.float64), starts)


def _tables(logp: np.ndarray, counts: np.ndarray, mass: float, discount: float, sweep: int) -> np.ndarray:
    return seat(counts, mass * 10.0**logp, discount, _word_seed(logp, counts, sweep))


def _sweep_words(table, mass: float, discount: float, sweep: int):
    """Tables of each word; the steps of their spellings, summed in the task. Key -1 has the tables in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, opened = None, 0.0
        for part in _regrouped(batches):
            words, counts = part.column("word").to_pylist(), part.column("c").to_numpy()
            keys, starts, logp = _spelled_as(words, _table(table.value))
            tables = _tables(logp, counts, mass, discount, sweep)
            total = np.zeros(SLOTS * 256) if total is None else total
            np.add.at(total, keys, np.repeat(tables, np.diff(np.append(starts, len(keys)))))
            opened += tables.sum()
        if total is not None:
            keys = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, -1)), pa.array(np.append(total[keys], opened))], ["k", "n"])

    return run


def _sum_words(table, mass: float, discount: float, sweeps: list[int]):
    """Tables of all words in each of the sweeps (its place is the key), and their spelling probability (key -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(sweeps) + 1)
        for part in _regrouped(batches):
            counts = part.column("c").to_numpy()
            logp = _spelled_as(part.column("word").to_pylist(), _table(table.value))[2]
            sums += [*[_tables(logp, counts, mass, discount, sweep).sum() for sweep in sweeps], (10.0**logp).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(sweeps)), -1], pa.int64()), pa.array(sums)], ["k", "n"])

    return run


def _values(table, drawn: float, mass: float, total: float, discount: float, sweeps: list[int]):
    """For each task and block: places, log10 probabilities, occurrences (``seen``) and numbers of the words that the block keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _regrouped(batches, 200_000):
            words, counts = part.column("word").to_pylist(), part.column("c").to_numpy()
            logp = _spelled_as(words, _table(table.value))[2]
            mean = sum(_tables(logp, counts, drawn, discount, sweep) / len(sweeps) for sweep in sweeps)
            unseen = np.log10(mass / (STRENGTH + total)) + logp  # a sum of logarithms, which no length underflows
            value = np.where(counts > 0, np.log10(np.maximum(counts - discount * mean, 0) / (STRENGTH + total) + 10.0**unseen + 1e-320), unseen)
            lists = part.column("places").combine_chunks()
            places = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(words)), np.diff(lists.offsets.to_numpy()))
            order = np.argsort(places, kind="stable")
            places, owner = places[order], owner[order]
            block = places >> _IDX_BITS
            cut = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
            spans = [(a, b) for a, b in zip(cut[:-1], cut[1:]) if b > a]
            idx, seen, numbers, value = (places & ((1 << _IDX_BITS) - 1)).astype("<u4"), part.column("seen").to_numpy(), part.column("g").to_numpy(), value.astype("<f4")
            columns = lambda a, b: [pack(idx[a:b]), pack(value[owner[a:b]])] + [pack_planes(x[owner[a:b]]) for x in (seen, numbers)]
            yield pa.RecordBatch.from_arrays([pa.array([int(block[a]) for a, _ in spans], pa.int64()), pa.array([columns(a, b) for a, b in spans], pa.list_(pa.binary()))], ["block", "data"])

    return run


def _by_block(batches: Iterator[pa.RecordBatch], documents: int) -> Iterator[tuple[dict, list[list[bytes]], list[list[bytes]]]]:
    """(the row of kind ``documents``, its rows of kind 0, those of kind 1) for each block of rows sorted by block and kind."""
    words, replies = [], []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            if row["kind"] == documents:
                yield row, words, replies
                words, replies = [], []
            else:
                (words if row["kind"] == 0 else replies).append(row["data"])


def _codes(low: bytes, high: bytes) -> np.ndarray:
    return unpack(low, "<u2").astype(np.int64) | unpack(high, "<u2").astype(np.int64) << 16


def _of_words(n: int, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log10 probabilities, counts and numbers of a block's words."""
    values, counts, numbers = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for data in words:
        at = unpack(data[0], "<u4")
        values[at] = unpack(data[1], "<f4")
        counts[at], numbers[at] = unpack_planes(data[2]), unpack_planes(data[3])
    return values, counts, numbers


def _by_doc(codes: np.ndarray, lengths: np.ndarray, of_word: np.ndarray, end: float) -> np.ndarray:
    """Sums over each text's words, and its end."""
    out, full, starts = np.full(len(lengths), end, np.float64), np.flatnonzero(lengths), np.concatenate(([0], np.cumsum(lengths)[:-1]))
    if len(full):
        out[full] += np.add.reduceat(of_word[codes].astype(np.float64), starts[full])
    return out


def _base_of(counts, total: int, distinct: int):
    return np.log10((counts + ADD) / (total + ADD * (distinct + 1)))


_OUT = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "log10_prob"]


def _score(total: int, distinct: int, end_count: int, end_value: float, unknown: float, kind: pa.DataType):
    """Scores of a block's texts where words have no contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words, _ in _by_block(batches, 2):
            values, counts, _ = _of_words(row["cnt"], words)
            codes, lengths = _codes(row["low"], row["high"]), np.array(row["lengths"], np.int64)
            known = _by_doc(codes, lengths, counts > 0, end_count > 0).astype(np.int64)
            base = _by_doc(codes, lengths, _base_of(counts, total, distinct), _base_of(end_count, total, distinct))
            closed = _by_doc(codes, lengths, np.where(counts > 0, values, unknown), end_value if end_count else unknown)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], kind), pa.array(row["held"]), pa.array(lengths + 1), pa.array(known), pa.array(np.full(len(lengths), total)), pa.array(base), pa.array(closed), pa.array(_by_doc(codes, lengths, values, end_value))], _OUT)

    return run


def _pair_up(end_count: int, end_value: float, parts: int, hot: int):
    """A block's pairs, a row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words, _ in _by_block(batches, 2):
            values, counts, numbers = _of_words(row["cnt"], words)
            values, counts, numbers = np.append(values, end_value), np.append(counts, end_count), np.append(numbers, 0)
            lengths, held, block = np.array(row["lengths"], np.int64), np.array(row["held"]), row["block"]
            pairs = word_pairs.BlockPairs(_codes(row["low"], row["high"]), lengths, numbers, counts, parts, hot)
            del row, words
            for part, data in pairs.sent(np.repeat(~held, lengths + 1), numbers, counts, values):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([data], pa.list_(pa.binary()))], ["part", "block", "data"])

    return run


def _score_pairs(total: int, distinct: int, end_count: int, end_value: float, unknown: float, parts: int, hot: int, shared, kind: pa.DataType):
    """Scores of a block's texts from its words (kind 0), what its pairs keep (kind 1) and its texts (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words, replies in _by_block(batches, 2):
            values, counts, numbers = _of_words(row["cnt"], words)
            codes, lengths = _codes(row["low"], row["high"]), np.array(row["lengths"], np.int64)
            known = _by_doc(codes, lengths, counts > 0, end_count > 0).astype(np.int64)
            base = _by_doc(codes, lengths, _base_of(counts, total, distinct), _base_of(end_count, total, distinct))
            values, counts, numbers = np.append(values, end_value), np.append(counts, end_count), np.append(numbers, 0)
            pairs = word_pairs.BlockPairs(codes, lengths, numbers, counts, parts, hot)
            del codes
            left = np.concatenate([unpack(x[0], "<f4") for x in replies]).astype(np.float64)
            given = np.zeros(len(numbers))
            given[pairs.u[pairs.run]] = np.concatenate([unpack(x[1], "<f8") for x in replies])
            keys, sums = shared.value
            split = np.flatnonzero(pairs.split > 1)
            given[split] = sums[np.searchsorted(keys, numbers[split])] if len(split) else 0
            held = STRENGTH + counts[pairs.u]
            back = np.log10((STRENGTH + given[pairs.u]) / held)
            own = left / held

            def by_doc(of_word: np.ndarray) -> np.ndarray:
                below = back + of_word[pairs.w]
                each = np.where(own > 0, np.log10(own + 10.0**below + 1e-320), below)
                return np.add.reduceat(each[pairs.step], pairs.starts)

            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], kind), pa.array(row["held"]), pa.array(lengths + 1), pa.array(known), pa.array(np.full(len(lengths), total)), pa.array(base), pa.array(by_doc(np.where(counts > 0, values, unknown))), pa.array(by_doc(values))], _OUT)

    return run


@dataclass
class Learned:
    """What tasks need to find the words' probabilities: spelling states (broadcast), and the words' restaurant as last drawn."""

    shared: Broadcast
    drawn: float
    mass: float
    total: int
    distinct: int
    discount: float
    last: list[int]
    unknown: float
    end_value: float

    def values(self, words: DataFrame, seen: str = "c") -> DataFrame:
        of = _values(self.shared, self.drawn, self.mass, self.total, self.discount, self.last)
        return words.select("word", "g", "c", F.col(seen).alias("seen"), "places").mapInArrow(of, "block bigint, data array<binary>")


def _learn(known: DataFrame, ends: int, sweeps: int, burn_in: int, seed: int) -> Learned:
    """Seat the customers ``c`` of the words, and ``ends`` of the end, with the spelling below them."""
    spark = known.sparkSession
    facts = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("ones"), F.count_if(F.col("c") == 2).alias("twos")).first()
    total, distinct = facts["n"] + ends, facts["v"] + (ends > 0)
    discount = discount_of(facts["ones"], facts["twos"])

    spelling, opened = Spelling(), float(distinct)
    end_key = ((_SPACE * TWO + _SPACE % TWO) * THREE + _SPACE % THREE) * 256 + _SPACE

    def one_sweep(sweep: int, states: list, mass: float):
        named = (uuid.uuid4().hex, states)
        shared = spark.sparkContext.broadcast(named)
        rows = known.mapInArrow(_sweep_words(shared, mass, discount, sweep), "k bigint, n double").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
        shared.destroy()
        step, count = rows["k"].to_numpy(np.int64), rows["n"].to_numpy(np.float64)
        logp = _spelled_as([b""], _table(named))[2]
        at_end = float(_tables(logp, np.array([ends]), mass, discount, sweep)[0])
        tables = float(count[step == -1].sum()) + at_end
        count, step = count[step >= 0], step[step >= 0]
        total_steps = np.bincount(np.append(step, end_key), np.append(count, at_end))
        keys = np.flatnonzero(total_steps)
        return keys, np.rint(total_steps[keys]).astype(np.int64), tables

    for sweep in range(sweeps if total else 0):
        keys, counts, opened = one_sweep(seed + sweep, [spelling.state], STRENGTH + discount * opened)
        spelling.sweep(keys, counts, seed + sweep, False)
        spelling.sweep(keys, counts, seed + sweep + 1000, sweep >= burn_in)
    named = (uuid.uuid4().hex, spelling.kept or [spelling.state])
    shared = spark.sparkContext.broadcast(named)
    # the seats of these last sweeps are drawn again for the values, so that their sums make the probabilities add up to one
    last, drawn = [seed + sweeps, seed + sweeps + 1], STRENGTH + discount * opened
    end_logp = _spelled_as([b""], _table(named))[2]
    end_seats = float(np.mean([_tables(end_logp, np.array([ends]), drawn, discount, sweep)[0] for sweep in last]))
    held = 0.0
    if total:
        sums = {r["k"]: r["n"] for r in known.mapInArrow(_sum_words(shared, drawn, discount, last), "k bigint, n double").groupBy("k").agg(F.sum("n").alias("n")).collect()}
        opened = sum(sums.get(i, 0.0) for i in range(len(last))) / len(last) + end_seats
        held = sums.get(-1, 0.0) + float(10.0 ** end_logp[0]) * (ends > 0)
    mass = STRENGTH + discount * opened if total else STRENGTH
    # what all words outside training have together; one, without training
    unknown = float(np.log10(mass / (STRENGTH + total) * max(1.0 - held, 1e-12)))
    end_value = float(np.log10(max(ends - discount * end_seats, 0) / (STRENGTH + total) + mass / (STRENGTH + total) * 10.0 ** end_logp[0]))

    return Learned(shared, drawn, mass, total, distinct, discount, last, unknown, end_value)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = SEED, order: int = 1, part: int = word_pairs.PART, hot: int = word_pairs.HOT) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, log10_prob, perplexity``.

    With ``order`` 2 a word's probability depends on the word before it; with 1, the default, on nothing.
    Learned from the rows outside fold 0 of 10, all of them and whole. A null or empty text is its end
    token alone. Null ids fall into the fold of the empty text. Without training rows the model is
    the uniform spelling. Repeated rows get equal scores; an empty table gives an empty result;
    further columns are not read. Very long texts are blocks of their own.
    """
    if order not in (1, 2):
        raise ValueError("order is 1 or 2")
    spark = docs.sparkSession
    bounded_batches(spark)
    n, kind_name = partitions(spark), docs.select(id_col).schema[0].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), (fold(id_col, FOLDS) == 0).alias("out"))
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(read.schema["id"].dataType)

    def written(df: DataFrame, label: str, *apart: str) -> tuple[DataFrame, str]:
        path = new_path(spark, label)
        df.write.option("compression", "zstd").partitionBy(*apart).parquet(path)
        free_shuffles(spark)  # of the plan that was written
        return spark.read.schema(df.schema).parquet(path), path

    blocks, blocks_path = written(read.mapInArrow(_blocks(kind, block_bytes), f"kind int, word binary, pos bigint, cnt bigint, ids array<{kind_name}>, held array<boolean>, lengths array<bigint>, low binary, high binary"), "blocks", "kind")
    words, words_path = written(blocks.filter("kind = 0").select("word", "pos", "cnt").repartition(n, "word").sortWithinPartitions("word").mapInArrow(_merge, "word binary, g bigint, c bigint, first boolean, places array<bigint>"), "words")
    drop_path(spark, f"{blocks_path}/kind=0")
    ends = blocks.filter("kind = 1").agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0)).alias("n")).first()["n"]
    learned = _learn(words.filter("first and c > 0").select("word", "c"), ends, sweeps, burn_in, seed)
    total = learned.total

    none = lambda k, name: F.lit(None).cast(k).alias(name)
    texts = {"cnt": "bigint", "ids": f"array<{kind_name}>", "held": "array<boolean>", "lengths": "array<bigint>", "low": "binary", "high": "binary"}

    def dealt(sides: DataFrame, *columns: str) -> DataFrame:
        """The texts of each block, in ``columns``, after what was found for it (kind, part, data)."""
        coded = blocks.filter("kind = 1").select(F.shiftright("pos", _IDX_BITS).alias("block"), F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("part"), none("array<binary>", "data"), *columns)
        return sides.select("block", "kind", "part", "data", *[none(texts[c], c) for c in columns]).union(coded).repartition(n, "block").sortWithinPartitions("block", "kind", "part")

    def of_words(learned: Learned, words: DataFrame, seen: str = "c") -> DataFrame:
        return learned.values(words, seen).select("block", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("part"), "data")

    out = f"id {kind_name}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, log10_prob double"
    if order == 1:
        found = dealt(of_words(learned, words), *texts).mapInArrow(_score(total, learned.distinct, ends, learned.end_value, learned.unknown, kind), out)
    else:
        distinct, parts, hot = learned.distinct, max(1, total // part), max(hot, total >> word_pairs.HOT_BITS)
        # pairs go from blocks to parts without being written, and texts stay in their blocks until they are scored
        pairs = dealt(of_words(learned, words), "cnt", "held", "lengths", "low", "high").mapInArrow(_pair_up(ends, learned.end_value, parts, hot), word_pairs.SENT)
        seated, _ = written(pairs.repartition(n, "part").sortWithinPartitions("part", "block").mapInArrow(word_pairs.seat_pairs, word_pairs.SEATED), "seated")
        learned.shared.destroy()
        served = seated.filter("kind = 2").groupBy("k").agg(F.sum("n").cast("bigint").alias("n"))
        # the customers of the words' restaurant are the tables of the contexts; a word that occurs once has one
        several = words.filter("c > 1").join(served, F.col("g") == F.col("k")).select("word", "g", F.col("n").alias("c"), "first", "places", F.col("c").alias("seen"))
        words, _ = written(words.filter("c <= 1").withColumn("seen", F.col("c")).union(several), "served")
        drop_path(spark, words_path)
        at_end = seated.filter("kind = 2 and k = 0").agg(F.coalesce(F.sum("n"), F.lit(0.0)).cast("bigint").alias("n")).first()["n"]
        learned = _learn(words.filter("first and c > 0").select("word", "c"), min(ends, 1) if ends < 2 else at_end, sweeps, burn_in, seed + 100)
        # at most 2**20 contexts have more than 2**-20 of all customers
        split = seated.filter("kind = 3").groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect()
        shared = spark.sparkContext.broadcast((np.array([r["k"] for r in split], np.int64), np.array([r["n"] for r in split], np.float64)))
        replies = seated.filter("kind = 1").select(F.col("k").alias("block"), "kind", "part", "data")
        found = dealt(of_words(learned, words, "seen").union(replies), *texts).mapInArrow(_score_pairs(total, distinct, ends, learned.end_value, learned.unknown, parts, hot, shared, kind), out)
    return found.withColumnRenamed("id", id_col).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_tokens")))
