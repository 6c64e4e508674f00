"""Benchmark passages in documents, paraphrases included, by latent semantic retrieval.

Words are hashed to ``TERMS`` terms and weighted by the inverse document frequency of the whole corpus.
A randomised SVD (subspace iteration, one task's share of A'(AQ) summed over tasks) of all passages of
the benchmark gives the latent directions. Only their span matters to a window's product with a passage, so
nothing is learned from a sample of the corpus. Every window of every document is projected on them and
compared with the benchmark's passages. A window is a candidate where its cosine with a passage, times the
window's own length, reaches ``COVER`` of the passage's length: so the words around a short passage don't
thin it out. Candidates that can't hold half of the item's words are dropped by counting words; the rest are
checked word by word: the longest common subsequence, and whether the item's answer, its last words, stands
there.

The benchmark is the query set. One scan of the corpus takes ``ITEMS`` items, more than benchmarks have;
beyond it, further scans follow, each with its own broadcast, which is destroyed before the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.storage import free_name, materialize

from .exprs import bounded_batches

TERMS = 1 << 16
#: Latent directions: half as many as the benchmark has passages, within these bounds; ``EXTRA`` are iterated beside them.
RANKS, EXTRA = (128, 256), 16
STRIDE, SPAN = 16, 3
WINDOW = STRIDE * SPAN
#: Items of one scan.
ITEMS = 8192
#: Passages that one task of a multiplication takes; its share of A'(AQ) has a fixed size.
TASK_ROWS = 4096
COVER = 0.4
#: Share of an item's words in the common subsequence: enough alone, or with the answer.
ALONE, WITH_ANSWER, ANSWER_WORDS = 0.75, 0.5, 4
SEED, STEPS = 5, 3
_CHUNKS = 64
#: Bytes of normalised text that are searched at once, windows and passages of one product, words of one gather.
RUN_BYTES, _ROWS, _POINTS, _GATHER = 1 << 20, 4096, 512, 4096

_MARKS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII marks part words."""
    return normal_bytes(text).split()


def normal_bytes(text: str | None) -> bytes:
    return (text or "").lower().encode().translate(_MARKS)


_ODD = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    up, down = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def terms(data: bytes) -> np.ndarray:
    """Hashed term of each word of a normalised text: a polynomial over its bytes, by prefix sums over the text."""
    n, out, at = RUN_BYTES // 2, [], 0
    while at < len(data):
        end = len(data)
        if end - at > n:  # cut at a space; a longer word stays whole
            end = data.rfind(b" ", at, at + n)
            end = end if end > at else data.find(b" ", at + n)
            end = end if end > 0 else len(data)
        out.append(_part_terms(b" " + data[at:end] + b" ", n))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _part_terms(data: bytes, n: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    up, down = _powers(n + 2) if len(b) <= n + 2 else _powers.__wrapped__(len(b))
    inside = b > 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # before each word, and its last byte
    sums = np.cumsum(b * up[: len(b)])
    before, last = edges[::2], edges[1::2]
    h = (sums[last] - sums[before]) * down[before]
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64) & (TERMS - 1)


def passages(n: int) -> list[tuple[int, int]]:
    """Windows of ``WINDOW`` words at every ``STRIDE``-th; the last may be shorter."""
    return [(a, min(n, a + WINDOW)) for a in range(0, max(1, n - WINDOW + STRIDE), STRIDE)] if n else []


def common_subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, with the rows of ``a`` as bits of one number."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a task's rows: one row for each term that they have."""
    df, place = np.zeros(TERMS, np.int64), np.empty(TERMS, np.int64)
    for batch in batches:
        for text in batch.column(0):
            found = terms(normal_bytes(text.as_py()))
            number = np.arange(len(found))
            place[found] = number  # the last word of each term stands for it
            df[found[place[found] == number]] += 1
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], ["term", "n"])


def _random(seed: int, width: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((TERMS, width), np.float32)


def _slices() -> list[slice]:
    return [slice(at, at + TERMS // _CHUNKS) for at in range(0, TERMS, TERMS // _CHUNKS)]


def _orthonormal(z: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns in their place, from their Gram matrix, twice; a slice at a time, without a copy."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(sum(z[c].astype(np.float64).T @ z[c] for c in _slices()))
        scale = np.where(values > 1e-12 * values.max(), 1 / np.sqrt(np.maximum(values, 1e-300)), 0)
        turn = (vectors * scale).astype(np.float32)
        for c in _slices():
            z[c] = z[c] @ turn
    return z


def _product(basis, idf):
    """A task's share of A'(A Q), in chunks of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, weight = (_random(*basis) if isinstance(basis, tuple) else basis.value).astype(np.float32), idf.value
        share = np.zeros_like(q)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                t, tf = np.unique(np.frombuffer(data, "<u4"), return_counts=True)
                row = tf * weight[t]
                norm = np.linalg.norm(row)
                if norm:
                    row = (row / norm).astype(np.float32)
                    share[t] += np.outer(row, row @ q[t])
        for i, part in enumerate(np.split(share, _CHUNKS)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.astype(np.float16).tobytes()], pa.binary())], ["chunk", "part"])

    return run


def _added(pdf):
    import pandas as pd

    total = sum(np.frombuffer(p, np.float16).astype(np.float32) for p in pdf["part"])
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "part": [total.astype(np.float16).tobytes()]})


def latent_directions(rows: DataFrame, idf: np.ndarray, rank: int, seed: int = SEED) -> np.ndarray:
    """(TERMS, rank): leading right singular vectors of the passages (terms) by randomised subspace iteration."""
    spark, width = rows.sparkSession, rank + EXTRA
    weight = spark.sparkContext.broadcast(idf.astype(np.float32))
    start = (seed, width)  # every task draws the same start, which isn't sent
    q, z = None, None
    for step in range(STEPS):
        if step:
            q = _orthonormal(z).astype(np.float16)
        shared = spark.sparkContext.broadcast(q) if step else start
        parts = rows.mapInArrow(_product(shared, weight), "chunk bigint, part binary").groupBy("chunk").applyInPandas(_added, "chunk bigint, part binary").toArrow()
        if step:
            shared.destroy()
        z = np.empty((TERMS, width), np.float32) if z is None else z
        for chunk, part in zip(*parts.columns):
            z.reshape(_CHUNKS, -1)[chunk.as_py()] = np.frombuffer(part.as_buffer(), np.float16)
        del parts, chunk, part
        pa.default_memory_pool().release_unused()
    weight.destroy()
    small = sum(q[c].astype(np.float64).T @ z[c] for c in _slices())
    values, vectors = np.linalg.eigh(small)
    leading = vectors[:, np.argsort(-values)[:rank]].astype(np.float32)
    for c in _slices():
        z[c, :rank] = q[c].astype(np.float32) @ leading
    return z[:, :rank]


@dataclass
class Queries:
    """The items of one scan as tasks need them."""

    items: list[tuple[object, list[bytes]]]
    owner: np.ndarray
    points: np.ndarray
    """(passages, rank): each passage's latent vector over its squared length, so that a passage's product with itself is 1."""
    lengths: np.ndarray
    """Lengths of the passages' latent vectors."""
    project: np.ndarray
    """(TERMS, rank): weighted directions, in half precision."""
    square: np.ndarray
    table: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def build(cls, items, idf: np.ndarray, directions: np.ndarray) -> Queries:
        """Weights ``directions`` in their place."""
        directions *= idf[:, None].astype(np.float32)
        owner, points = [], []
        for i, (_, words) in enumerate(items):
            found = terms(b" ".join(words))
            for a, b in passages(len(found)):
                owner.append(i)
                points.append(directions[found[a:b]].sum(axis=0))
        points = np.array(points, np.float32).reshape(-1, directions.shape[1])
        lengths = np.maximum(np.linalg.norm(points, axis=1), 1e-9)
        return cls(items, np.array(owner, np.int64), points / (lengths**2)[:, None], lengths, directions.astype(np.float16), np.append(idf**2, 0).astype(np.float32))

    def open(self) -> Queries:
        """Make the table that windows are projected with; a row of zeros stands for no word."""
        self.table = np.zeros((TERMS + 1, self.project.shape[1]), np.float32)
        self.table[:TERMS] = self.project
        self.own = [terms(b" ".join(words)) for _, words in self.items]
        self.place = np.zeros(TERMS + 1, np.int64)
        self.reach = max([len(x) for x in self.own], default=0)
        return self

    def close(self) -> None:
        self.table = self.own = self.place = None

    def candidates(self, blocks: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, windows, their cosines) of the windows that start at blocks where ``starts`` holds.

        ``blocks`` are rows of ``STRIDE`` terms; ``TERMS`` is no word.
        """
        words, rank = blocks.reshape(-1), self.table.shape[1]
        sums, buffer = np.empty((len(blocks) + SPAN - 1, rank), np.float32), np.empty((_GATHER, rank), np.float32)
        sums[len(blocks) :] = 0
        for at in range(0, len(words), _GATHER):
            part = words[at : at + _GATHER]
            np.take(self.table, part, axis=0, out=buffer[: len(part)], mode="clip")
            np.sum(buffer[: len(part)].reshape(-1, STRIDE, rank), axis=1, out=sums[at // STRIDE : (at + len(part)) // STRIDE])
        pairs = []
        for low in range(0, len(blocks), _ROWS):
            high = min(len(blocks), low + _ROWS)
            total = sum(sums[low + k : high + k] for k in range(SPAN))
            for p in range(0, len(self.points), _POINTS):
                covered = total @ self.points[p : p + _POINTS].T
                w, q = np.nonzero(covered >= COVER)
                inside = starts[low + w]
                w, q = w[inside], q[inside]
                pairs.append((low + w, p + q, covered[w, q]))
        if not pairs:
            return
        window, point, covered = (np.concatenate(x) for x in zip(*pairs))
        item = self.owner[point]
        order = np.lexsort((window, item))
        window, point, covered, item = window[order], point[order], covered[order], item[order]
        cut = np.flatnonzero(np.diff(item, prepend=-1))
        norms = np.add.reduce(self.square[blocks], axis=1)
        norms = np.sqrt(sum(np.append(norms, np.zeros(SPAN - 1))[k : len(blocks) + k] for k in range(SPAN)))
        for a, b in zip(cut, np.append(cut[1:], len(item))):
            cosine = covered[a:b] * self.lengths[point[a:b]] / np.maximum(norms[window[a:b]], 1e-9)
            kept = self._may_hold(int(item[a]), blocks, window[a:b])
            if kept.any():
                yield int(item[a]), window[a:b][kept], cosine[kept]

    def _may_hold(self, item: int, blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Windows around which enough of the item's words stand at all, counted by term; none that the word check accepts is dropped."""
        own = self.own[item]
        distinct, n = np.unique(own, return_counts=True)
        beside = -(-len(own) // STRIDE)
        width = len(distinct) + 1
        self.place[distinct] = np.arange(1, width)
        out = np.zeros(len(windows), bool)
        for at in range(0, len(windows), 2048):
            near = windows[at : at + 2048, None] + np.arange(-beside, SPAN + beside)
            near = blocks[np.clip(near, 0, len(blocks) - 1)].reshape(len(near), -1)
            place = self.place[near] + np.arange(len(near))[:, None] * width
            counts = np.bincount(place.reshape(-1), minlength=len(near) * width).reshape(-1, width)[:, 1:]
            held = np.minimum(counts, n).sum(axis=1)
            answer = (counts[:, self.place[own[-ANSWER_WORDS:]] - 1] > 0).all(axis=1)
            out[at : at + 2048] = (held >= ALONE * len(own)) | answer & (held >= WITH_ANSWER * len(own))
        self.place[distinct] = 0
        return out

    def check(self, item: int, words: list[bytes], at: np.ndarray) -> tuple[float, bool]:
        """(share of the item's words in order, answer found) around windows that start at these words."""
        own = self.items[item][1]
        best, answered = 0.0, False
        answer = b" " + b" ".join(own[-ANSWER_WORDS:]) + b" "
        # parts of twice the item's length (or two windows), half overlapping: no common words from far apart
        width = 2 * max(len(own), WINDOW // 2)
        spans: list[list[int]] = []
        for a in sorted(set(at.tolist())):
            low, high = max(0, a - len(own)), min(len(words), a + WINDOW + len(own))
            if spans and low <= spans[-1][1]:
                spans[-1][1] = high
            else:
                spans.append([low, high])
        for low, high in spans:
            for a in range(low, max(low + 1, high - width // 2), width // 2):
                part = words[a : a + width]
                share = common_subsequence(own, part) / len(own)
                best = max(best, share)
                answered = answered or (share >= WITH_ANSWER and answer in b" " + b" ".join(part) + b" ")
        return best, answered

    def search(self, texts: list[tuple[int, bytes]]) -> dict[tuple[int, int], tuple[float, float, bool]]:
        """(row, item): (cosine, share, answered) of the items that the normalised texts (row, bytes) hold."""
        found = [terms(data) for _, data in texts]
        n = np.fromiter(map(len, found), np.int64, len(found))
        full = -(-n // STRIDE)
        first = np.concatenate(([0], np.cumsum(full + SPAN - 1)))  # no window reaches into the next text
        blocks = np.full(int(first[-1]) * STRIDE, TERMS, np.int64)
        blocks[np.arange(n.sum()) + np.repeat(first[:-1] * STRIDE - (np.cumsum(n) - n), n)] = np.concatenate(found) if found else []
        starts = np.zeros(int(first[-1]) + 1, np.int64)
        np.add.at(starts, first[:-1], 1)
        np.add.at(starts, first[:-1] + full, -1)
        out: dict[tuple[int, int], tuple[float, float, bool]] = {}
        split: dict[int, list[bytes]] = {}
        for item, windows, cosines in self.candidates(blocks.reshape(-1, STRIDE), np.cumsum(starts[:-1]) > 0):
            text = np.searchsorted(first, windows, side="right") - 1
            for t in np.unique(text).tolist():
                own = text == t
                words = split.get(t) or split.setdefault(t, texts[t][1].split())
                share, answered = self.check(item, words, (windows[own] - first[t]) * STRIDE)
                if share >= ALONE or answered:
                    key = (texts[t][0], item)
                    cos, best, had = out.get(key, (0.0, 0.0, False))
                    out[key] = (max(cos, float(cosines[own].max())), max(best, share), had or answered)
        return out


def _parts(data: bytes, reach: int) -> Iterator[bytes]:
    """A long text in parts that overlap by more than a check reads."""
    at = 0
    while len(data) - at > RUN_BYTES:
        end = data.rfind(b" ", at, at + RUN_BYTES)
        end = end if end > at else data.find(b" ", at + RUN_BYTES)
        if end < 0:
            break
        yield data[at:end]
        back = end
        for _ in range(WINDOW + 4 * reach):  # so many words back
            back = data.rfind(b" ", at + 1, back)
            if back < 0:
                break
        at = back if back > at else end
    yield data[at:]


def _search(queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries.value.open()
        for batch in batches:
            rows, held, size = {}, [], 0
            texts = batch.column(2)
            for i in range(batch.num_rows):
                data = normal_bytes(texts[i].as_py())
                for part in _parts(data, own.reach) if len(data) > RUN_BYTES else (data,):
                    held.append((i, part))
                    size += len(part)
                    if size >= RUN_BYTES:
                        for (row, item), hit in own.search(held).items():
                            cos, best, had = rows.get((row, item), (0.0, 0.0, False))
                            rows[row, item] = (max(cos, hit[0]), max(best, hit[1]), had or hit[2])
                        held, size = [], 0
            for key, hit in own.search(held).items():
                cos, best, had = rows.get(key, (0.0, 0.0, False))
                rows[key] = (max(cos, hit[0]), max(best, hit[1]), had or hit[2])
            at, item = (pa.array([k[j] for k in rows], pa.int64()) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), item, *[pa.array([hit[k] for hit in rows.values()], kind) for k, kind in enumerate((pa.float64(), pa.float64(), pa.bool_()))]], ["id", "h", "item", "cosine", "lcs_share", "answered"])
        own.close()

    return run


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", items: int = ITEMS) -> DataFrame:
    """(id, h, item_id, cosine, lcs_share, answered): documents and the benchmark items that they hold.

    ``h`` is the text's hash, which tells apart rows that share an id. Ids of documents and of items may
    be of any type, null or repeated, and come back as they are. Every window of every text is compared,
    long texts in overlapping parts. Null and empty texts or items match nothing; repeated rows give
    repeated pairs; an empty table of either kind gives no pair; further columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind, item_kind = (df.select(c).schema[0].dataType.simpleString() for df, c in ((docs, id_col), (benchmark, item_col)))
    held = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    total = docs.count()
    df = np.zeros(TERMS)
    counted = held.select("text").mapInArrow(_frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most TERMS rows
    df[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    idf = np.log((1 + total) / (1 + df))

    def scan(part: list) -> DataFrame:
        own = [terms(b" ".join(words))[a:b] for _, words in part for a, b in passages(len(words))]
        rows = spark.createDataFrame([(bytearray(t.astype("<u4").tobytes()),) for t in own], "terms binary")
        rows = materialize(rows.repartition(max(2, -(-len(own) // TASK_ROWS))), "passages")
        rank = min(max(RANKS[0], len(own) // 2), RANKS[1])
        shared = spark.sparkContext.broadcast(Queries.build(part, idf, latent_directions(rows, idf, rank)))
        found = held.mapInArrow(_search(shared), f"id {kind}, h bigint, item bigint, cosine double, lcs_share double, answered boolean")
        found = materialize(found, "hits")
        shared.destroy()
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(part)], f"item bigint, item_id {item_kind}")
        return found.join(F.broadcast(names), "item").select("id", "h", "item_id", "cosine", "lcs_share", "answered")  # at most ITEMS names

    found, part = spark.createDataFrame([], f"id {kind}, h bigint, item_id {item_kind}, cosine double, lcs_share double, answered boolean"), []
    texts = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).orderBy("item", "text")
    for row in texts.toLocalIterator():
        if words := normal_words(row["text"]):
            part.append((row["item"], words))
        if len(part) == items:
            found, part = found.unionByName(scan(part)), []
    return found.unionByName(scan(part)) if part else found


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, contaminated, item_ids, best_lcs_share``.

    ``item_ids`` is sorted and has each id once; an item without an id stands last, as null. A null or
    empty text holds nothing; rows that repeat id and text get equal answers; ids may be null; an empty
    table gives an empty result, an empty benchmark leaves every row clean; further columns are not read.
    """
    hits = contaminated_pairs(docs, benchmark, id_col, text_col, **how)
    ids = F.transform(F.collect_set(F.struct("item_id")), lambda x: x["item_id"])
    by_doc = hits.groupBy("id", "h").agg(F.array_sort(ids).alias("item_ids"), F.max("lcs_share").alias("best"))
    by_doc = by_doc.withColumnsRenamed({"id": "own", "h": "own_h"})
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    joined = rows.join(by_doc, F.col("id").eqNullSafe(F.col("own")) & (F.col("h") == F.col("own_h")), "left")
    none = F.array().cast(by_doc.schema["item_ids"].dataType)
    return joined.select(F.col("id").alias(id_col), F.isnotnull("item_ids").alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("best", F.lit(0.0)).alias("best_lcs_share"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, columns unchanged; rows with a null or empty text stay."""
    own, own_h = free_name(docs, "own", "own_h")
    hits = contaminated_pairs(docs, benchmark, id_col, text_col, **how).select(F.col("id").alias(own), F.col("h").alias(own_h)).distinct()
    hits = materialize(hits, "contaminated")
    return docs.join(hits, docs[id_col].eqNullSafe(F.col(own)) & (F.xxhash64(docs[text_col]) == F.col(own_h)), "left_anti")
