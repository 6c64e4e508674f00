"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint is the bitwise majority of the XXH64 values of its word 3-shingles. Fifteen
structured masks cover the 64 bits: position i carries the non-zero vector phi(i) of GF(2)^4, and mask
v keeps the positions with <phi(i), v> = 1. Three differing positions span at most three dimensions,
so some non-zero v is orthogonal to all of them and its masked values agree: every pair within the
radius meets in some table, without exception.

Buckets are read as sorted runs, and links are found inside the task, so no list of pairs is ever
made. A bucket of more than ``RUN`` fingerprints is dealt anew under a second, independent family of
masks; what two masks leave open is at most ``OPEN_BITS`` bits, which bounds such a group whatever the
data hold. No bucket is capped or skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.graph import components
from assay.storage import free_name, materialize, partitions

from .exprs import id_or_default

RADIUS = 3
DIMENSION = RADIUS + 1
RUN = 4096
SHINGLE = 3
SEED = 42
_LANES = np.uint64(0x0101010101010101)


def covering_masks(phi) -> list[int]:
    """The 2^(radius+1) - 1 masks of one assignment ``phi`` of non-zero vectors to bit positions."""
    return [sum(1 << i for i in range(64) if (phi(i) & v).bit_count() % 2) for v in range(1, 2**DIMENSION)]


FIRST = covering_masks(lambda i: i % 15 + 1)
SECOND = covering_masks(lambda i: (i * 4 + i // 15 * 7) % 15 + 1)
#: The most bits that a mask of each family leave open together.
OPEN_BITS = max(64 - (a | b).bit_count() for a in FIRST for b in SECOND)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of each word shingle of a text whose A-Z are lower-cased; a shorter text is one shingle."""
    words = text.lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-size]]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Fingerprints (uint64) of many texts; zero for a text without words.

    The set bits are counted in eight byte lanes of a 64-bit word over blocks of up to 255 shingles,
    then the blocks are added up for each text.
    """
    out = np.zeros(len(texts), np.uint64)
    hashes, where, sizes = [], [], []
    for i, text in enumerate(texts):
        if found := shingle_hashes(text):
            hashes.append(np.array(found, np.uint64))
            where.append(i)
            sizes.append(len(found))
    if not where:
        return out
    h, n = np.concatenate(hashes), np.array(sizes)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    blocks_of = (n + 254) // 255
    first_block = np.concatenate(([0], np.cumsum(blocks_of)[:-1]))
    within = np.arange(blocks_of.sum()) - np.repeat(first_block, blocks_of)
    block_starts = np.repeat(starts, blocks_of) + 255 * within
    found = np.zeros(len(n), np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, block_starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_block, axis=0)
        for byte in range(8):
            found |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    out[np.array(where)] = found
    return out


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): one row for each row of ``docs``, with the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 256):
                part = [t or b"" for t in texts.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array(fingerprints(part).view(np.int64))], ["id", "fp"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def _spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links fingerprints within the radius."""
    left, edges, front = fps, [], []
    while len(left) or front:
        if not front:
            front, left = [left[0]], left[1:]
        near = np.bitwise_count(left ^ front[-1]) <= RADIUS
        seed = front.pop()
        if near.any():
            found = left[near]
            edges += [(int(seed), int(x)) for x in found]
            front += list(found)
            left = left[~near]
    return edges


def _scan(limit: int | None):
    """Read rows sorted by (table, key, fp): links of each run; the rows of a run above ``limit`` as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 3
        heavy = None  # the key whose rows are being passed on

        def out(kind: int, a, b) -> pa.RecordBatch:
            a = np.asarray(a, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(np.asarray(b, np.int64))], ["kind", "a", "b"])

        def runs(t, k, fp, last: bool):
            nonlocal held, heavy
            if not len(t):
                return
            cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(t)]))
            edges: list[tuple[int, int]] = []
            full = len(starts) if last else len(starts) - 1
            for s, e in zip(starts[:full][ends[:full] - starts[:full] > 1], ends[:full][ends[:full] - starts[:full] > 1]):
                if (limit and e - s > limit) or heavy == (t[s], k[s]):
                    yield out(1, fp[s:e], t[s:e])
                else:
                    edges += _spanning(fp[s:e].view(np.uint64))
            if heavy is not None and full and (t[starts[0]], k[starts[0]]) == heavy and ends[0] - starts[0] == 1:
                yield out(1, fp[:1], t[:1])
            if edges:
                pairs = np.array(edges, np.uint64).view(np.int64)
                yield out(0, pairs[:, 0], pairs[:, 1])
            if last:
                return
            s = starts[-1]
            if (limit and len(t) - s > limit) or heavy == (t[s], k[s]):
                heavy = (t[s], k[s])
                yield out(1, fp[s:], t[s:])
                held = [np.empty(0, np.int64)] * 3
            else:
                held = [t[s:], k[s:], fp[s:]]

        for batch in batches:
            columns = [np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64))) for i, h in enumerate(held)]
            held = [np.empty(0, np.int64)] * 3
            yield from runs(*columns, last=False)
        yield from runs(*held, last=True)

    return run


def _tables(df: DataFrame, masks: list[int], *keep: str) -> DataFrame:
    """A row for each fingerprint and mask; t numbers the table, k is the masked value."""
    each = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(masks)])
    return df.select("fp", *keep, F.explode(each).alias("x")).select("fp", *keep, F.col("x.t").alias("t"), F.col("x.k").alias("k"))


def links(classes: DataFrame, run: int = RUN) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` of ``classes`` that connect all pairs within the radius."""
    n = partitions(classes.sparkSession)
    dealt = _tables(classes.select("fp"), FIRST).select("t", "k", "fp")
    first = materialize(dealt.repartition(n, "t", "k").sortWithinPartitions("t", "k", "fp").mapInArrow(_scan(run), "kind int, a bigint, b bigint"), "links")
    heavy = first.filter("kind = 1")
    again = _tables(heavy.select(F.col("a").alias("fp"), F.col("b").alias("t1")), SECOND, "t1")
    masked = F.element_at(F.array(*[F.lit(signed(m)) for m in FIRST]), (F.col("t1") + 1).cast("int"))
    again = again.select((F.col("t1") * 15 + F.col("t")).cast("int").alias("t"), F.col("fp").bitwiseAND(masked.bitwiseOR(F.element_at(F.array(*[F.lit(signed(m)) for m in SECOND]), F.col("t") + 1))).alias("k"), "fp")
    second = again.repartition(n, "t", "k").sortWithinPartitions("t", "k", "fp").mapInArrow(_scan(None), "kind int, a bigint, b bigint")
    return first.filter("kind = 0").select("a", "b").union(second.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``fingerprint`` and ``component_id``.

    ``component_id`` is the smallest id among the documents that can be reached over links of at most
    three differing bits. A null or empty text has fingerprint zero and is linked like any other;
    equal fingerprints are always linked; a null id never names a component unless all its members'
    ids are null. Repeated rows come back repeated, an empty table comes back empty, and further
    columns of ``docs``, whatever their names, are not read.
    """
    prints = materialize(with_fingerprint(docs, id_col, text_col), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    member = materialize(components(links(classes, run)), "members")
    labelled = classes.join(member, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = labelled.select("fp", "root").join(least, "root").select("fp", "component_id")
    found = prints.join(by_print, "fp")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_an_id: bool = True) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id, then the smallest text hash.

    Null ids come last, and each group whose ids are all null keeps one row of its own. With ``one_an_id``,
    rows of different groups that share an id are cut to one too, the one with the smallest text hash;
    without, they all stay. Columns stay as they are.
    """
    key, none, rank, h = free_name(docs, "key", "none", "rank", "h")
    parts = [F.isnull(id_col), id_or_default(docs, id_col), F.xxhash64(text_col)]
    place = F.struct(*[c.alias(n) for c, n in zip(parts, (none, key, h))])
    # the smallest place of a group is its component's name
    heads = near_duplicates(docs.select(place.alias("place"), F.col(text_col).alias("text")), "place", "text").select("component_id.*").distinct()
    if one_an_id:
        heads = heads.filter(none).union(heads.filter(~F.col(none)).groupBy(none, key).agg(F.min(h).alias(h)))
    heads = materialize(heads, "heads")
    keyed = docs.withColumns(dict(zip((none, key, h), parts)))
    # repeated rows meet in the join already, so that ranking them needs no further shuffle
    ties = Window.partitionBy(none, key, h).orderBy(h)
    kept = keyed.join(heads, [none, key, h], "left_semi").withColumn(rank, F.row_number().over(ties))
    return kept.filter(F.col(rank) == 1).drop(key, none, rank, h)
