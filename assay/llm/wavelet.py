"""Token ids in wavelet-matrix shards: one compressed file for each shard, read without decoding it all.

Documents are range-partitioned by id, so shards follow each other in ascending id order and no shard
depends on another; how many there are follows the texts' bytes. A shard is one Parquet file of segments; a segment is a wavelet matrix over about
``SEGMENT`` ids that ends with a document. Its bit-planes (most significant first) are compressed one
by one, with counts of ones before every 512th bit, so that access, counting and occurrence lookup
read planes and never the ids themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assay.storage import new_path, partitions

from .exprs import bounded_batches
from .tokens import BYTE_BPE, encoder

SEGMENT = 1_000_000
#: Text bytes of a shard at most, on average; and the least for which one is opened while there are idle tasks.
SHARD_BYTES, LEAST_BYTES = 128 << 20, 1 << 20
BLOCK = 512
END_ID = 0


def _schema(kind: str) -> str:
    return f"shard int, segment int, start bigint, n bigint, doc_ids array<{kind}>, lengths array<bigint>, zeros array<bigint>, ranks array<binary>, planes array<binary>"


class WaveletMatrix:
    """A sequence of ids as bit-planes; every method works on the planes."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        depth = max(1, int(ids.max(initial=0)).bit_length())
        now = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for level in range(depth - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            padded = np.pad(packed, (0, -len(packed) % (BLOCK // 8)))
            per_block = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            ranks.append(np.concatenate(([0], np.cumsum(per_block))).astype("<u4"))
            planes.append(padded)
            low = now[~bit]
            zeros.append(len(low))
            now = np.concatenate((low, now[bit]))
        return cls(len(ids), zeros, planes, ranks)

    def _bit(self, level: int, i):
        return self.planes[level][i >> 3] >> (i & 7).astype(np.uint8) & 1

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = i // BLOCK
        out = self.ranks[level][block].astype(np.int64)
        for k, (b, at) in enumerate(zip(block.tolist(), i.tolist())):
            part = self.planes[level][b * BLOCK // 8 : at >> 3]
            out[k] += int(np.bitwise_count(part).sum())
            if at & 7:
                out[k] += int(self.planes[level][at >> 3] & ((1 << (at & 7)) - 1)).bit_count()
        return out

    def access(self, i: int) -> int:
        at, value = np.array([i]), 0
        for level, z in enumerate(self.zeros):
            bit, ones = int(self._bit(level, at)[0]), self._ones(level, at)
            at, value = (z + ones if bit else at - ones), value << 1 | bit
        return value

    def _span(self, symbol: int, until: int) -> tuple[int, int]:
        """Where the symbol's occurrences before ``until`` stand below the last plane."""
        span = np.array([0, until])
        if symbol >> len(self.zeros):
            return 0, 0
        for level, z in enumerate(self.zeros):
            ones = self._ones(level, span)
            span = z + ones if symbol >> len(self.zeros) - 1 - level & 1 else span - ones
        return int(span[0]), int(span[1])

    def rank(self, symbol: int, until: int) -> int:
        """Occurrences of the symbol before position ``until``."""
        a, b = self._span(symbol, until)
        return b - a

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence, counted from 0."""
        a, b = self._span(symbol, self.n)
        if not 0 <= k < b - a:
            raise IndexError(f"symbol {symbol} has {b - a} occurrences")
        at = a + k
        for level in range(len(self.zeros) - 1, -1, -1):
            z = self.zeros[level]
            at = self._find(level, at - z, True) if at >= z else self._find(level, at, False)
        return at

    def _find(self, level: int, k: int, ones: bool) -> int:
        before = self.ranks[level].astype(np.int64)
        if not ones:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == ones)[k - before[block]])

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up: each plane says where its zeros and ones stood."""
        values = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above, z = np.empty_like(values), self.zeros[level]
            above[~bit] = values[:z]
            above[bit] = values[z:] | (1 << len(self.zeros) - 1 - level)
            values = above
        return values.astype("<u4")

    def pack(self) -> dict:
        press = zstandard.ZstdCompressor(level=1).compress
        return {"n": self.n, "zeros": self.zeros, "ranks": [press(r.tobytes()) for r in self.ranks], "planes": [press(p.tobytes()) for p in self.planes]}

    @classmethod
    def unpack(cls, n: int, zeros: list[int], ranks: list[bytes], planes: list[bytes]) -> WaveletMatrix:
        free = zstandard.ZstdDecompressor().decompress
        return cls(n, zeros, [np.frombuffer(free(p), np.uint8) for p in planes], [np.frombuffer(free(r), "<u4") for r in ranks])


def _write(vocabulary: str, segment: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_, end = encoder(vocabulary), np.array([END_ID], "<u4").tobytes()
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        doc_ids, parts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, start, doc_ids, parts, held
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = {"shard": shard, "segment": number, "start": start, "doc_ids": doc_ids, "lengths": [len(p) // 4 for p in parts]} | WaveletMatrix.build(ids).pack()
            names = [f.split()[0] for f in _schema("x").split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]
            number, start, doc_ids, parts, held = number + 1, start + len(ids), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in zip(names, kinds)], names)

        for batch in batches:
            own_ids, row = batch.column(0).to_pylist(), 0
            for ids, lengths in encoder_.encode_rows(batch.column(1)):
                data, ends = memoryview(ids.tobytes()), np.cumsum(lengths) * 4
                for a, b in zip((ends - lengths * 4).tolist(), ends.tolist()):
                    doc_ids.append(own_ids[row])
                    parts.append(bytes(data[a:b]) + end)
                    held, row = held + (b - a) // 4 + 1, row + 1
                    if held >= segment:
                        yield flush()
        encoder_.forget()
        if parts:
            yield flush()

    return run


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE, shards: int | None = None, segment: int = SEGMENT) -> None:
    """Encode whole texts and write them as wavelet-matrix shards in ascending id order.

    Each document ends with id 0. A null or empty text is that end id alone. Ids may be of any type that
    orders; null ids come first; rows that share an id stand next to each other, by text hash, and may
    fall into different shards. A very long text is encoded in parts and lies in one segment. An empty
    table gives a folder with no segment. Further columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if shards is None:
        held = kept.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)).alias("n")).first()["n"]
        shards = max(1, min(partitions(spark), held // LEAST_BYTES), -(-held // SHARD_BYTES))
    order = (F.col("id").asc_nulls_first(), F.xxhash64("text").asc())
    kind = kept.schema["id"].dataType
    kept.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(_write(vocabulary, segment, to_arrow_type(kind)), _schema(kind.simpleString())).write.parquet(path)


def _with_base(segments: DataFrame) -> DataFrame:
    """Segments with ``base``: ids in all shards before. One total for each shard reaches the driver."""
    totals = sorted((r["shard"], r["ids"]) for r in segments.groupBy("shard").agg(F.sum("n").alias("ids")).collect())
    bases, before = [], 0
    for shard, ids in totals:
        bases.append((shard, before))
        before += ids
    # as many rows as shards, which the writer fixes
    base = segments.sparkSession.createDataFrame(bases, "shard int, base bigint")
    return segments.join(F.broadcast(base), "shard")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, WaveletMatrix | None]]:
    """Segments, each with its matrix."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            yield row, WaveletMatrix.unpack(row["n"], row["zeros"], row["ranks"], row["planes"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "doc_ids"}
            ids = WaveletMatrix.unpack(row["n"], row["zeros"], row["ranks"], row["planes"]).decode()
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.array(row["base"] + row["start"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """What the files hold of each document: ``id_col``, ``start``, ``n_tokens``, ``ids_crc32``."""
    segments = _with_base(spark.read.parquet(path))
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    found = segments.select("doc_ids", "lengths", "start", "base", "n", "zeros", "ranks", "planes").mapInArrow(_digest, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
    return found.withColumnRenamed("id", id_col)


_PLANES = ("n", "zeros", "ranks", "planes")


def find_token(spark: SparkSession, path: str, symbol: int) -> DataFrame:
    """(doc_id, position): every occurrence of an id, counted from the document's start, from the planes alone."""
    segments = spark.read.parquet(path).select("doc_ids", "lengths", *_PLANES)
    element = segments.schema["doc_ids"].dataType.elementType
    kind = to_arrow_type(element)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, matrix in _rows(batches):
            at = np.array(matrix.occurrences(symbol), np.int64)
            ends = np.cumsum(np.array(row["lengths"], np.int64))
            doc = np.searchsorted(ends, at, side="right")
            yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][d] for d in doc], kind), pa.array(at - np.concatenate(([0], ends))[doc])], ["doc_id", "position"])

    return segments.mapInArrow(run, f"doc_id {element.simpleString()}, position bigint")


def count_token(spark: SparkSession, path: str, symbol: int) -> int:
    """How often an id stands in all files, by rank on the planes; 0 if it doesn't, or if there is no segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(matrix.count(symbol) for _, matrix in _rows(batches))], pa.int64())], ["n"])

    return spark.read.parquet(path).select(*_PLANES).mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def tokens_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """(position, token): the ids at these places of all ids on end, by access on the planes; places beyond the end give no row."""
    wanted = np.unique(np.array(positions, np.int64))
    low, high = (int(wanted[0]), int(wanted[-1])) if len(wanted) else (1, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, matrix in _rows(batches):
            first = row["base"] + row["start"]
            own = wanted[(wanted >= first) & (wanted < first + row["n"])]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([matrix.access(int(i) - first) for i in own], pa.int64())], ["position", "token"])

    first = F.col("base") + F.col("start")
    segments = _with_base(spark.read.parquet(path)).filter((first <= high) & (first + F.col("n") > low))
    return segments.select("base", "start", *_PLANES).mapInArrow(run, "position bigint, token bigint")


def token_shards(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE, shards: int | None = None) -> DataFrame:
    """Write the shards, read them back, and return ``id_col, start, n_tokens, ids_crc32`` of each row from the files.

    Null, empty, very long and repeated texts, null ids and empty tables are as ``write_shards`` states.
    """
    path = path or new_path(docs.sparkSession, "shards")
    write_shards(docs, path, id_col, text_col, vocabulary, shards)
    return read_documents(docs.sparkSession, path, id_col)
