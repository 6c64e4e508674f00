"""Exact tokenisation on executors, and token counts through a digest cache.

``PieceEncoder`` gives the ids that the ``tokenizers`` library gives for whole texts, faster. The
byte-level pre-tokenizer never lets a piece reach across a space that follows a non-space, so texts fall
into chunks there; a chunk of letters, digits, marks and single line ends falls into its pieces by the
classes of its bytes alone. Cutting is done for many rows at once on the bytes of an Arrow column, and
each distinct piece is encoded once by the library and remembered for the rest of the task. Chunks with
anything else (apostrophes, special strings, wide gaps, other scripts) go to the library whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.storage import new_path

from .exprs import bounded_batches

BYTE_BPE = "byte_bpe_50k.json"
#: Pieces that a task remembers, none longer than ``LONGEST`` bytes; beyond it, it forgets all and starts anew.
REMEMBERED, LONGEST = 250_000, 64
#: Bytes that are cut at once; a longer text is cut in parts, at spaces.
RUN_BYTES = 4 << 20

_SPACE, _LETTER, _DIGIT, _MARK, _LINE, _ODD, _OTHER, _EDGE = range(8)
#: Classes of bytes: odd ones are no white space, the others may be.
_KIND = np.full(256, _OTHER, np.uint8)
for _c in range(33, 127):
    _KIND[_c] = _LETTER if chr(_c).isalpha() else _DIGIT if chr(_c).isdigit() else _MARK
_KIND[[ord("'"), ord("<")]] = _ODD
_KIND[ord(" ")], _KIND[ord("\n")] = _SPACE, _LINE
_SOLID = np.isin(np.arange(8), [_LETTER, _DIGIT, _MARK, _ODD])
_BESIDE_LINE = np.isin(np.arange(8), [_LETTER, _DIGIT, _MARK, _EDGE])
_ONE_PIECE = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-/:-@\[-`{-~]+)|\n")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level models use for each byte: itself, or the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def piece_starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start that lie on end in ``data``; ``rows`` are the texts' own starts."""
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))  # letters of two bytes, but the signs of times and division
    point = (data[lead].astype(np.int32) & 31) << 6 | data[lead + 1] & 63
    lead = lead[(point <= 0x24F) & (point != 0xD7) & (point != 0xF7)]
    kind[lead] = kind[lead + 1] = _LETTER
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    rows = rows[rows < len(data)]
    before[rows] = after[rows - 1] = _EDGE  # the first text starts at 0, so the last byte is an edge as well
    space, solid = kind == _SPACE, _SOLID[before]
    cut = space & solid
    cut[rows] = True
    bad = (kind >= _ODD) | space & ~solid & (before != _EDGE) | (kind == _LINE) & ~(_BESIDE_LINE[before] & _BESIDE_LINE[after])
    starts = cut | (kind != before) & (before != _SPACE)
    if bad.any():
        chunks = np.flatnonzero(cut)
        whole = np.repeat(np.logical_or.reduceat(bad, chunks), np.diff(np.append(chunks, len(data))))
        starts &= cut | ~whole
    return np.flatnonzero(starts)


class PieceEncoder:
    """Ids of whole texts, without added special tokens."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        pre = self.whole.pre_tokenizer
        described = pre.__getstate__().decode() if pre is not None else ""
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        plain = '"ByteLevel"' in described and '"add_prefix_space":false' in described and '"use_regex":true' in described and self.whole.normalizer is None
        #: An added string must stand inside one chunk, and make it odd.
        self.by_piece = plain and all("<" in t and " " not in t for t in added)
        self.letters = _byte_letters()
        self.tokenize = self.whole.model.tokenize
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        """Free what is remembered."""
        self.known: dict[str, int] = {}
        self.pool, self.starts, self.lengths = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def _by_library(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _one(self, piece: str) -> list[int]:
        if piece.isascii() and piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):  # most pieces
            return [t.id for t in self.tokenize(piece.replace(" ", "Ġ"))]
        if not _ONE_PIECE.fullmatch(piece):
            return self._by_library(piece)
        return [t.id for t in self.tokenize(piece.encode().decode("latin1").translate(self.letters))]

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Where each piece's ids stand in the pool; new pieces are added to it."""
        if len(self.starts) > self.remembered:
            self.forget()
        get = self.known.get
        at = np.array([get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            found = [self._one(pieces[i]) for i in new.tolist()]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            at[new] = np.arange(len(self.starts), len(self.starts) + len(new))
            self.starts = np.append(self.starts, len(self.pool) + np.cumsum(lengths) - lengths)
            self.lengths = np.append(self.lengths, lengths)
            self.pool = np.append(self.pool, np.array([i for ids in found for i in ids], "<u4"))
            for i in new.tolist():
                if len(pieces[i]) <= LONGEST:
                    self.known[pieces[i]] = int(at[i])
        return at

    def _run(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of texts on end, which start at ``rows``, the first at 0."""
        if not len(data):
            return np.empty(0, "<u4"), np.zeros(len(rows), np.int64)
        starts = piece_starts(data, rows)
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        at = self._numbers(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())[pieces.indices.to_numpy()]
        lengths = self.lengths[at]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.pool[np.repeat(self.starts[at] - ends[:-1], lengths) + np.arange(ends[-1])]
        first = np.append(np.searchsorted(starts, rows), len(starts))
        return ids, ends[first[1:]] - ends[first[:-1]]

    def encode_rows(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, lengths) of runs of rows: their ids on end, and how many each row has. A null is the empty text."""
        column = column.cast(pa.binary()).fill_null(b"")
        if not self.by_piece:
            for at in range(0, len(column), 256):
                found = [self._by_library(t.decode()) for t in column.slice(at, 256).to_pylist()]
                yield np.array([i for ids in found for i in ids], "<u4"), np.fromiter(map(len, found), np.int64, len(found))
            return
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(buffers[2] or b"", np.uint8)
        row = 0
        while row < len(column):
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + RUN_BYTES, side="right")) - 1)
            low, high = int(offsets[row]), int(offsets[last])
            if high - low <= RUN_BYTES:
                yield self._run(data[low:high], offsets[row:last] - low)
            else:  # one long row
                parts = [self._run(data[a:b], np.zeros(1, np.int64))[0] for a, b in self._parts(data, low, high)]
                yield np.concatenate(parts), np.array([sum(map(len, parts))])
            row = last

    @staticmethod
    def _parts(data: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
        """A long text in parts that end where a space follows a letter, if it has such places."""
        while high - low > RUN_BYTES:
            seen = data[low + 1 : low + RUN_BYTES]
            ends = np.flatnonzero((seen[1:] == 32) & (_KIND[seen[:-1]] == _LETTER))
            if not len(ends):
                break
            yield low, low + 2 + int(ends[-1])
            low += 2 + int(ends[-1])
        yield low, high

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return b"".join(ids.tobytes() for ids, _ in self.encode_rows(pa.array([text], pa.string())))


class _SentencePieces:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode_rows(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(column), 256):
            found = [self.model.encode(t or "") for t in column.slice(at, 256).to_pylist()]
            yield np.array([i for ids in found for i in ids], "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def forget(self) -> None:
        pass


@cache
def encoder(vocabulary: str):
    """The encoder of a vocabulary file, one for each Python worker. A bare name is a public tokenizer's file."""
    path = vocabulary_path(vocabulary)
    return _SentencePieces(path) if path.endswith(".model") else PieceEncoder(path)


def vocabulary_path(vocabulary: str) -> str:
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return str(public_tokenizers.path(vocabulary))


def tokenizer_version(vocabulary: str) -> str:
    """Digest of the vocabulary file: counts of another tokenizer, or another version of it, never match."""
    with open(vocabulary_path(vocabulary), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _count(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            n = [lengths for _, lengths in own.encode_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.empty(0, np.int64), *n]))], ["digest", "n_tokens"])
        own.forget()

    return run


def token_counts(docs: DataFrame, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE, limit: int = 1024) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    The cache is a Parquet table (digest, version, n_tokens) at ``cache_path`` that grows by appending.
    The digest is SHA-256 of the normalised content; as counts must be those of the exact text, the
    only normal form applied is UTF-8 with null as the empty text. Only distinct contents whose digest
    and version are not stored are encoded. Copies are reduced to one before the shuffle, so a text
    that a third of all rows share travels once for each input task.

    A null or empty text has 0 bytes and 0 tokens; ids may be null or repeated and come back as they
    are; an empty table comes back empty; further columns are not read. A cache in which a stopped run
    left a digest twice is read as if it were there once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = cache_path or new_path(spark, "token-cache")
    version = tokenizer_version(vocabulary)
    schema = "digest binary, version string, n_tokens bigint"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    digest = F.unhex(F.sha2(F.encode("text", "utf-8"), 256)).alias("digest")

    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    stored = spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)
    stored = stored.filter(F.col("version") == version)

    distinct = keyed.groupBy(digest).agg(F.first("text").alias("text"))
    misses = distinct.join(stored.select("digest"), "digest", "left_anti")
    counted = misses.select("digest", "text").mapInArrow(_count(vocabulary), "digest binary, n_tokens bigint")
    counted.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(path)

    counts = spark.read.schema(schema).parquet(path).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    narrow = keyed.select("id", F.octet_length("text").cast("bigint").alias("n_bytes"), digest)
    found = narrow.join(counts, "digest")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
