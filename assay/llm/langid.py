"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased, everything but letters and their marks becomes one space, and each 2-, 3- and
4-byte subword of it (word edges included) names one of ``BUCKETS`` embedding rows. The mean of the rows
goes through a linear softmax. Both layers are trained by stochastic gradient descent in numpy on a
bounded sample; a temperature and a rejection threshold are then calibrated on a part of the sample held
back from training. Tasks get the embeddings, of fixed size, and a column of weights for each language.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.storage import materialize

from .exprs import bounded_batches

BUCKETS = 1 << 16
WIDTH = 16
#: Bounds of the training sample: rows in all (expected, shared evenly by language), the least for a language, and languages. A row is a whole text, as counts of ``BUCKETS`` buckets at most.
SAMPLE_ROWS, LEAST_ROWS, LANGUAGES = 6000, 20, 1000
EPOCHS, RATE, SEED = 6, 2.0, 7
#: Share of correct calibration rows that the threshold may reject.
REJECT = 0.002
UNKNOWN = "und"

_ASCII_LETTER = re.compile("[A-Za-z]")
_FIXED = np.arange(256, dtype=np.uint8)
_FIXED[[b for b in range(128) if not chr(b).isalpha()]] = 32


def has_letter(text: str) -> bool:
    """Whether a character is of a Unicode category of letters; number signs such as ``½`` or ``Ⅳ`` aren't."""
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


@cache
def _blank(char: str) -> bool:
    return char > "\x7f" and unicodedata.category(char)[0] not in "LM"


def subwords(text: str) -> np.ndarray:
    """Bucket numbers of all subwords of a text, repeats included."""
    if not text.isascii() and (blanks := [c for c in set(text) if _blank(c)]):
        text = text.translate({ord(c): " " for c in blanks})
    b = _FIXED[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    space = b == 32
    b = b[np.concatenate(([True], ~(space[1:] & space[:-1])))]
    x = b.astype(np.uint32)
    two = x[:-1] * np.uint32(257) + x[1:]
    three = two[:-1] * np.uint32(263) + x[2:]
    four = three[:-1] * np.uint32(269) + x[3:]
    grams = np.concatenate((two + np.uint32(1 << 20), three, four))
    return (grams * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray
    """(BUCKETS, WIDTH)"""
    weights: np.ndarray
    """(WIDTH, languages), at the calibrated temperature."""
    bias: np.ndarray
    threshold: float

    def mean(self, found: np.ndarray) -> np.ndarray:
        total, buffer = np.zeros(WIDTH), np.empty((4096, WIDTH), np.float32)
        for at in range(0, len(found), 4096):
            part = found[at : at + 4096]
            np.take(self.embeddings, part, axis=0, out=buffer[: len(part)], mode="clip")
            total += buffer[: len(part)].sum(axis=0, dtype=np.float64)
        return total / len(found)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected)."""
        if not self.languages or not text or not has_letter(text):
            return UNKNOWN, 0.0, True
        z = self.mean(subwords(text)) @ self.weights + self.bias
        p = np.exp(z - z.max())
        best = int(p.argmax())
        score = float(p[best] / p.sum())
        return self.languages[best], score, score < self.threshold


def counts(text: str) -> tuple[bytes, bytes]:
    """The buckets of a whole text's subwords (16 bits each) and how often each is met (32 bits)."""
    idx, n = np.unique(subwords(text), return_counts=True)
    return idx.astype("<u2").tobytes(), n.astype("<u4").tobytes()


def train(rows: list[tuple[str, tuple[bytes, bytes]]], seed: int = SEED) -> Model:
    """Fit (language, counts) rows; every fifth row calibrates temperature and threshold."""
    rng = np.random.default_rng(seed)
    found = [(np.frombuffer(idx, "<u2"), np.frombuffer(n, "<u4")) for _, (idx, n) in rows]
    labels = [lang for lang, _ in rows]
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, WIDTH), np.float32), np.zeros((WIDTH, 0)), np.zeros(0), 0.0)
    number = {lang: i for i, lang in enumerate(languages)}
    data = [(idx, n, number[lang]) for (idx, n), lang in zip(found, labels)]
    fit, held = [d for i, d in enumerate(data) if i % 5] or data, data[::5]
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            idx, n, y = fit[i]
            idx, w = idx.astype(np.int64), (n / n.sum()).astype(np.float32)
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = w @ emb[idx]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= rate * 0.1 * np.outer(hidden, p)
            bias -= rate * 0.01 * p
            emb[idx] -= (rate * w * len(idx))[:, None] * 0.1 * back
    scores = np.array([(n / n.sum()).astype(np.float32) @ emb[idx.astype(np.int64)] @ out + bias for idx, n, _ in held])
    labels = np.array([y for _, _, y in held])

    def loss(t: float) -> float:
        z = scores / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]).mean())

    temperature = min(np.geomspace(0.1, 10, 81), key=loss)
    p = np.exp((scores - scores.max(axis=1, keepdims=True)) / temperature)
    top = p.max(axis=1) / p.sum(axis=1)
    right = top[p.argmax(axis=1) == labels]
    threshold = min(0.5, float(np.quantile(right, REJECT))) if len(right) else 0.0
    return Model(languages, emb, (out / temperature).astype(np.float64), (bias / temperature).astype(np.float64), threshold)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on a bounded, seeded sample of labelled rows outside fold 0 of 5.

    The sample is drawn on the executors by a hash threshold for each language, which is its share of
    ``sample_rows`` (``LEAST_ROWS`` at least) over its count; every language (up to ``LANGUAGES``) is learned. Whole
    texts of any length are learned from: tasks count their subwords, and only counts of the sample reach
    the driver, of ``BUCKETS`` buckets a row at most. Null labels, null texts and texts without a letter
    aren't learned from. Rows that repeat an id, text and language are drawn once, however many they are,
    and at most ``LANGUAGES`` languages are learned, those with the most rows: the sample is bounded.
    """
    known = docs.select(fold(id_col, 5).alias("fold"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    known = known.filter("fold <> 0 and lang is not null and text is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    sizes = materialize(sizes, "languages")
    n = sizes.count()
    if not n:
        return train([])
    each = max(LEAST_ROWS, sample_rows / n)
    share = F.least(F.lit(1.0), F.lit(float(each)) / F.col("n"))
    drawn = known.join(sizes, "lang").filter(F.pmod("h", F.lit(1_000_000)) < 1_000_000 * share)
    rows = drawn.select("h", "lang", "text").dropDuplicates(["h", "lang"]).mapInArrow(_counted, "h bigint, lang string, idx binary, n binary")
    found = rows.toArrow()
    idx, n = ([v.as_buffer() for v in found.column(c)] for c in ("idx", "n"))
    drawn = sorted(zip(found.column("h").to_pylist(), found.column("lang").to_pylist(), zip(idx, n)), key=lambda r: r[:2])
    return train([r[1:] for r in drawn])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = [(h, lang, *counts(t)) for h, lang, t in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)) if has_letter(t)]
            yield pa.RecordBatch.from_pylist([dict(zip(("h", "lang", "idx", "n"), r)) for r in rows], pa.schema([("h", pa.int64()), ("lang", pa.string()), ("idx", pa.binary()), ("n", pa.binary())]))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [model.predict(t) for t in part.column(part.num_columns - 1).to_pylist()]
                added = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``held_out``, ``lang_pred``, ``score``, ``rejected``.

    Whole texts are read; only the text is an input of a prediction. A null text, or one without a
    letter, is ``und`` with score 0 and rejected; so is every text if nothing labelled could be
    learned. Other texts are rejected below the calibrated threshold. Repeated rows get equal answers,
    an empty table an empty result; further columns are not read.
    """
    bounded_batches(docs.sparkSession)
    model = model or fit(docs, id_col, text_col, lang_col)
    kept = docs.select(F.col(id_col).alias("id"), (fold(id_col, 5) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    found = kept.mapInArrow(_predict(model), f"id {kind}, held_out boolean, text string, lang_pred string, score double, rejected boolean")
    return found.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language is rejected, in one pass and without a shuffle."""
    bounded_batches(docs.sparkSession)
    model = model or fit(docs, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            yield batch.filter(pa.array([not model.predict(t)[2] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
