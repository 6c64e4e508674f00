"""Column expressions that the native operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.storage import _BATCH_BYTES, bounded_batches

#: The white space that parts words, and a word.
SPACES = " \t\n\u000b\f\r"
GAP = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` computed once for each row: lambdas would compute an inlined column for each element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; an empty array for a null text or one of white space."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def id_or_default(docs: DataFrame, id_col: str) -> Column:
    """The id, or a fixed value of its type where it is null; a null is told from that value by a flag beside it."""
    kind = docs.schema[id_col].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        least = F.lit("").cast(kind)
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        least = F.lit("1970-01-01").cast(kind)
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        least = F.lit(0).cast(kind)
    else:
        raise TypeError(f"ids are numbers, texts, binary or times, not {kind.simpleString()}")
    return F.coalesce(F.col(id_col), least)


def md5_number(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of an MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


@contextmanager
def held_batches(spark: SparkSession) -> Iterator[None]:
    """``bounded_batches`` for what runs inside; the session's own setting comes back."""
    before = spark.conf.get(_BATCH_BYTES)
    bounded_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)
