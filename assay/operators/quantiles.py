"""Exact quantiles by selection: four histogram passes over the ordered bits of the values.

A double's bits, turned so that they order as the values do, are read sixteen at a time. A pass counts the
next sixteen bits of the values that share the bits found so far, and the cumulated counts tell where each
wanted rank goes on. A task holds at most 65,536 counts for each group and rank; values are never sorted or
gathered, however many a group has and however many of them are distinct.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.storage import materialize

_SIGN, _REST = np.int64(-(1 << 63)), np.int64((1 << 63) - 1)
#: Bits of a pass; the sign bit as a signed number.
DIGIT = 16


@F.pandas_udf(T.LongType())
def ordered_bits(values: pd.Series) -> pd.Series:
    """Bits that order, as unsigned numbers, as the values do; zeros are one value, and NaN is beyond all others."""
    x = values.to_numpy(np.float64) + 0.0
    bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
    return pd.Series(bits ^ np.where(bits < 0, np.int64(-1), _SIGN))


@F.pandas_udf(T.DoubleType())
def from_bits(bits: pd.Series) -> pd.Series:
    raw = bits.to_numpy(np.int64)
    return pd.Series((raw ^ np.where(raw < 0, _SIGN, np.int64(-1))).view(np.float64))


def _leading(bits: int) -> Column:
    """The first so many bits of a value."""
    return F.lit(0).cast("bigint") if not bits else F.shiftrightunsigned("u", 64 - bits)


def exact_percentiles(rows: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """(by, share, value): the quantile of each group at each share from 0 to 1, interpolated between neighbours.

    Null values, and rows without a group, don't count; a group without values has no rows. Each share is given once.
    """
    held = materialize(rows.filter(F.col(value).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("g"), ordered_bits(F.col(value).cast("double")).alias("u")), "bits")
    place = F.col("share") * (F.col("size") - 1)
    wanted = held.groupBy("g").agg(F.count("*").alias("size")).select("g", "size", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    wanted = materialize(wanted.select("g", "share", F.floor(place).alias("low"), (place - F.floor(place)).alias("part"), F.ceil(place).alias("high")), "wanted")
    ranks = wanted.select("g", F.explode(F.array("low", "high")).alias("rank")).distinct().withColumns({"own": F.lit(0).cast("bigint"), "before": F.lit(0).cast("bigint")})
    for bits in range(0, 64, DIGIT):
        asked = ranks.select("g", "own").distinct()
        cells = held.select("g", _leading(bits).alias("own"), _leading(bits + DIGIT).alias("next")).join(asked, ["g", "own"]).groupBy("g", "own", "next").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("g", "own").orderBy(F.col("next").bitwiseAND(F.lit((1 << DIGIT) - 1))))
        cells = cells.withColumn("upto", upto)
        inside = (F.col("rank") >= F.col("before") + F.col("upto") - F.col("n")) & (F.col("rank") < F.col("before") + F.col("upto"))
        found = ranks.join(cells, ["g", "own"]).filter(inside)
        ranks = materialize(found.select("g", "rank", F.col("next").alias("own"), (F.col("before") + F.col("upto") - F.col("n")).alias("before")), "ranks")
    values = ranks.select("g", "rank", from_bits("own").alias("v"))
    at = lambda name: values.select("g", F.col("rank").alias(name), F.col("v").alias(f"{name}_v"))
    both = wanted.join(at("low"), ["g", "low"]).join(at("high"), ["g", "high"])
    mixed = F.when(F.col("part") == 0, F.col("low_v")).otherwise(F.col("low_v") + (F.col("high_v") - F.col("low_v")) * F.col("part"))
    return both.select(F.col("g").alias(by), "share", mixed.alias("value"))
