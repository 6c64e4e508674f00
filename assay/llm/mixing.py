"""Mixing sources to target weights by capped water-filling, with seeded repetitions.

A source's target is its weight's share of all words, but no more than ``max_epochs`` times what the
source has; the excess goes to the others by weight until none is above. A document is taken as often
as its source has whole epochs; for the rest, documents are taken once more in seeded hash order while
that brings the source's words nearer to its target. The hash is of id and text, so that rows without an
id, or that share one, are spread as others are. Nothing sorts a hot source: a histogram of ``BUCKETS``
hash buckets for each source finds the bucket in which its target falls, a second one the part of that
bucket, and only the rows of that part, a millionth of the source, are put in order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.storage import free_name, materialize, partitions

from .exprs import n_words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKETS = 4096
SEED = "mix"


def _key(id_col, text_col, seed: str):
    """The place of a row in its source's order: an MD5 in hexadecimal."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text_col.cast("string"), F.lit(""))))


def _part(key, level: int):
    """Three hexadecimal digits of the key: 0 to ``BUCKETS`` - 1."""
    return F.conv(F.substring(key, 3 * level + 1, 3), 16, 10).cast("int")


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources by code point, null last, numbered from 0 without gathering them in one task."""
    n = partitions(sources.sparkSession)
    order = F.col("source").asc_nulls_last()
    dealt = materialize(sources.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()), "sources")
    before, offsets = 0, []
    for part, rows in sorted((r["part"], r["rows"]) for r in dealt.groupBy("part").agg(F.count("*").alias("rows")).collect()):
        offsets.append((part, before))
        before += rows
    base = dealt.sparkSession.createDataFrame(offsets, "part int, base bigint")  # a row for each partition
    at = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return dealt.join(F.broadcast(base), "part").withColumn("number", F.col("base") + at - 1).drop("part", "base")


def fill_level(sources: DataFrame, total: int, max_epochs: float) -> float:
    """The level L at which the sum of min(max_epochs * size, L * weight) is the total; infinite if caps hold less."""
    level, clamped = 0.0, -1
    cap = F.col("source_size") * F.lit(max_epochs)
    while True:
        over = cap < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)).cast("double").alias("capped"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).cast("double").alias("free"),
            F.coalesce(F.sum(over.cast("int")), F.lit(0)).alias("n"),
        ).first()
        if row["n"] == clamped:
            return level
        if not row["free"]:
            return math.inf
        clamped, level = row["n"], (total - row["capped"]) / row["free"]


def _cut(held: DataFrame, goals: DataFrame, name: str) -> DataFrame:
    """(own, goal, name): the first bucket that its source's goal doesn't hold whole, and what is left of the goal there."""
    order = Window.partitionBy("source").orderBy("bucket")  # at most BUCKETS rows for each source
    reached = F.coalesce(F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    beside = held.withColumn("before", reached).join(goals, F.col("source").eqNullSafe(F.col("own")))
    over = beside.filter(F.col("before") + F.col("held") > F.col("goal"))
    return over.groupBy("own").agg(F.min_by(F.struct(F.col("bucket").alias(name), (F.col("goal") - F.col("before")).alias("goal")), "bucket").alias("at")).select("own", "at.*")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(sized, sources): (id, source, size, key) of every row; (source, source_size, weight, target, whole, one, two, goal) of every source.

    A document of the source is taken ``whole`` times, and once more if the first two parts of its key are
    before (``one``, ``two``), or are these and ``goal`` words hold it. Nothing is before a null ``one``.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), _key(F.col(id_col), F.col(text_col), seed).alias("key"))
    sized = materialize(sized, "sized")
    buckets = materialize(sized.groupBy("source", _part(F.col("key"), 0).alias("bucket")).agg(F.sum("size").alias("held")), "buckets")
    sources = _numbered(buckets.groupBy("source").agg(F.sum("held").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    sources = materialize(sources.withColumn("weight", weight), "weights")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    level = fill_level(sources, total, max_epochs)
    target = F.least(F.col("source_size") * F.lit(float(max_epochs)), F.lit(level) * F.col("weight"))
    size = F.greatest("source_size", F.lit(1))
    sources = sources.withColumn("target", target).withColumn("whole", F.least(F.floor(F.col("target") / size), F.lit(max_epochs)).cast("bigint"))
    goals = sources.select(F.col("source").alias("own"), (F.col("target") - F.col("whole") * F.col("source_size")).alias("goal"))
    first = materialize(_cut(buckets, goals, "one"), "cuts")
    inside = sized.join(first.select(F.col("own").alias("of"), "one"), F.col("source").eqNullSafe(F.col("of")) & (_part(F.col("key"), 0) == F.col("one")))
    second = _cut(inside.groupBy("source", _part(F.col("key"), 1).alias("bucket")).agg(F.sum("size").alias("held")), first.select("own", "goal"), "two")
    both = first.select(F.col("own").alias("of"), "one").join(second, F.col("of").eqNullSafe(F.col("own")), "left").drop("own")
    whole = sources.join(both, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", "weight", "target", "whole", "one", "two", "goal")
    return sized, materialize(whole, "mixplan")


def _times(rows: DataFrame, source: str, size, key, names: dict[str, str], times: str) -> DataFrame:
    """``rows`` joined with their source's plan (columns ``names``), with ``times``, how often each is taken."""
    one, two, goal, whole = (F.col(names[n]) for n in ("one", "two", "goal", "whole"))
    a, b = _part(key, 0), _part(key, 1)
    # a source whose goal holds every row of its part has no part to put in order
    here = F.coalesce((a == one) & (b == two), F.lit(False))
    more = F.coalesce((a < one) | (a == one) & (b < F.coalesce(two, F.lit(BUCKETS))), F.lit(False))
    clear = rows.filter(~here).withColumn(times, (whole + more.cast("bigint")).cast("bigint"))
    order = Window.partitionBy(source).orderBy(key)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = rows.filter(here).withColumn(times, (whole + (2 * before + size <= 2 * goal).cast("bigint")).cast("bigint"))
    return clear.unionByName(cut)


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``size``, ``source_size``, ``target``, ``taken``.

    A null text has size 0; null sources form one source, the last; a source without words has target
    0 and takes nothing. Rows that repeat id and text may be taken differently often: which of them is
    left open, as they are alike. Reruns with the same seed agree. Very long texts count whole, so a
    source's words miss its target by half a text at most. An empty table gives an empty result; further
    columns are not read.
    """
    sized, sources = plan(docs, id_col, text_col, source_col, **how)
    found = sized.join(sources.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")))
    names = {n: n for n in ("one", "two", "goal", "whole")}
    found = _times(found, "source", F.col("size"), F.col("key"), names, "times")
    return found.select(F.col("id").alias(id_col), "size", "source_size", F.round("target", 6).alias("target"), (F.col("times") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, columns unchanged. Texts are not shuffled, but for those at a source's cut."""
    _, sources = plan(docs, id_col, text_col, source_col, seed=seed, **how)
    own, key, times, size, *rest = free_name(docs, "own", "key", "times", "size", "one", "two", "goal", "whole")
    names = dict(zip(("one", "two", "goal", "whole"), rest))
    chosen = sources.select(F.col("source").alias(own), *[F.col(n).alias(c) for n, c in names.items()])
    keyed = docs.withColumn(key, _key(F.col(id_col), F.col(text_col), seed))
    found = keyed.join(chosen, keyed[source_col].eqNullSafe(F.col(own)))
    found = _times(found.withColumn(size, n_words(F.col(text_col))), own, F.col(size), F.col(key), names, times)
    return found.withColumn(times, F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))).drop(own, key, times, size, *rest)
