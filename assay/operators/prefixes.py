"""Prompts that share a prefix, grouped so that a scorer reads it once.

Distinct prompts are put in order by range partitions. What a prompt shares with the one before it, the
longest-common-prefix array, is found in one pass over each partition; partitions' borders are compared
by a join of their first and last prompts. A run goes on while neighbours share enough, and a group is a
slice of a run of bounded size, counted from the run's start: groups follow from the order of all prompts
alone and not from how they are dealt out. One row of numbers for each partition reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.storage import materialize, partitions

from .calibrate import PrefixScorer

#: Characters that neighbours share at least, and prompts of a group at most.
LEAST, LIMIT = 200, 8


def shared_chars(a: bytes, b: bytes) -> int:
    """Whole characters that two UTF-8 texts begin with alike."""
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    differ = x != y
    k = int(differ.argmax()) if differ.any() else n
    return int(((x[:k] & 0xC0) != 0x80).sum()) - bool(k < n and x[k] & 0xC0 == 0x80)


def _neighbours(prompt_at: int, least: int):
    """Batches with ``row`` in the partition, ``shared`` with the row before, ``start``: the last row, but the first, that shares too little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, last, start = 0, None, None
        for batch in batches:
            shared, starts = [], []
            for prompt in batch.column(prompt_at).cast(pa.binary()).to_pylist():
                shared.append(None if last is None else shared_chars(last, prompt))
                if last is not None and shared[-1] < least:
                    start = row + len(starts)
                starts.append(start)
                last = prompt
            rows = pa.array(np.arange(row, row + len(starts)))
            row += len(starts)
            yield pa.RecordBatch.from_arrays([*batch.columns, rows, pa.array(shared, pa.int64()), pa.array(starts, pa.int64())], [*batch.schema.names, "row", "shared", "start"])

    return run


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, last = (batch.column(i).cast(pa.binary()).to_pylist() for i in (1, 2))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared_chars(a, b) for a, b in zip(first, last)], pa.int64())], ["part", "shared"])


def shared_groups(views: DataFrame, least: int = LEAST, limit: int = LIMIT, prompt_col: str = "prompt") -> DataFrame:
    """Distinct ``views`` with ``at`` (their place in order), ``shared`` (characters in common with the one before), ``grp`` (the place of their group's first) and ``prefix`` (characters that all of the group begin with, always less than the shortest has).

    Rows without a prompt are left out. Views of one prompt that differ in other columns stand beside each
    other and share all of it. A group of one has prefix 0. An empty table gives no rows.
    """
    spark = views.sparkSession
    rest = [c for c in views.columns if c != prompt_col]
    kept = views.filter(F.col(prompt_col).isNotNull()).select(F.col(prompt_col).alias("prompt"), *rest).distinct()
    dealt = kept.repartitionByRange(partitions(spark), "prompt", *rest).sortWithinPartitions("prompt", *rest).withColumn("part", F.spark_partition_id())
    schema = T.StructType([*dealt.schema.fields, *[T.StructField(c, T.LongType()) for c in ("row", "shared", "start")]])
    rows = materialize(dealt.mapInArrow(_neighbours(0, least), schema), "prompts")

    ends = rows.groupBy("part").agg(F.count("*").alias("n"), F.max("start").alias("start")).orderBy("part").collect()  # a row for each partition
    after = spark.createDataFrame([(b["part"], a["part"], a["n"] - 1) for a, b in zip(ends, ends[1:])], "part int, before int, row bigint")
    last = rows.select(F.col("part").alias("before"), "row", F.col("prompt").alias("last")).join(F.broadcast(after), ["before", "row"])
    first = rows.filter("row = 0").select("part", F.col("prompt").alias("first"))
    border = {r["part"]: r["shared"] for r in first.join(last.select("part", "last"), "part").select("part", "first", "last").mapInArrow(_borders, "part int, shared bigint").collect()}

    placed, offset, run = [], 0, 0
    for r in ends:
        if border.get(r["part"], -1) < least:
            run = offset  # the partition's first row starts a run
        placed.append((r["part"], offset, run, border.get(r["part"], 0)))
        run = run if r["start"] is None else offset + r["start"]
        offset += r["n"]
    base = spark.createDataFrame(placed, "part int, offset bigint, run bigint, border bigint")
    rows = rows.join(F.broadcast(base), "part").withColumn("at", F.col("offset") + F.col("row"))
    begin = F.coalesce(F.col("offset") + F.col("start"), F.col("run"))
    group = (begin + F.floor((F.col("at") - begin) / limit) * limit).cast("bigint")
    rows = rows.select("prompt", *rest, "at", F.coalesce("shared", "border").alias("shared"), group.alias("grp"))
    inner = F.min(F.when(F.col("at") != F.col("grp"), F.col("shared")))
    sizes = rows.groupBy("grp").agg(F.coalesce(F.least(inner, F.min(F.length("prompt")) - 1), F.lit(0)).alias("prefix"), F.count("*").alias("members"))
    return rows.join(sizes.withColumn("prefix", F.when(F.col("members") > 1, F.col("prefix")).otherwise(0).cast("bigint")), "grp").withColumnRenamed("prompt", prompt_col)


def score_shared(views: DataFrame, scorer: PrefixScorer, least: int = LEAST, limit: int = LIMIT, prompt_col: str = "prompt", labels_col: str = "n_labels") -> DataFrame:
    """Distinct ``views`` with ``p``, each group's prefix read once. A view's result is the one it has alone, whatever its group."""
    spark = views.sparkSession
    names = [prompt_col, labels_col]
    groups = shared_groups(views.select(*names), least, limit, prompt_col).select(*names, "grp", "prefix", "at")
    dealt = groups.repartition(partitions(spark), "grp").sortWithinPartitions("grp", "at")
    schema = T.StructType([*views.select(*names).schema.fields, T.StructField("p", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state = None, None
        for pdf in batches:
            out = []
            for prompt, n, grp, prefix in zip(pdf[prompt_col], pdf[labels_col], pdf["grp"], pdf["prefix"]):
                if grp != group:  # a group may go on in the next batch
                    group, state = grp, scorer.begin(prompt[:prefix])
                out.append(scorer.finish(state, prompt[prefix:], n))
            yield pdf[names].assign(p=out)

    return dealt.select(*names, "grp", "prefix").mapInPandas(run, schema)
