"""Seeded order, samples and resamples by hash; nothing depends on partitions or on a random state."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions import prob
from assay.graph import with_least
from assay.storage import free_name, materialize, partitions


def seeded(seed: str, *parts: Column | str) -> Column:
    """SHA-256 of seed and parts joined by colons: the pseudo-random order of all sampling here."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts]), 256)


def sample_n(rows: DataFrame, id_col: str, n: int, seed: str = "42") -> DataFrame:
    """The first ``n`` rows in seeded order (a top-n in each task, then one of those)."""
    return rows.orderBy(seeded(seed, id_col), id_col).limit(n)


def quota(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group. The rank filter sits on the window, so each task passes on ``n`` rows at most."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def disjoint_quota(rows: DataFrame, by: list[str], id_col: str, keys: str, n: int, seed: str = "42") -> DataFrame:
    """The first ``n`` rows of each group in seeded order that share none of their ``keys`` (an array) with a row picked before.

    Groups follow each other in order. Whether a row is picked depends on all before it, so the choice is
    made on the driver, over a multiple of ``n`` rows of each group, which doubles while a group that has
    more rows is short: the groups are few and named, and rows come as ids and keys only.
    """
    order = [seeded(seed, id_col), F.col(id_col)]
    many = 4 * n
    while True:
        first = quota(rows.select(*by, id_col, keys), by, order, many).withColumn("_h", seeded(seed, id_col)).collect()
        groups: dict[tuple, list] = {}
        for r in first:
            groups.setdefault(tuple(r[c] for c in by), []).append((r["_h"], r[id_col], r[keys] or []))
        seen, picked, short = set(), [], False
        for group in sorted(groups, key=repr):
            found = 0
            for _, name, own in sorted(groups[group], key=lambda x: (x[0], str(x[1]))):
                if found < n and seen.isdisjoint(own):
                    picked.append((name,))
                    seen.update(own)
                    found += 1
            short |= found < n and len(groups[group]) == many
        if not short:
            chosen = rows.sparkSession.createDataFrame(picked, rows.select(id_col).schema)
            return rows.join(F.broadcast(chosen), id_col, "left_semi")  # n rows for each group
        many *= 2


def sample_k(rows: DataFrame, by: list[str], id_col: str, k: int, repeats: int, seed: str = "42") -> DataFrame:
    """``repeats`` samples of ``k`` rows for each group, as rows with the sample's number ``r``: the first in seeded order.

    Hashes are even, so a sample's rows have hashes below about k / n of their range. A row is copied only
    into samples in which it stands below that and some slack; what is sorted is little more than the
    samples themselves. Should a sample be short of rows, which slack makes next to impossible, all
    are drawn again with four times the slack.
    """
    cut, least, drawn = free_name(rows, "_cut", "_least", "_drawn")
    names = free_name(rows, *[f"_by{i}" for i in range(len(by))])
    sizes = materialize(rows.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names)]).agg(F.count("*").alias(least)), "sizes")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)])
    n_groups, slack = sizes.count(), 8.0
    while True:
        share = F.lit(k + slack * math.sqrt(k) + slack) / F.col(least)
        below = F.when(share >= 1, "g").otherwise(F.lower(F.lpad(F.hex((share * 2**48).cast("bigint")), 12, "0")))  # 'g': beyond all digits
        held = rows.join(sizes.select(*names, F.least(F.col(least), F.lit(k)).alias(least), below.alias(cut)), same).drop(*names)
        hashes = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: F.struct(r.alias("r"), seeded(seed, *by, r, id_col).alias("h")))
        near = F.filter(hashes, lambda d: F.substring(d["h"], 1, 12) < F.col(cut))
        found = materialize(held.withColumn(drawn, F.explode(near)).withColumn("r", F.col(drawn)["r"]).withColumn(drawn, F.col(drawn)["h"]).drop(cut), "drawn")
        whole = found.groupBy(*by, "r").agg(F.count("*").alias("n"), F.first(least).alias("least")).filter("n >= least")
        if whole.count() == n_groups * repeats:
            return quota(found, [*by, "r"], [F.col(drawn), F.col(id_col)], k).drop(drawn, least)
        slack *= 4


def paired_deltas(pair: DataFrame) -> DataFrame:
    """(group_id, n, d_acc, d_nll, d_brier): sums of second minus first within each group."""
    p, q, t, label = F.col("p"), F.col("q"), F.col("t"), F.col("label")
    return pair.groupBy("group_id").agg(
        F.count("*").alias("n"),
        F.sum(F.col("correct_q").cast("bigint") - F.col("correct").cast("bigint")).alias("d_acc"),
        F.sum(prob.nll_clip(q, label) - prob.nll_clip(p, label)).alias("d_nll"),
        F.sum(prob.brier(q, t) - prob.brier(p, t)).alias("d_brier"),
    )


def consecutive(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` numbered from 0 in the order of ``by``: range partitions, each numbered from where the one before ends."""
    spark = rows.sparkSession
    dealt = materialize(rows.repartitionByRange(partitions(spark), by).withColumn("_part", F.spark_partition_id()), "numbered")
    before, offsets = 0, []
    for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row for each partition
        offsets.append((r["_part"], before))
        before += r["n"]
    base = spark.createDataFrame(offsets, "_part int, _base bigint")
    at = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return dealt.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + at).drop("_part", "_base")


def numbered(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """``rows`` numbered from 0 within each value of ``by``, in ``order``: numbers of the whole table less the group's first, so that no group is in one task. Rows without ``by`` go."""
    (key,) = free_name(rows, "_key")
    at = consecutive(rows.filter(F.col(by).isNotNull()).withColumn(key, F.struct(by, *order)), key, name).drop(key)
    (first,) = free_name(at, "_first")
    return with_least(materialize(at, "placed"), by, name, first).withColumn(name, F.col(name) - F.col(first)).drop(first)


def poisson_cuts() -> list[int]:
    """How many of the 65,536 values of a draw give less than 1, 2, ...: the distribution of Poisson(1), rounded."""
    cuts, term, below = [], math.exp(-1), 0.0
    while not cuts or cuts[-1] < 1 << 16:
        below += term
        cuts.append(round(below * (1 << 16)))
        term /= len(cuts)
    return cuts[:-1]


#: Draws that one SHA-256 gives, of 16 bits each, and groups whose weights are held at once.
DRAWS, HELD = 16, 512


def _weighted_sums(samples: int, seed: str):
    weight = np.searchsorted(np.array(poisson_cuts()), np.arange(1 << 16), side="right").astype(np.float64)
    blocks = -(-samples // DRAWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((samples, 4))
        for batch in batches:
            names, values = batch.column(0).to_pylist(), np.column_stack([batch.column(i).to_numpy() for i in range(1, 5)]).astype(np.float64)
            for at in range(0, len(names), HELD):
                raw = b"".join(hashlib.sha256(f"{seed}:{name}:{b}".encode()).digest() for name in names[at : at + HELD] for b in range(blocks))
                drawn = np.frombuffer(raw, ">u2").reshape(-1, blocks * DRAWS)[:, :samples]
                sums += weight[drawn].T @ values[at : at + HELD]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples)), *[pa.array(c) for c in np.ascontiguousarray(sums.T)]], ["r", "n", "acc", "nll", "brier"])

    return run


def bootstrap(deltas: DataFrame, samples: int = 2000, seed: str = "42") -> DataFrame:
    """(metric, low, high, excludes_zero): 95% intervals over resampled groups.

    Each group counts in each resample as often as a Poisson(1) draw says, which is what drawing as many
    groups as there are with replacement comes to when they are many. The draw is 16 bits of the SHA-256 of
    seed, group and resample, so it depends on no other group: groups are neither numbered nor joined,
    a task adds up its own groups into sums of all resamples, and only those are shuffled. Resamples
    without a group are left out.
    """
    sums = ["n", "acc", "nll", "brier"]
    rows = deltas.select(F.coalesce(F.col("group_id").cast("string"), F.lit("")).alias("name"), "n", "d_acc", "d_nll", "d_brier")
    parts = rows.mapInArrow(_weighted_sums(samples, seed), "r bigint, n double, acc double, nll double, brier double")
    each = parts.groupBy("r").agg(*[F.sum(c).alias(c) for c in sums]).filter("n > 0")
    long = each.selectExpr("stack(3, 'acc', acc / n, 'nll', nll / n, 'brier', brier / n) as (metric, v)")
    out = long.groupBy("metric").agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))
    return out.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, shortest, upper_median, longest) from counts of distinct values, so a hot group sends counts only."""
    cells = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(value)
    cells = cells.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    inside = F.col("upto") > F.floor(F.col("all") / 2)
    return cells.groupBy(by).agg(F.min(value).cast("bigint").alias("shortest"), F.min(F.when(inside, F.col(value))).cast("bigint").alias("upper_median"), F.max(value).cast("bigint").alias("longest"))
