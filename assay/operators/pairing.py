"""Joins of runs, keys and artifacts, with the completeness checks that make them safe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import prob


def checked(condition, message: str, value):
    """``value``, or a failed job with the message where the condition doesn't hold."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def pair_runs(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """Two runs by id. Ids must be the same on both sides, and so must label, primitive, group, target and the number of answers; vectors must be valid."""
    a = first.withColumn("_a", F.lit(True))
    b = second.select(F.col(key), F.col("p").alias("q"), F.col("t").alias("t_q"), F.col("label").alias("label_q"), F.col("predicted").alias("predicted_q"), F.col("correct").alias("correct_q"), F.col("primitive").alias("primitive_q"), F.col("group_id").alias("group_q"), F.lit(True).alias("_b"))
    both = a.join(b, key, "full")
    same = F.col("_a") & F.col("_b") & (F.col("label") == F.col("label_q")) & (F.col("primitive") == F.col("primitive_q")) & (F.col("group_id") == F.col("group_q"))
    same &= (F.col("t") == F.col("t_q")) & (F.size("p") == F.size("q")) & prob.valid_vector(F.col("p")) & prob.valid_vector(F.col("q"))
    return both.withColumn("label", checked(F.coalesce(same, F.lit(False)), "runs do not hold the same examples", F.col("label"))).drop("_a", "_b", "label_q", "primitive_q", "group_q")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Equi-join in which every key must occur exactly once on both sides."""
    counted = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    bad = counted(left, "l").join(counted(right, "r"), key, "full").filter("l is null or r is null or l > 1 or r > 1")
    if bad.limit(1).count():
        raise ValueError(f"{key} does not match one to one")
    return left.join(right, key)


def leakage_edges(rows: DataFrame, id_col: str, *keys: str) -> DataFrame:
    """(id, key): a row for each non-null leakage key of an example."""
    return rows.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.col(k) for k in keys])).alias("key")).filter("key is not null").distinct()


def without_overlap(rows: DataFrame, edges: DataFrame, reference_keys: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows none of whose keys is in the reference set."""
    leaked = edges.join(reference_keys.select("key").distinct(), "key", "left_semi").select(F.col("id").alias(id_col)).distinct()
    return rows.join(leaked, id_col, "left_anti")


def crossing_keys(edges: DataFrame) -> DataFrame:
    """(key, splits): keys that occur in more than one split; empty if the splits are disjoint."""
    return edges.groupBy("key").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def same_ids(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """One row: ids on one side only, for each side."""
    a, b = first.select(key).distinct().withColumn("a", F.lit(1)), second.select(key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full").agg(F.count_if(F.isnull("b")).alias("only_first"), F.count_if(F.isnull("a")).alias("only_second"))


def with_temperature(rows: DataFrame, fits: DataFrame, workload_fits: DataFrame | None = None) -> DataFrame:
    """Rows with ``temperature``: the workload's own fit, else the global one of the primitive, else 1."""
    out = rows.join(fits.select("primitive", F.col("temperature").alias("global_t")), "primitive", "left")
    own = F.lit(None).cast("double")
    if workload_fits is not None:
        out = out.join(workload_fits.select("workload", "primitive", F.col("temperature").alias("own_t")), ["workload", "primitive"], "left")
        own = F.col("own_t")
    return out.withColumn("temperature", F.coalesce(own, F.col("global_t"), F.lit(1.0))).drop("global_t", "own_t")


def unseen(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Resume: rows whose key hasn't been handled."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
