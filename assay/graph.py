"""Connected components of an edge table by alternating large-star and small-star steps.

Every step tells each edge the smallest neighbour of its end. Minima are combined on the map side. An end
with more edges than a quarter of an even partition is a hub: there are at most four of them for each
partition, so their minima are broadcast and their edges stay where they are, spread over all tasks; the
edges of all other ends meet their minima in an equi-join. Nothing but totals reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop_path, free_name, new_path, partitions

#: Hubs for each partition, at most.
HUBS = 4


def with_least(rows: DataFrame, key: str, value: str, name: str, n: int | None = None) -> DataFrame:
    """``rows`` with the least ``value`` of their ``key`` as ``name``, however many rows share a key; rows without a key have none and go.

    ``n`` is how many rows there are, about; it is counted if not given.
    """
    k, held = free_name(rows, "k", "held")
    n = rows.count() if n is None else n
    most = max(1, n // (HUBS * partitions(rows.sparkSession)))
    least = rows.groupBy(F.col(key).alias(k)).agg(F.min(value).alias(name), F.count("*").alias(held))
    hubs = F.broadcast(least.filter(F.col(held) > most).select(k, name))  # HUBS for each partition at most
    near = least.filter(F.col(held) <= most).select(k, name)
    marked = rows.join(hubs, F.col(key) == F.col(k), "left")
    heavy, light = marked.filter(F.col(k).isNotNull()).drop(k), marked.filter(F.col(k).isNull()).select(*rows.columns)
    return heavy.union(light.join(near, F.col(key) == F.col(k)).drop(k))


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = with_least(both, "u", "v", "least", 2 * n)
    return joined.filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = with_least(down, "u", "v", "m", n)
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = joined.select("u", F.col("m").alias("v"))
    return moved.union(kept).filter("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Component label of every node that has an edge.

    ``edges`` has two columns of one orderable type; loops and repeats are ignored, and rows with a
    null end are no edges. Returns ``(node, component)`` with the smallest node of the component as
    its label. An empty table gives an empty result. Both halves of a round are written, as each is read
    more than once.
    """
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    current = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    schema = current.schema

    def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
        path = new_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(schema).parquet(path), path

    last, kept = None, []
    for _ in range(max_rounds):
        held, path = written(current, "star")
        total = held.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        for old in kept:
            drop_path(spark, old)
        kept, done = [path], total == last
        if done or not total["n"]:
            break
        large, path = written(_large(held, total["n"]), "large")
        kept.append(path)
        last, current = total, _small(large, total["n"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = held.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(members.select(F.col("component").alias("node"), "component")).distinct()
