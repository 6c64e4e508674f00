"""Versions in force: each event meets the last version of its key that was registered before it.

Events and versions are put in one order by key and time, by range partitions, so that a key with a third of
all events is spread over many tasks. The last version is carried along within a partition, and from its
end into the next ones: a row for each partition reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.storage import materialize, partitions


def admitted(versions: DataFrame, most: int, key: str = "workload", at: str = "ts") -> DataFrame:
    """Versions of the first ``most`` keys, by the time of their first version, then by key; later keys find the registry full."""
    first = versions.groupBy(key).agg(F.min(at).alias("_first")).orderBy("_first", key).limit(most)
    return versions.join(F.broadcast(first.select(key)), key, "left_semi")  # ``most`` rows


def in_force(events: DataFrame, versions: DataFrame, key: str = "workload", at: str = "ts", version: str = "version") -> DataFrame:
    """``events`` with ``version``: of the versions of their key registered at their time or before, the last; null without any.

    Of versions of one key and time the largest is in force. Events and versions without key or time meet nothing;
    such events come back with null. Columns of ``events`` stay as they are.
    """
    spark = events.sparkSession
    fine = lambda df: df.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    held = F.struct(*[F.col(c) for c in events.columns])
    kind = versions.schema[version].dataType
    asked = fine(events).select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(kind).alias("v"), held.alias("e"), F.monotonically_increasing_id().alias("m"))
    told = fine(versions).select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(0).alias("side"), F.col(version).alias("v"), F.lit(None).cast(asked.schema["e"].dataType).alias("e"), F.lit(0).cast("bigint").alias("m"))
    order = ["k", "t", "side", "v", "m"]  # a version comes before the events of its time; ``m`` parts events that are alike
    dealt = materialize(asked.unionByName(told).repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "merged")
    last = dealt.filter("side = 0").groupBy("part").agg(F.max(F.struct("k", "t", "v")).alias("l"))
    carried = materialize(last.select("part", "l.k", "l.v"), "carried").orderBy("part").collect()  # a row for each partition
    into, now = [], (None, None)
    by_part = {r["part"]: (r["k"], r["v"]) for r in carried}
    for part in range(max([r["part"] for r in dealt.select("part").distinct().collect()], default=-1) + 1):
        into.append((part, *now))
        now = by_part.get(part, now)
    base = spark.createDataFrame(into, dealt.select("part", F.col("k").alias("bk"), F.col("v").alias("bv")).schema)
    near = F.last(F.when(F.col("side") == 0, F.struct("k", "v")), ignorenulls=True).over(Window.partitionBy("part").orderBy(*order))
    found = dealt.withColumn("near", near).join(F.broadcast(base), "part").filter("side = 1")
    of_key = F.when(F.col("near.k") == F.col("k"), F.col("near.v")).when(F.col("near").isNull() & (F.col("bk") == F.col("k")), F.col("bv"))
    met = found.select(*[F.col(f"e.`{c}`").alias(c) for c in events.columns], of_key.alias(version))
    rest = events.filter(F.col(key).isNull() | F.col(at).isNull()).withColumn(version, F.lit(None).cast(kind))
    return met.unionByName(rest)
