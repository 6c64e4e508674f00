"""Event-time windows, for watching drift; batch and stream share the aggregation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.storage import new_path


def tumbling(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    out = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


def run_to_end(spark: SparkSession, path: str, late: str = "1 hour", files: int | None = None) -> DataFrame:
    """Stream a table through hourly windows under a watermark until all is read: (start, event_type, n).

    The stream itself aggregates: its state holds the windows that the watermark hasn't closed, and rows
    of a window that the batch before had already closed (its end more than ``late`` before the newest
    event seen until then) are dropped. Each batch writes the windows that it changed; the last state of each is returned. ``files``
    bounds the files of a batch.
    """
    schema = spark.read.parquet(path).schema
    out, state = new_path(spark, "windows"), new_path(spark, "windows-state")
    # a stream watches a folder: the table's own, or the one that holds its only file
    folder, name = (path, "*.parquet") if _is_folder(spark, path) else path.rsplit("/", 1)
    source = spark.readStream.schema(schema).option("pathGlobFilter", name)
    source = (source.option("maxFilesPerTrigger", files) if files else source).parquet(folder)
    held = source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)

    def add(batch: DataFrame, number: int) -> None:
        batch.select("start", "event_type", "n").write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = tumbling(held, "1 hour").writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", state).queryName(f"windows_{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
