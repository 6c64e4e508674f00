"""Sinks: never overwrite, staged by Spark's commit protocol, with a manifest; append-and-resume by id."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators.pairing import unseen

from .readers import file_hashes

#: Lines of one file at most: a file is hashed whole, in one task.
FILE_LINES = 100_000


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A small file on any Hadoop file system; fails if it exists."""
    p, fs = _path(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def write_dataset(partitions: dict[str, DataFrame], path: str, about: dict | None = None) -> dict:
    """Each partition as JSON lines under ``path``, then ``manifest.json`` with counts and hashes.

    Fails before writing if the path exists. A data set without its manifest is an incomplete one.
    """
    spark = next(iter(partitions.values())).sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    manifest = {"about": about or {}, "partitions": {}}
    for name, df in partitions.items():
        df.orderBy("id").write.option("maxRecordsPerFile", FILE_LINES).mode("errorifexists").json(f"{path}/{name}")
        files = file_hashes(spark, f"{path}/{name}/part-*").orderBy("file").collect()
        manifest["partitions"][name] = {"records": df.count(), "files": {r["file"]: r["sha256"] for r in files}}
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, indent=1, sort_keys=True))
    return manifest


def write_run(predictions: DataFrame, report: DataFrame, path: str, run: str) -> None:
    """Predictions partitioned by run, then the report; a run without a report is incomplete."""
    predictions.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{path}/predictions")
    report.coalesce(1).write.mode("errorifexists").json(f"{path}/reports/{run}")


def append_unseen(rows: DataFrame, path: str, key: str = "id") -> int:
    """Append the rows whose key the sink doesn't hold yet; the number appended. Safe to run again."""
    spark = rows.sparkSession
    fresh = unseen(rows, spark.read.parquet(path), key) if exists(spark, path) else rows
    fresh = fresh.dropDuplicates([key])
    before = spark.read.parquet(path).count() if exists(spark, path) else 0
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def write_by_regime(rows: DataFrame, path: str) -> None:
    """Matched target regimes side by side."""
    rows.write.mode("errorifexists").partitionBy("regime").json(path)


def markdown_pivot(rows: DataFrame, index: str) -> str:
    """A small table as Markdown; for reports of a few rows, so that more than 1,000 are refused."""
    held = rows.orderBy(index).limit(1001).collect()
    if len(held) > 1000:
        raise ValueError("a report holds at most 1,000 rows")
    columns = [index, *[c for c in rows.columns if c != index]]
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in held]
    return "\n".join(lines)
