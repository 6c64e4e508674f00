"""Working tables in the folder that every executor shares.

The folder is ``spark.checkpoint.dir`` of the session; only where that is unset and the master is local
(tests, a laptop) a temporary folder of this process is used. On a cluster an unset folder is an error:
executors would write to disks of their own. A working table is a written Parquet table: it cuts the
lineage, survives the loss of executors, and gives the next plan true sizes.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="assay-")


def shared_folder(spark: SparkSession) -> str:
    """The shared working folder of the session, without a trailing slash."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = existing.get() if existing.isDefined() else None
    if not configured and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (configured or _own_folder()).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no earlier call has returned."""
    return f"{shared_folder(spark)}/assay/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a working table through Hadoop's file system, wherever it lives."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are gone; else they stay until the driver's JVM happens to collect its garbage.

    The plan that was run last is let go by what the first collection ends, so its files go with the second.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    """How many partitions a deliberate shuffle makes: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, for whole texts: the default holds 64 MB on both sides of each Python worker."""
    if spark.conf.get(_BATCH_BYTES) == "67108864b":  # the default; what a user has set stays
        spark.conf.set(_BATCH_BYTES, "4m")


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of ``df`` (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
