"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Only where that is unset and all tasks run in this process's machine, as in tests, it lies
    under a temporary folder; on a cluster each executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
        base = _own[context.applicationId]
    return f"{base.rstrip('/')}/utterflow/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written once as Parquet in the shared folder and read back.

    This cuts the lineage: a lost executor costs a reread, never a recomputation,
    and values that depend on partitioning stay as written.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what ``saved`` has cut off now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that ``saved`` returned, once everything that was made from it has been saved as well."""
    files = df.inputFiles()
    if files:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
