"""Folders that every executor reaches, and checkpoints in them."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of one's own where that is unset in local mode."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="idledger-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/idledger-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> bool:
    """Delete what this application wrote with shared_path. Results that were not stored yet can no longer be computed.

    Checkpoints are Spark's own; spark.cleaner.referenceTracking.cleanCheckpoints removes those out of use.
    """
    return delete(spark, scratch(spark))


def materialised(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder; later reads survive the loss of an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffles and checkpoints that no DataFrame in use needs any more: it does so once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
