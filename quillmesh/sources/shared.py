"""The folder that all executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new folder of this machine, if all tasks run on it; else an error, as
    executors would each write to a disk of their own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def kept_apart(df: DataFrame) -> DataFrame:
    """df, computed once, in the shared folder; what reads it doesn't compute it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of tables."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
