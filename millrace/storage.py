"""Intermediate tables in the folder that driver and executors share.

Long jobs cut their lineage by writing a table and reading it back, so a lost
executor costs a few tasks and never a whole history.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: ``spark.checkpoint.dir``, or for a local master without it a fresh temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _LOCAL_DIRS[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new, empty shared folder, deleted at the end of the driver."""
    path = fresh_path(spark, tag)
    target, files = _files(spark, path)
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path


class Table:
    """A written DataFrame: ``df`` reads it back, ``drop()`` deletes it, as does the end of the driver."""

    def __init__(self, spark: SparkSession, df: DataFrame, tag: str):
        self.spark, self.path, schema = spark, fresh_path(spark, tag), df.schema
        df.write.parquet(self.path)
        target, files = _files(spark, self.path)
        files.deleteOnExit(target)
        self.df = spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def _files(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    target, files = _files(spark, path)
    files.delete(target, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Let Python and the driver's JVM notice what is no longer used, so that shuffle files of finished steps are deleted."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
