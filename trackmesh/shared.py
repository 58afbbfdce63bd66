"""The folder that driver and executors share, and tables written there once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session (one machine, as in tests) has a folder of its own; on a
    cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.conf.get("spark.master", "").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (root or "file:///tmp/checkpoints").rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_written: list[str] = []


def written() -> list[str]:
    """The paths of the tables that this process has written by write_once, in order."""
    return list(_written)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _written.remove(path)


def write_once(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that later branches neither recompute it nor depend on an
    executor's disk."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
