"""Folders on any file system that Spark knows."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only under a local master where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hyetos-"))
    return spark.sparkContext.getCheckpointDir()


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _at(spark, path)
    return files.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    files, where = _at(spark, path)
    files.delete(where, True)


def publish(spark: SparkSession, made: str, path: str) -> bool:
    """Give a finished folder its name, in one step; False if another run was first (the folder stays where it is)."""
    files, where = _at(spark, path)
    if files.exists(where):
        return False
    files.mkdirs(where.getParent())
    return files.rename(_at(spark, made)[1], where) and not files.exists(_at(spark, f"{path}/{made.rpartition('/')[2]}")[1])
