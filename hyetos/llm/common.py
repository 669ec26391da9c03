"""Small helpers shared by the text operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The ASCII white space that separates words: tab, line feed, vertical tab, form feed, carriage return and space.
SPACES = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the cluster names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hyetos-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder on any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(table: DataFrame) -> None:
    """Delete a table of `written` that nothing will read again."""
    files = table.inputFiles()
    if files:
        remove(table.sparkSession, files[0].rpartition("/")[0])


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(name: str) -> str:
    """A folder name that no other run has."""
    return f"{name}-{uuid.uuid4().hex}"


def files_at(uri: str) -> tuple[FileSystem, str]:
    """The file system of a URI for tasks that read or write bytes themselves, and the path in it; a bare path is a local one."""
    if re.match("file:/|/", uri):
        return LocalFileSystem(), re.sub("^file:/+", "/", uri)
    return FileSystem.from_uri(uri)


def kept(df: DataFrame, name: str, *spent: DataFrame) -> DataFrame:
    """`written`, after which the spent tables are deleted and Spark may delete the files of finished shuffles."""
    out = written(df, name)
    for x in spent:
        discard(x)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def once(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often `use` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
