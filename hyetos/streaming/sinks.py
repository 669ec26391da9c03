"""A keyed table that a stream upserts, and that a repeated batch leaves as it is.

The table is a folder with a version of each touched partition for each epoch. An epoch reads the versions before it,
replaces rows with the same keys, and writes whole new versions of the partitions that it touches; only then its commit is
marked. Readers see, of each partition, the last version up to the last commit. An epoch that was broken off leaves
versions that nobody reads; when the stream repeats it, they are written over, from the same earlier versions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyetos.sources import folders

PART, EPOCH = "__part", "__epoch"


def _committed(spark: SparkSession, path: str) -> int:
    """The last epoch that is marked as complete; -1 before the first."""
    marks = f"{path}/commits"
    return spark.read.parquet(marks).agg(F.max("epoch")).first()[0] if folders.exists(spark, marks) else -1


def _versions(spark: SparkSession, path: str, upto: int) -> DataFrame:
    """The rows of each partition's last version up to an epoch, with the partition."""
    every = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data").filter(F.col(EPOCH) <= upto)
    last = every.groupBy(PART).agg(F.max(EPOCH).alias(EPOCH))
    return every.join(last, [PART, EPOCH], "left_semi").drop(EPOCH)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the last commit."""
    done = _committed(spark, path)
    if done < 0:
        raise ValueError(f"{path} has no commit yet")
    return _versions(spark, path, done).drop(PART)


def upsert(path: str, keys: Sequence[str], order: str | None = None, partitions: int = 32, before_commit: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: rows replace those with the same keys. Of rows with the same keys in a batch the last by `order` stays, else any.

    Keys are dealt by hash over `partitions`, which must not change over a table's life. `before_commit` is called between writing and commit.
    """
    keys = list(keys)

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        done = _committed(spark, path)
        if epoch <= done:
            return
        own = W.partitionBy(*keys).orderBy(F.desc_nulls_last(order) if order else F.lit(0))
        new = batch.withColumn("__n", F.row_number().over(own)).filter("__n = 1").drop("__n").withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(partitions)).cast("int"))
        if done >= 0:
            touched = new.select(PART).distinct()
            old = _versions(spark, path, done).join(touched, PART, "left_semi")
            same = [old[k].eqNullSafe(new[k]) for k in keys]
            new = old.join(new, same, "left_anti").unionByName(new)
        new.withColumn(EPOCH, F.lit(epoch)).repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART, EPOCH).parquet(f"{path}/data")
        if before_commit:
            before_commit(epoch)
        spark.range(1).select(F.lit(epoch).cast("long").alias("epoch")).coalesce(1).write.mode("append").parquet(f"{path}/commits")

    return put
