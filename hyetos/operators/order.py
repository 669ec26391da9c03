"""Order statistics and ranks of groups that may hold any share of all rows.

`quantiles` is exact and takes two passes: mergeable sketches bracket each wanted rank, then rows below the bracket are
counted, and the few values inside are counted one by one. No task holds the values of a group.

`ranks` orders all rows over range partitions, whose boundaries Spark samples on the whole order, ties included, so that
values that cluster, or one outlier, still give even partitions. A row's place in its partition and the sizes of the
partitions before it give its rank; a group's ranks begin at its first row.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyetos.sources import folders

#: One over the relative error of ranks in a sketch; a bracket is three errors wide on each side.
ACCURACY, MARGIN = 100_000, 3
_PLACE = (1 << 33) - 1


def quantiles(rows: DataFrame, keys: Sequence[str], values: Sequence[str], shares: Mapping[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """(keys, `{value}{name}` for each value and share): exact quantiles between the two nearest ranks, missing values left out.

    Equal to `percentile`, but for rounding. A group without values gives NULL. Where no keys are given, one row.
    """
    keys, names = list(keys), list(shares)
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("_v"), F.col(v).cast("double").alias("_x")) for k, v in enumerate(values)])).alias("_s")).select(*keys, "_s.*")
    good = long.filter(F.col("_x").isNotNull())
    group = [*keys, "_v"]
    margin = MARGIN / accuracy
    ends = [min(max(shares[n] + side * margin, 0.0), 1.0) for n in names for side in (-1, 1)]
    sketched = good.groupBy(*group).agg(F.count("*").alias("_n"), F.percentile_approx("_x", ends, accuracy).alias("_ends"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    few = F.col("_n") < accuracy  # less than one error of a rank: all values are counted
    end = lambda k, least: F.when(few, F.col(least)).otherwise(F.get("_ends", F.lit(k)))
    wanted = F.array(*[F.struct(F.lit(k).alias("_k"), (F.lit(shares[n]) * (F.col("_n") - 1)).alias("_at"), end(2 * k, "_min").alias("_lo"), end(2 * k + 1, "_max").alias("_hi")) for k, n in enumerate(names)])
    wanted = sketched.select(*group, F.explode(wanted).alias("_w")).select(*[F.col(g).alias(f"_w{g}") for g in group], "_w.*")
    same = [F.col(g).eqNullSafe(F.col(f"_w{g}")) for g in group]
    near = good.join(wanted, same).filter(F.col("_x") <= F.col("_hi")).drop(*[f"_w{g}" for g in group])
    counted = near.groupBy(*group, "_k", "_at", F.when(F.col("_x") >= F.col("_lo"), F.col("_x")).alias("_y")).agg(F.count("*").alias("_c"))
    upto = counted.withColumn("_upto", F.sum("_c").over(W.partitionBy(*group, "_k").orderBy(F.asc_nulls_first("_y"))))
    at = F.col("_at")
    picked = upto.groupBy(*group, "_k", "_at").agg(
        F.min(F.when(F.col("_upto") > F.floor("_at"), F.struct("_upto", F.col("_y").alias("y")))).alias("_a"), F.min(F.when(F.col("_upto") > F.ceil("_at"), F.struct("_upto", F.col("_y").alias("y")))).alias("_b"))
    y = F.col("_a.y") + (at - F.floor(at)) * (F.col("_b.y") - F.col("_a.y"))
    safe = F.when(F.col("_a.y").isNull() | F.col("_b.y").isNull(), F.raise_error(F.lit("a bracket missed its rank"))).otherwise(y)
    made = picked.select(*group, "_k", safe.alias("_q"))
    out = made.groupBy(*keys).agg(*[F.max(F.when((F.col("_v") == j) & (F.col("_k") == k), F.col("_q"))).alias(f"{v}{n}") for j, v in enumerate(values) for k, n in enumerate(names)])
    if not keys:
        return out
    every = rows.select(*keys).distinct()
    return every.join(out.withColumnsRenamed({k: f"_o{k}" for k in keys}), [every[k].eqNullSafe(F.col(f"_o{k}")) for k in keys], "left").drop(*[f"_o{k}" for k in keys])


def medians(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return quantiles(rows, keys, values, {"": 0.5})


def kept(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder: bounds of ranges are sampled in a run of their own, which would compute them a second time."""
    path = f"{folders.shared_dir(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def ranks(rows: DataFrame, by: str, ties: Sequence[str] = (), keys: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """`rows` with `rank` (from 1, nulls first) by a column and ties, and `group_size`, within each key. Equal rows come in any order."""
    spark, keys = rows.sparkSession, list(keys)
    order = list(dict.fromkeys([*keys, by, *ties]))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{folders.shared_dir(spark)}/ranks-{uuid.uuid4().hex}"
    # The last column parts rows that are equal in all others, so that they don't have to share a partition.
    placed = rows.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(n, *order, "_any").sortWithinPartitions(*order, "_any").withColumn("_id", F.monotonically_increasing_id()).drop("_any")
    placed.write.parquet(path)
    table = spark.read.parquet(path)
    part, place = F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(_PLACE)
    sizes = table.groupBy(part).agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))  # a row for each partition
    placed = table.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + place + 1)
    if not keys:
        total = sizes.agg(F.sum("_size").alias("group_size"))
        return placed.crossJoin(F.broadcast(total)).withColumnRenamed("_rank", "rank").drop("_id", "_part", "_before")
    first = placed.groupBy(*keys).agg(F.min("_rank").alias("_first"), F.count("*").alias("group_size")).withColumnsRenamed({k: f"_k{k}" for k in keys})
    joined = placed.join(first, [placed[k].eqNullSafe(F.col(f"_k{k}")) for k in keys])
    return joined.withColumn("rank", F.col("_rank") - F.col("_first") + 1).drop("_id", "_part", "_before", "_rank", "_first", *[f"_k{k}" for k in keys])
