"""Views that turn the star-schema test tables into grids, station series and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyetos.functions.scalar import dekad_columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily field: a cell for each supplier, ten to a row; quantities are the reference, prices the test."""
    lat_i, lon_i = F.expr("cast(px div 10 as int)"), (F.col("px") % 10).cast("int")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("px"), F.to_date("l_shipdate").alias("time"), "l_quantity", "l_extendedprice").withColumns({"lat_i": lat_i, "lon_i": lon_i})
    # Shuffled once by cell: sums of a day, and whatever groups by cell and season afterwards, need no other shuffle.
    days = items.repartition("lat_i", "lon_i").groupBy("px", "lat_i", "lon_i", "time").agg(F.sum("l_quantity").alias("ref"), (F.sum("l_extendedprice") / 1511).alias("test"))
    return days.withColumns({"lat": F.col("lat_i") * 0.5 - 10.0, "lon": F.col("lon_i") * 0.5 + 95.0} | dekad_columns())


def station_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of events of each type for every user, dense over all days: a day without events is dry."""
    # Added in the order of events: the sum of three and more values depends on it in its last bit, and thresholds tell that.
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("station_id"), F.to_date("ts").alias("time"), "event_type", "value", "event_id")
    placed = events.repartition("station_id", "time").sortWithinPartitions("station_id", "time", "event_id", "value")
    of = lambda t: F.sum(F.when(F.col("event_type") == t, F.col("value"))).alias(t)
    wide = placed.groupBy("station_id", "time").agg(*map(of, ("click", "purchase", "signup", "view", "error")))
    span = events.agg(F.min("time").alias("a"), F.max("time").alias("b")).first()
    dense = events.select("station_id").distinct().select("station_id", F.explode(F.sequence(F.lit(span["a"]), F.lit(span["b"]))).alias("time"))
    return dense.join(wide, ["station_id", "time"], "left").na.fill(0.0)


def station_pairs(spark: SparkSession, sf_dir: str, test: str = "click") -> DataFrame:
    return station_day(spark, sf_dir).select("station_id", "time", F.col("view").alias("ref"), F.col(test).alias("test"))


def station_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference with each other type as a product."""
    return station_day(spark, sf_dir).unpivot(["station_id", "time", "view"], ["click", "purchase", "signup"], "product", "test").withColumnRenamed("view", "ref")


def supplier_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("n_name").alias("province"), F.col("r_name").alias("region"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station_id"), "s_name", "s_nationkey")
    return s.join(F.broadcast(place), s.s_nationkey == place.n_nationkey).select("station_id", F.col("s_name").alias("station"), "province", "region")
