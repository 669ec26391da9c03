"""Station density and smoothing on grids: small kernels are joined along each axis in turn."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyetos.functions.scalar import clip, div


def station_counts(stations: DataFrame, resolution: float, south: float, north: float, west: float, east: float) -> DataFrame:
    """(lat_i, lon_i, count) of every cell of the grid; bins are closed on the left, the last one on both sides."""
    rows, columns = round((north - south) / resolution), round((east - west) / resolution)

    def place(x: str, low: float, high: float, n: int):
        return F.when(F.col(x).between(low, high), F.least(F.floor((F.col(x) - low) / resolution), F.lit(n - 1)).cast("int"))

    there = stations.select(place("lat", south, north, rows).alias("lat_i"), place("lon", west, east, columns).alias("lon_i")).dropna().groupBy("lat_i", "lon_i").count()
    grid = stations.sparkSession.range(rows * columns).select((F.col("id") / columns).cast("int").alias("lat_i"), (F.col("id") % columns).cast("int").alias("lon_i"))
    return grid.join(there, ["lat_i", "lon_i"], "left").select("lat_i", "lon_i", F.coalesce("count", F.lit(0)).alias("count"))


def kernel(sigma: float = 1.0, truncate: float = 4.0) -> list[tuple[int, float]]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [(k - radius, w / sum(raw)) for k, w in enumerate(raw)]


def _along(cells: DataFrame, axis: str, size: int, weights: Sequence[tuple[int, float]], values: Sequence[str], keys: Sequence[str], reflect: bool) -> DataFrame:
    """One pass: every cell gives its share to the cells it reaches; the border is reflected or repeated."""
    spark: SparkSession = cells.sparkSession
    table = spark.createDataFrame([(int(k), float(w)) for k, w in weights], "k int, w double")
    at = F.col("i") + F.col("k")
    if reflect:  # ... 1 0 | 0 1 2 ... n-1 | n-1 n-2 ...
        m = F.pmod(at, F.lit(2 * size))
        at = F.when(m < size, m).otherwise(2 * size - 1 - m)
    else:
        at = F.least(F.greatest(at, F.lit(0)), F.lit(size - 1))
    reach = spark.range(size).select(F.col("id").cast("int").alias("i")).crossJoin(F.broadcast(table)).select("i", at.cast("int").alias(axis), "w")
    other = [x for x in ("lat_i", "lon_i") if x != axis]
    return (
        cells.join(F.broadcast(reach), axis).groupBy(*keys, F.col("i"), *other)
        .agg(*[F.sum(F.col("w") * F.col(v)).alias(v) for v in values]).withColumnRenamed("i", axis)
    )


def gaussian(cells: DataFrame, rows: int, columns: int, sigma: float = 1.0, values: Sequence[str] = ("value",), keys: Sequence[str] = (), reflect: bool = True) -> DataFrame:
    w = kernel(sigma)
    return _along(_along(cells, "lat_i", rows, w, values, keys, reflect), "lon_i", columns, w, values, keys, reflect)


def confidence(counts: DataFrame, rows: int, columns: int, sigma: float = 1.0, saturation: float = 2.0) -> DataFrame:
    """(lat_i, lon_i, confidence): smoothed counts over the saturation, within [0, 1]."""
    smooth = gaussian(counts.select("lat_i", "lon_i", F.col("count").cast("double").alias("value")), rows, columns, sigma)
    return saturated(smooth, saturation)


def saturated(smooth: DataFrame, saturation: float) -> DataFrame:
    """(lat_i, lon_i, confidence): smoothed counts over the saturation, within [0, 1]."""
    return smooth.select("lat_i", "lon_i", clip(F.col("value") / saturation, 0, 1).alias("confidence"))


def smooth_with_gaps(cells: DataFrame, rows: int, columns: int, sigma: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Smoothing that ignores missing cells and leaves them missing."""
    parts = cells.select(*keys, "lat_i", "lon_i", F.coalesce("value", F.lit(0.0)).alias("num"), F.col("value").isNotNull().cast("double").alias("den"))
    made = gaussian(parts, rows, columns, sigma, ("num", "den"), keys, reflect=False)
    at = [*keys, "lat_i", "lon_i"]
    return cells.join(made, at).select(*at, F.when(F.col("value").isNotNull() & (F.col("den") > 1e-6), div("num", "den")).alias("value"))


def fill_once(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Missing cells become the mean of the values among their eight neighbours, all at once."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    at = [*keys, "lat_i", "lon_i"]
    near = cells.filter("value is not null").select(*keys, "lat_i", "lon_i", "value", step.alias("s"))
    means = near.groupBy(*keys, (F.col("lat_i") + F.col("s.a")).alias("lat_i"), (F.col("lon_i") + F.col("s.b")).alias("lon_i")).agg(F.avg("value").alias("_mean"))
    return cells.join(means, at, "left").select(*at, F.coalesce("value", "_mean").alias("value"))


def fill(cells: DataFrame, keys: Sequence[str] = (), most: int = 50) -> DataFrame:
    """Passes of `fill_once` until nothing changes; each is checkpointed where a checkpoint folder is set."""
    left = None
    for _ in range(most):
        cells = fill_once(cells, keys)
        if cells.sparkSession.sparkContext.getCheckpointDir():
            cells = cells.checkpoint()
        now = cells.filter("value is null").count()
        if now in (0, left):
            break
        left = now
    return cells
