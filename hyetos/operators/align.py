"""Alignment of grids, masks and stations. Axes are small tables (one row for each coordinate); cells join on their
integer positions, never on floating-point coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyetos.functions.scalar import c, wrap_longitude


def axis(cells: DataFrame, name: str) -> DataFrame:
    """(i, x): the distinct coordinates of one axis, in ascending order."""
    one = cells.select(F.col(name).alias("x")).filter("x is not null").distinct()
    return one.select((F.row_number().over(W.orderBy("x")) - 1).alias("i"), "x")


def nearest(source: DataFrame, target: DataFrame, *, bounded: bool = False, ties: str = "larger", key: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """For every target coordinate the nearest source coordinate: (target, source), after the columns `by` where the axes differ by these.

    The neighbours come from running maxima and minima over both axes in order, so no pairs are formed. Halfway, the
    larger coordinate wins (`ties="smaller"`: the smaller one). `bounded`: NULL outside the source's range.
    """
    both = source.select(*by, F.col(key).alias("x"), F.col(key).alias("s")).unionByName(target.select(*by, F.col(key).alias("x"), F.lit(None).cast(dict(source.dtypes)[key]).alias("s")))
    before = F.max("s").over(W.partitionBy(*by).orderBy("x").rangeBetween(W.unboundedPreceding, W.currentRow))
    # Backwards, as a frame that ends at the last row is computed anew for every row.
    after = F.min("s").over(W.partitionBy(*by).orderBy(F.desc("x")).rangeBetween(W.unboundedPreceding, W.currentRow))
    both = both.withColumns({"lo": before, "hi": after}).filter("s is null")
    number = lambda x: F.unix_date(x) if dict(source.dtypes)[key] == "date" else F.col(x) if isinstance(x, str) else x
    down, up = number("x") - number("lo"), number("hi") - number("x")
    wins = (up <= down) if ties == "larger" else (up < down)
    found = F.when(F.col("lo").isNull(), F.col("hi")).when(F.col("hi").isNull(), F.col("lo")).otherwise(F.when(wins, F.col("hi")).otherwise(F.col("lo")))
    if bounded:
        found = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), found)
    return both.select(*by, F.col("x").alias("target"), found.alias("source")).distinct()


def nearest_days(source: DataFrame, targets: DataFrame, *, ties: str = "larger", by: Sequence[str] = (), key: str = "x") -> DataFrame:
    """`nearest` for dates, where all groups `by` have the same targets: (by, target, source).

    Every source day owns the days up to half way to its neighbours, so only source days are shuffled; the targets it owns are
    looked up in the table of targets, which holds each day of the calendar at most once.
    """
    x = F.col("_x")
    want = targets.select(F.col(key).alias("target")).filter("target is not null").distinct()
    ends = want.agg(F.min("target").alias("_first"), F.max("target").alias("_last"))
    order = W.partitionBy(*by).orderBy("_x")
    have = source.select(*by, F.col(key).alias("_x")).distinct()
    # A day that is as far from both neighbours goes to the later one, or the earlier one.
    half = lambda a, b: F.date_add(a, F.floor((F.datediff(b, a) - (1 if ties == "larger" else 0)) / 2).cast("int"))
    owns = have.withColumns({"_before": F.lag("_x").over(order), "_after": F.lead("_x").over(order)}).filter("_x is not null or _after is null").crossJoin(F.broadcast(ends))
    low = F.when(F.col("_before").isNull(), F.col("_first")).otherwise(F.greatest(F.date_add(half(F.col("_before"), x), 1), F.col("_first")))
    high = F.when(F.col("_after").isNull(), F.col("_last")).otherwise(F.least(half(x, F.col("_after")), F.col("_last")))
    each = owns.withColumns({"_low": low, "_high": high}).filter("_low <= _high").select(*by, F.col("_x").alias("source"), F.explode(F.sequence("_low", "_high")).alias("target"))
    return each.join(F.broadcast(want), "target").select(*by, "target", "source")


def brackets(source: DataFrame, target: DataFrame, key: str = "x") -> DataFrame:
    """For every target coordinate the two around it and the weight of the upper one: (target, lo, hi, w); NULL outside."""
    both = source.select(F.col(key).alias("x"), F.col(key).alias("s")).unionByName(target.select(F.col(key).alias("x"), F.lit(None).cast("double").alias("s")))
    both = both.withColumns({
        "lo": F.max("s").over(W.orderBy("x").rangeBetween(W.unboundedPreceding, W.currentRow)),
        "hi": F.min("s").over(W.orderBy("x").rangeBetween(W.currentRow, W.unboundedFollowing)),
    }).filter("s is null and lo is not null and hi is not null")
    return both.select(F.col("x").alias("target"), "lo", "hi", F.when(F.col("hi") > F.col("lo"), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("w")).distinct()


def regrid_nearest(cells: DataFrame, lat_map: DataFrame, lon_map: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Values of the nearest source cell at every target cell; maps come from `nearest`."""
    a = lat_map.select(F.col("target").alias("_lat"), F.col("source").alias("lat"))
    b = lon_map.select(F.col("target").alias("_lon"), F.col("source").alias("lon"))
    return cells.join(F.broadcast(a), "lat").join(F.broadcast(b), "lon").select(*keys, F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), *values)


def regrid_bilinear(cells: DataFrame, lat_map: DataFrame, lon_map: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Bilinear interpolation; NULL if a corner that has weight, or is needed, is missing. Maps come from `brackets`."""

    def corners(m: DataFrame, name: str) -> DataFrame:
        two = F.explode(F.array(F.struct(F.col("lo").alias("at"), (1 - F.col("w")).alias("v")), F.struct(F.col("hi").alias("at"), F.col("w").alias("v"))))
        return m.select(F.col("target").alias(f"_{name}"), two.alias("z")).select(f"_{name}", F.col("z.at").alias(name), F.col("z.v").alias(f"_w{name}"))

    # Shuffled by target row before longitudes are spread: a value goes out for its rows, not for each target cell around it.
    out = cells.join(F.broadcast(corners(lat_map, "lat")), "lat").repartition(*keys, "_lat").join(F.broadcast(corners(lon_map, "lon")), "lon")
    w = F.col("_wlat") * F.col("_wlon")
    whole = lambda v: F.when((F.count(v) == 4) & (F.count("*") == 4), F.sum(w * F.col(v)))
    return out.groupBy(*keys, "_lat", "_lon").agg(*[whole(v).alias(v) for v in values]).select(*keys, F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), *values)


def fill_from(first: DataFrame, second: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """`second` with the values of `first` where those are there."""
    renamed = first.select(*on, *[F.col(v).alias(f"_{v}") for v in values])
    return second.join(renamed, list(on), "left").select(*on, *[F.coalesce(f"_{v}", v).alias(v) for v in values])


def mask_keep(cells: DataFrame, mask: DataFrame, on: Sequence[str] = ("lat_i", "lon_i")) -> DataFrame:
    """Values become NULL where the mask isn't 1; rows stay."""
    m = mask.select(*on, "land")
    return cells.join(m, list(on), "left").withColumn("value", F.when(F.col("land") == 1, F.col("value"))).drop("land")


def mask_clip(cells: DataFrame, mask: DataFrame, on: Sequence[str] = ("lat_i", "lon_i")) -> DataFrame:
    """Only cells where the mask is 1."""
    return cells.join(mask.filter("land = 1").select(*on), list(on), "left_semi")


def box(cells: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    return cells.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def buffered_box(mask: DataFrame, buffer: float = 0.5) -> DataFrame:
    """(south, north, west, east) around the cells with a value; an empty mask is an error of the caller, here NULLs."""
    there = mask.filter("land is not null")
    return there.agg(
        F.greatest(F.min("lat") - buffer, F.lit(-90.0)).alias("south"), F.least(F.max("lat") + buffer, F.lit(90.0)).alias("north"),
        wrap_longitude(F.min("lon") - buffer).alias("west"), wrap_longitude(F.max("lon") + buffer).alias("east"),
    )


def station_cells(stations: DataFrame, lat_axis: DataFrame, lon_axis: DataFrame) -> DataFrame:
    """(station_id, lat, lon): the nearest cell of every station (station_id, lat, lon)."""
    a = nearest(lat_axis, stations.select(F.col("lat").alias("x"))).select(F.col("target").alias("lat"), F.col("source").alias("_lat"))
    b = nearest(lon_axis, stations.select(F.col("lon").alias("x"))).select(F.col("target").alias("lon"), F.col("source").alias("_lon"))
    return stations.join(a, "lat").join(b, "lon").select("station_id", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))


def at_stations(cells: DataFrame, stations: DataFrame, lat_axis: DataFrame, lon_axis: DataFrame) -> DataFrame:
    """The nearest cell's rows for every station (station_id, lat, lon)."""
    at = station_cells(stations, lat_axis, lon_axis)
    return cells.join(at, ["lat", "lon"]).select("station_id", *[x for x in cells.columns if x not in ("lat", "lon")])


def first_of_each(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with the same keys the first by `order`: duplicate time stamps go."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def regular_axis(low: Column | float, high: Column | float) -> Column:
    """Centres of tenth-degree cells that cover [low, high], from integers."""
    return F.transform(F.sequence(F.floor(c(low) * 10).cast("int"), F.ceil(c(high) * 10).cast("int") - 1), lambda k: (k * 10 + 5) / F.lit(100.0))
