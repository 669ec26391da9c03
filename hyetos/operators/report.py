"""Roll-ups of metrics and the frames behind figures and dashboards."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyetos.functions.scalar import div
from hyetos.operators import order


def _median(x) -> Column:
    return F.percentile(x, F.lit(0.5))


def labelled(stations: DataFrame) -> DataFrame:
    """With `name`: the station's name in capitals and its padded id."""
    text = F.upper(F.replace(F.trim("station"), F.lit("#"), F.lit(" ")))
    return stations.withColumn("name", F.concat(text, F.lit(" ("), F.lpad(F.col("station_id").cast("string"), 4, "0"), F.lit(")")))


def period_text(code) -> Column:
    """`month03_dekad11` in words."""
    part = lambda k: F.regexp_extract(code, r"^month(\d+)_dekad(\d+)$", k)
    return F.concat(F.lit("month "), part(1), F.lit(", day "), part(2).cast("int").cast("string"), F.lit(" on"))


def method_comparison(rows: DataFrame, method: str, values: Sequence[str]) -> DataFrame:
    return rows.groupBy(method).agg(F.count("*").alias("n_stations"), *[_median(v).alias(v) for v in values])


def _counted(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _changes(before: str, after: str, step: float = 0.001) -> list[Column]:
    x = F.col(after) - F.col(before)
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), _counted(x > step).alias("n_improved"), _counted(x < -step).alias("n_degraded"), _counted(F.abs(x) <= step).alias("n_unchanged")]


def _change_shares(made: DataFrame) -> DataFrame:
    return made.withColumns({f"percent_{k}": 100 * div(f"n_{k}", "n") for k in ("improved", "degraded")})


def improvement(rows: DataFrame, keys: Sequence[str], before: str, after: str, step: float = 0.001) -> DataFrame:
    return _change_shares(rows.groupBy(*keys).agg(*_changes(before, after, step), _median(F.col(after) - F.col(before)).alias("median")))


def _categories(category: str) -> list[Column]:
    k = F.col(category)
    return [*[_counted(k == c).alias(f"c{c}") for c in (1, 2, 3, 4)], _counted(k > 0).alias("total"), _counted(k >= 3).alias("_good")]


def _category_shares(made: DataFrame) -> DataFrame:
    return made.withColumns({"percent_good": 100 * div("_good", "total"), **{f"p{c}": 100 * div(f"c{c}", "total") for c in (1, 2, 3, 4)}}).drop("_good")


def category_counts(rows: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    return _category_shares(rows.groupBy(*keys).agg(*_categories(category)))


def batch_summary(rows: DataFrame, period: str, before: str, after: str, category: str) -> DataFrame:
    """One row over all periods: mean of their mean changes and of their shares of improved rows and of each category, and the best and worst period."""
    each = _category_shares(_change_shares(rows.groupBy(period).agg(*_changes(before, after), *_categories(category))))  # one run of the rows
    means = {"mean_change": "mean", "percent_improved": "percent_improved", "percent_degraded": "percent_degraded", **{f"p{c}": f"p{c}" for c in (1, 2, 3, 4)}}
    return each.agg(*[F.avg(v).alias(k) for k, v in means.items()], F.max_by(period, "mean").alias("best_period"), F.min_by(period, "mean").alias("worst_period"), F.count("*").alias("n_periods"))


def group_medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Median and number of each group that has a value."""
    return rows.filter(F.col(group).isNotNull()).groupBy(group).agg(_median(value).alias("median"), F.count(value).alias("n")).filter("n > 0")


def placed(rows: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """With `place`: the place of a name in a given order, other names after those."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column)).cast("int")
    return rows.withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1))


def counts_by_period(rows: DataFrame, period: str, station: str) -> DataFrame:
    """The least, the largest and the median number of stations of a period."""
    each = rows.groupBy(period).agg(F.countDistinct(station).alias("n"))
    return each.agg(F.min("n").alias("least"), F.max("n").alias("most"), _median("n").alias("median"))


def preferred(rows: DataFrame, keys: Sequence[str], method: str, order: Sequence[str], first: str) -> DataFrame:
    """The row of the method `first`, else that of the last in `order` that is there."""
    rank = F.when(F.col(method) == first, len(order) + 1).otherwise(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(method)))
    chosen = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), rank).alias("_r"))
    return chosen.select("_r.*")


def first_step(rows: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Of each key only the rows of its first time step."""
    first = rows.groupBy(*keys).agg(F.min(time).alias(time))
    return rows.join(first, [*keys, time], "left_semi")


def ranked(rows: DataFrame, by: str, ties: Sequence[str], partitions: int | None = None) -> DataFrame:
    """With `rank` by a number, ties in the order of `ties`, over range partitions."""
    return order.ranks(rows, by, ties, partitions=partitions).drop("group_size")


def ecdf(rows: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str] = ()) -> DataFrame:
    """Rank over count; equal values rise one by one."""
    placed = order.ranks(order.kept(rows).filter(F.col(value).isNotNull()), value, ties, keys)
    return placed.withColumn("ecdf", div("rank", "group_size")).drop("rank", "group_size")


def histogram(rows: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts in equal bins; the last is closed on both sides, values outside are left out."""
    v = F.col(value)
    return rows.filter(v.between(low, high)).groupBy(F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def best_and_worst(rows: DataFrame, period: str, change: Column) -> DataFrame:
    each = rows.groupBy(period).agg(F.avg(change).alias("_x"))
    return each.agg(F.max_by(period, "_x").alias("best_period"), F.min_by(period, "_x").alias("worst_period"), F.avg("_x").alias("mean_change"))


def median_then_mean(rows: DataFrame, inner: Sequence[str], outer: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Medians over space for each `inner` key, then means over those of an `outer` key."""
    return order.medians(rows, inner, values).groupBy(*outer).agg(*[F.avg(v).alias(v) for v in values])


def mean_then_median(rows: DataFrame, cell: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means of each cell, then medians over cells."""
    return order.medians(rows.groupBy(*cell).agg(*[F.avg(v).alias(v) for v in values]), [], values)


def five_numbers(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), *[F.percentile(value, F.lit(p)).alias(n) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))], F.max(value).alias("max"))


def best_stage(rows: DataFrame, keys: Sequence[str], stage: str, goals: Mapping[str, str]) -> DataFrame:
    """For each key and metric the stage that comes nearest to the metric's goal: high, low, zero or one; the first by name on a tie."""
    value = {"high": lambda x: x, "low": lambda x: -x, "zero": lambda x: -F.abs(x), "one": lambda x: -F.abs(x - 1)}
    long = rows.select(*keys, stage, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), value[g](F.col(m)).alias("score")) for m, g in goals.items()])).alias("_s")).select(*keys, stage, "_s.*")
    order = W.partitionBy(*keys, "metric").orderBy(F.desc_nulls_last("score"), stage)
    return long.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def scatter(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Paired rows with r, rmse, nse and bias of their group; the statistics join the rows, so that no task holds a group."""
    both = pairs.filter(F.col("ref").isNotNull() & F.col("test").isNotNull())
    off = F.col("test") - F.col("ref")
    stats = both.groupBy(*keys).agg(F.corr("ref", "test").alias("r"), F.sqrt(F.avg(off * off)).alias("rmse"), (1 - div(F.avg(off * off), F.var_pop("ref"))).alias("nse"), F.avg(off).alias("bias"))
    return both.select(*keys, "time", "ref", "test").join(stats.withColumn("r", F.nanvl("r", F.lit(None))), list(keys))


def rolling_days(events: DataFrame) -> DataFrame:
    """(station_id, hour, ref, test): 24-hour sums of views and clicks at every hour.

    Events are shuffled once, by station; hours without events are filled in between the hours that have some, in the same tasks.
    """
    hour = F.floor(F.unix_timestamp(F.date_trunc("hour", "ts")) / 3600)
    known = events.select(F.col("user_id").alias("station_id"), hour.alias("hour"), "event_type", "value")
    span = known.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).first()
    first, last = (F.lit(x).cast("long") for x in span)
    of = lambda t: F.sum(F.when((F.col("event_type") == t) & F.col("hour").isNotNull() & F.col("station_id").isNotNull(), F.col("value")))
    hours = known.repartition("station_id").groupBy("station_id", F.coalesce("hour", first).alias("hour")).agg(of("view").alias("ref"), of("click").alias("test"))
    order = W.partitionBy("station_id").orderBy("hour")
    start = F.when(F.row_number().over(order) == 1, first).otherwise(F.col("hour"))
    upto = F.coalesce(F.lead("hour").over(order) - 1, last)
    at = hours.withColumns({"_a": start, "_b": upto}).withColumn("_hour", F.explode(F.sequence("_a", "_b")))
    value = lambda x: F.when(F.col("_hour") == F.col("hour"), F.coalesce(x, F.lit(0.0))).otherwise(0.0).alias(x)
    day = order.rangeBetween(-23, 0)
    return at.select("station_id", F.col("_hour").alias("hour"), value("ref"), value("test")).select("station_id", "hour", F.sum("ref").over(day).alias("ref"), F.sum("test").over(day).alias("test"))


def lag_sums(rolled: DataFrame, offsets: Iterable[int], keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """Six sums by `keys` and offset h: the reference at midnight with the test h hours later.

    The hours around a midnight come from the neighbouring days of the same station, in a window over days of 24 values, so
    no pairs are shuffled: a task adds up its own, and sends sums for each key and offset.
    """
    offsets = sorted(set(offsets))
    keys = list(keys)
    hours = rolled.filter("station_id is not null").withColumn("_day", F.floor(F.col("hour") / 24))
    days = hours.groupBy(*dict.fromkeys(["station_id", "_day", *keys])).agg(F.max(F.when(F.col("hour") % 24 == 0, F.struct("ref"))).alias("_at"), F.collect_list(F.struct("hour", "test")).alias("_hours"))
    around = W.partitionBy("station_id").orderBy("_day").rangeBetween(offsets[0] // 24, offsets[-1] // 24)
    near = days.withColumn("_near", F.collect_list("_hours").over(around)).filter("_at is not null")
    one = near.select(*keys, "_day", F.col("_at.ref").alias("ref"), F.explode(F.flatten("_near")).alias("o"))
    pairs = one.select(*keys, "ref", (F.col("o.hour") - F.col("_day") * 24).cast("int").alias("h"), F.col("o.test").alias("test")).filter(F.col("h").isin(offsets))
    o, p = F.col("ref"), F.col("test")
    return pairs.groupBy(*keys, "h").agg(F.count("*").alias("n"), F.sum(o).alias("so"), F.sum(p).alias("sp"), F.sum(o * o).alias("soo"), F.sum(p * p).alias("spp"), F.sum(o * p).alias("sop"))


def upscale(confidence: DataFrame, coarse_n: int, coarse_step: float, fine_n: int, fine_step: float, offset: float) -> DataFrame:
    """Confidence at the nearest coarse centre of a finer square grid that starts `offset` from the first centre; 0 outside the centres."""
    spark = confidence.sparkSession
    x = F.col("id") * fine_step + offset
    inside = (x >= -1e-9) & (x <= (coarse_n - 1) * coarse_step + 1e-9)
    axis = spark.range(fine_n).select(F.col("id").cast("int").alias("k"), F.when(inside, F.round(x / coarse_step + 1e-6).cast("int")).alias("i"))
    a, b = (axis.select(F.col("k").alias(f"{n}_k"), F.col("i").alias(f"{n}_i")) for n in ("lat", "lon"))
    return a.crossJoin(F.broadcast(b)).join(confidence, ["lat_i", "lon_i"], "left").select("lat_k", "lon_k", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def density_whatif(counts: DataFrame, saturations: Sequence[float], alpha: float) -> DataFrame:
    """For each saturation the mean weight of the predictor, and the share of cells where it is at least a tenth."""
    s = counts.withColumn("saturation", F.explode(F.array(*[F.lit(float(x)) for x in saturations])))
    w = F.least(F.col("count") / F.col("saturation"), F.lit(1.0)) * (1 - F.lit(alpha))
    return s.groupBy("saturation").agg(F.avg(w).alias("mean_weight"), F.avg((F.round(w, 12) >= 0.1).cast("double")).alias("share_over_10"))


def sweep(pairs: DataFrame, keys: Sequence[str], saturations: Sequence[float], alpha: float = 0.7) -> DataFrame:
    """Median error of blending with the reference where confidence is lat_i over each saturation: one scan for all settings."""
    limit = pairs.groupBy(*keys).agg(F.percentile("test", F.lit(0.8)).alias("_limit"))
    rows = pairs.join(limit, list(keys)).withColumn("saturation", F.explode(F.array(*[F.lit(float(x)) for x in saturations])))
    a = 1 - F.least(F.col("lat_i") / F.col("saturation"), F.lit(1.0)) * (1 - F.lit(alpha))
    y = F.when(F.col("test") > F.col("_limit"), a * F.col("test") + (1 - a) * F.col("ref")).otherwise(F.col("test"))
    errors = rows.groupBy("saturation", *keys).agg(F.sqrt(F.avg((y - F.col("ref")) ** 2)).alias("_e"))
    return order.medians(errors, ["saturation"], ["_e"]).withColumnRenamed("_e", "rmse")


def settings(saturations: Sequence[float], alphas: Sequence[float], percentiles: Sequence[float], default: tuple[float, float, float]) -> list[tuple[str, float, float, float]]:
    """One-at-a-time settings of three parameters: (name, saturation, alpha, percentile)."""
    out = []
    for k, (name, values) in enumerate((("saturation", saturations), ("alpha", alphas), ("percentile", percentiles))):
        for v in values:
            out.append((name, *(float(v) if j == k else float(default[j]) for j in range(3))))
    return out


def sweep_settings(pairs: DataFrame, keys: Sequence[str], plan: Sequence[tuple[str, float, float, float]]) -> DataFrame:
    """Of every setting the medians over cells of error and bias of the blended test, from one scan: limits of all percentiles are one aggregate."""
    shares = sorted({p for _, _, _, p in plan})
    limits = pairs.groupBy(*keys).agg(F.percentile("test", F.array(*[F.lit(p) for p in shares])).alias("_limits"))
    each = F.array(*[F.struct(F.lit(n).alias("parameter"), F.lit(s).alias("saturation"), F.lit(a).alias("alpha"), F.lit(p).alias("percentile"), F.lit(shares.index(p)).alias("_at")) for n, s, a, p in plan])
    rows = pairs.join(limits, list(keys)).withColumn("_s", F.explode(each)).select(*pairs.columns, "_limits", "_s.*")
    a = 1 - F.least(F.col("lat_i") / F.col("saturation"), F.lit(1.0)) * (1 - F.col("alpha"))
    limit = F.get("_limits", F.col("_at"))
    y = F.when((F.col("test") > limit) & (F.col("test") > 0), a * F.col("test") + (1 - a) * F.col("ref")).otherwise(F.col("test"))
    setting = ["parameter", "saturation", "alpha", "percentile"]
    cells = rows.groupBy(*setting, *keys).agg(F.sqrt(F.avg((y - F.col("ref")) ** 2)).alias("_e"), F.avg(y - F.col("ref")).alias("_b"))
    return order.medians(cells, setting, ["_e", "_b"]).withColumnsRenamed({"_e": "rmse", "_b": "bias"})


def pending(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return plan.join(done, list(keys), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `new` replace those of `old` with the same keys."""
    return old.join(new, list(keys), "left_anti").unionByName(new)


def running_seasons(rows: DataFrame, keys: Sequence[str], value: str, month: str = "month") -> DataFrame:
    """Medians over three-month seasons, each named by its middle month; a month belongs to three of them."""
    m = F.col(month)
    each = rows.withColumn("season", F.explode(F.array((m + 10) % 12 + 1, m, m % 12 + 1)))
    keys = [*keys, "season"]
    return order.medians(each, keys, [value]).withColumnRenamed(value, "median").join(each.groupBy(*keys).agg(F.count(value).alias("n")), keys)


def ordered(rows: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Sorted by a given order of names; others come last, by name."""
    place = F.create_map(*[F.lit(x) for k, name in enumerate(order) for x in (name, k)]) if order else None
    rank = F.coalesce(F.try_element_at(place, F.col(column)), F.lit(len(order))) if order else F.lit(0)
    return rows.orderBy(rank, column)
