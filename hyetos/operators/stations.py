"""Station validation: gates, multi-threshold scores, summaries and metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyetos.functions.scalar import div
from hyetos.operators import metrics as M


def station_metrics(pairs: DataFrame, keys: Sequence[str] = ("station_id",), threshold: float = 1.0, min_days: int = 30, pvalue: bool = True) -> DataFrame:
    """The 31 metrics of groups with at least `min_days` pairs, with n_valid_days."""
    enough = M.valid(pairs).groupBy(*keys).count().filter(F.col("count") >= min_days).select(*keys)
    out = M.metrics31(pairs.join(enough, list(keys), "left_semi"), keys, threshold, pvalue=pvalue)
    return out.withColumnRenamed("n", "n_valid_days")


def multi_threshold(pairs: DataFrame, keys: Sequence[str] = ("station_id",), thresholds: Sequence[float] = (1, 5, 10, 20, 50, 100, 150), min_days: int = 30, min_events: int = 10) -> DataFrame:
    """Scores at every threshold, in long form."""
    table = M.contingency(pairs, keys, thresholds).filter(F.col("n") >= min_days)
    return M.supported(M.scores(table), min_events)


def threshold_summary(scored: DataFrame, keys: Sequence[str] = ("threshold",)) -> DataFrame:
    """Across stations: median, quartiles and number of every score, and the mean number of events."""
    names = ("pod", "far", "csi", "fbi", "ets", "hss", "hk", "freq_obs", "freq_prd")
    return scored.groupBy(*keys).agg(
        *[x for s in names for x in (F.percentile(s, F.lit(0.5)).alias(f"{s}_median"), F.percentile(s, F.lit(0.25)).alias(f"{s}_p25"), F.percentile(s, F.lit(0.75)).alias(f"{s}_p75"), F.count(s).alias(f"{s}_n"))],
        F.avg("n_events").alias("mean_events"),
    )


def wide(long: DataFrame, key: str | Sequence[str], name: str, values: Sequence[str], labels: Sequence) -> DataFrame:
    """One row for each key, or each combination of several; a column for each label and value."""
    return long.groupBy(*([key] if isinstance(key, str) else key)).pivot(name, list(labels)).agg(*[F.first(v).alias(v) for v in values])


def long_form(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return rows.unpivot(list(keys), list(values), "metric", "value")


def describe(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of every metric."""
    v = F.col("value")
    return long_form(rows, keys, values).groupBy("metric").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        *[F.percentile(v, F.lit(p)).alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75)], F.max(v).alias("max"),
    )


def with_metadata(rows: DataFrame, stations: DataFrame, key: str = "station_id", regions: Mapping[str, str] | None = None, other: str | None = "Other") -> DataFrame:
    """Left join with station metadata, whose names are normalised; columns of the metadata that `rows` has are replaced.

    `regions` maps provinces to regions where the metadata has none; `other` stands for provinces that it lacks.
    """
    aliases = {"region": "Region", "a1name": "Province", "province": "Province", "a2name": "District", "district": "District"}
    stations = stations.withColumnsRenamed({x: aliases[x.lower()] for x in stations.columns if x.lower() in aliases})
    if regions is not None and "Region" not in stations.columns:
        table = F.create_map(*[F.lit(x) for kv in regions.items() for x in kv])
        found = F.try_element_at(table, F.col("Province"))
        stations = stations.withColumn("Region", found if other is None else F.coalesce(found, F.lit(other)))
    rows = rows.drop(*[x for x in stations.columns if x != key and x in rows.columns])
    first = [x for x in stations.columns if x != key]
    return rows.join(stations, key, "left").select(key, *first, *[x for x in rows.columns if x != key])


def by_group(rows: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """n_stations, and median and mean of every metric, of groups that are not NULL."""
    return rows.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n_stations"), *[x for v in values for x in (F.percentile(v, F.lit(0.5)).alias(f"{v}_median"), F.avg(v).alias(f"{v}_mean"))],
    )


def completeness(obs: DataFrame, key: str = "station_id", value: str = "value") -> DataFrame:
    return obs.groupBy(key).agg((100 * div(F.count(value), F.count("*"))).alias("percent_valid"))


def dry_and_wet_rates(pairs: DataFrame, keys: Sequence[str], threshold: float = 1.0) -> DataFrame:
    """correct_dry: of all dry reference rows, also those without a test value, the share that both sides call dry;
    wet_ratio: wet rows of the test for each of the reference, over paired rows."""
    r, t = F.col("ref"), F.col("test")
    count = lambda e: F.count(F.when(e, 1))
    both = r.isNotNull() & t.isNotNull()
    return pairs.groupBy(*keys).agg(
        div(count((r < threshold) & (t < threshold)), count(r < threshold)).alias("correct_dry"), div(count(both & (t >= threshold)), count(both & (r >= threshold))).alias("wet_ratio"),
    )


def heavy_day_ratio(pairs: DataFrame, keys: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """Days of the test at or above each threshold for each such day of the reference."""
    table = M.contingency(pairs, keys, thresholds)
    return table.select(*keys, "threshold", div(F.col("a") + F.col("b"), F.col("a") + F.col("c")).alias("ratio"), (F.col("a") + F.col("c")).alias("n_ref"))


def distribution_ratios(pairs: DataFrame, keys: Sequence[str], wet: float = 1.0) -> DataFrame:
    """Ratios, test to reference, of the 95th and 99th percentiles and of the mean of wet days, over paired rows."""
    r, t = F.col("ref"), F.col("test")
    q = lambda x, p: F.percentile(x, F.lit(p))
    wet_mean = lambda x: F.avg(F.when(x >= wet, x))
    return M.valid(pairs).groupBy(*keys).agg(div(q(t, 0.95), q(r, 0.95)).alias("q95_ratio"), div(q(t, 0.99), q(r, 0.99)).alias("q99_ratio"), div(wet_mean(t), wet_mean(r)).alias("intensity_ratio"))


def mean_over(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means over all other keys (years, periods) of values that are there, with the number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.avg(v).alias(v) for v in values])


def checked(rows: DataFrame, values: Sequence[str], what: str = "input") -> DataFrame:
    """`rows`, or an error where there are none or a column has no value at all."""
    n = rows.agg(F.count("*").alias("_rows"), *[F.count(v).alias(v) for v in values]).first()
    if n["_rows"] == 0:
        raise ValueError(f"{what} is empty")
    missing = [v for v in values if n[v] == 0]
    if missing:
        raise ValueError(f"{what} has only missing values in {', '.join(missing)}")
    return rows


def paired_or_error(left: DataFrame, right: DataFrame, keys: Sequence[str], what: str = "the two sides") -> DataFrame:
    """The inner join, or an error where it has no row."""
    out = left.join(right, list(keys))
    if out.isEmpty():
        raise ValueError(f"{what} share no {', '.join(keys)}")
    return out


def write_wide(long: DataFrame, path: str, key: str | Sequence[str], name: str, values: Sequence[str], labels: Sequence) -> None:
    """CSV of one row for each key with columns `{label}_{value}`; the labels of the pivot are the caller's, so nothing is collected."""
    wide(long, key, name, values, labels).write.mode("overwrite").option("header", True).csv(path)
