"""Taylor statistics from six sums that merge by addition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyetos.functions.scalar import correlation, div

SUMS = ("n", "so", "sp", "soo", "spp", "sop")
STATS = ("r", "sigma_o", "sigma_p", "rmse", "crmse", "bias")


def sums(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of pairs where neither side is missing or negative."""
    o, p = F.col("ref"), F.col("test")
    good = pairs.filter((o >= 0) & (p >= 0))
    return good.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(o).alias("so"), F.sum(p).alias("sp"), F.sum(o * o).alias("soo"), F.sum(p * p).alias("spp"), F.sum(o * p).alias("sop"))


def merge(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in SUMS])


def stats(table: DataFrame, min_n: int = 2) -> DataFrame:
    """The sums' statistics, in place of the sums but n; NULL under `min_n` pairs."""
    n = F.col("n")
    var = lambda s, ss: F.greatest(div(ss, n) - div(s, n) * div(s, n), F.lit(0.0))
    vo, vp = var("so", "soo"), var("sp", "spp")
    r, bias = correlation(n, "so", "sp", "soo", "spp", "sop"), div(F.col("sp") - F.col("so"), n)
    cov = div("sop", n) - div("so", n) * div("sp", n)
    made = {
        "r": r, "sigma_o": F.sqrt(vo), "sigma_p": F.sqrt(vp), "rmse": F.sqrt(F.greatest(div(F.col("soo") + F.col("spp") - 2 * F.col("sop"), n), F.lit(0.0))),
        "crmse": F.sqrt(F.greatest(vo + vp - 2 * cov, F.lit(0.0))), "bias": bias,
    }
    keys = [x for x in table.columns if x not in SUMS]
    return table.select(*keys, "n", *[F.when(n >= min_n, x).alias(k) for k, x in made.items()])


def _median(x: str | Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def with_errors(table: DataFrame) -> DataFrame:
    """crmse and rmse from r, sigma_o, sigma_p and bias."""
    crmse = F.sqrt(F.greatest(F.col("sigma_o") ** 2 + F.col("sigma_p") ** 2 - 2 * F.col("sigma_o") * F.col("sigma_p") * F.col("r"), F.lit(0.0)))
    return table.withColumn("crmse", crmse).withColumn("rmse", F.sqrt(F.col("crmse") ** 2 + F.col("bias") ** 2))


def median_over(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Medians of r, both deviations and bias over the rows of a key, and the errors that follow from them."""
    made = table.groupBy(*keys).agg(*[_median(x).alias(x) for x in ("r", "sigma_o", "sigma_p", "bias")], F.count("r").alias("n_rows"))
    return with_errors(made)


def median_each(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Medians of every statistic over the rows of a key."""
    return table.groupBy(*keys).agg(*[_median(x).alias(x) for x in STATS])


def normalised(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median r and median ratio of deviations, and the normalised centred error."""
    made = table.withColumn("ratio", F.when(F.col("sigma_o") > 0, div("sigma_p", "sigma_o"))).groupBy(*keys).agg(_median("r").alias("r"), _median("ratio").alias("ratio"))
    return made.withColumn("ncrmse", F.sqrt(F.greatest(1 + F.col("ratio") ** 2 - 2 * F.col("ratio") * F.col("r"), F.lit(0.0))))


def polar(table: DataFrame) -> DataFrame:
    """Angle, radius and the point in the plane."""
    r, sdr = F.least(F.greatest(F.col("r"), F.lit(0.0)), F.lit(1.0)), F.col("ratio")
    return table.withColumns({"theta": F.acos(r), "x": sdr * r, "y": sdr * F.sqrt(1 - r * r)})


def monthly(parts: DataFrame, min_n: int = 30) -> DataFrame:
    """From statistics by station, month and dekad: medians over a month's dekads for each station, then over stations; month NULL: all."""
    good = parts.filter((F.col("n") >= min_n) & (F.col("sigma_o") > 0)).withColumn("sdr", div("sigma_p", "sigma_o"))
    both = good.withColumn("month", F.explode(F.array("month", F.lit(None).cast("int"))))
    each = both.groupBy("product", "month", "station_id").agg(_median("r").alias("r"), _median("sdr").alias("sdr"))
    return each.groupBy("product", "month").agg(_median("r").alias("r"), _median("sdr").alias("sdr"), F.count("*").alias("n_stations"))


def lag_correlation(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """r by key and offset h, from sums that are merged first."""
    return merge(table, [*keys, "h"]).select(*keys, "h", "n", correlation("n", "so", "sp", "soo", "spp", "sop").alias("r"))


def best_offset(curve: DataFrame, keys: Sequence[str], tolerance: float = 0.02) -> DataFrame:
    """The offset of the largest r (the smallest such), the band within `tolerance` of it, and the lift over offset 0.

    A key's curve (a value for each offset) is taken as it is once: computed a second time, its sums may differ in their
    last bits, and no value would equal the peak.
    """
    curves = curve.groupBy(*keys).agg(F.collect_list(F.struct("h", "r")).alias("_c")).withColumn("_known", F.filter("_c", lambda x: x["r"].isNotNull()))
    peak = F.array_max(F.transform("_known", lambda x: x["r"]))
    zero = F.array_max(F.transform(F.filter("_known", lambda x: x["h"] == 0), lambda x: x["r"]))
    found = curves.withColumns({"peak": peak, "at_zero": zero}).filter("peak is not null")
    at = lambda keep: F.transform(F.filter("_known", keep), lambda x: x["h"])
    near = lambda x: x["r"] >= F.col("peak") - tolerance
    return found.select(
        *keys, "peak", "at_zero", F.array_min(at(lambda x: x["r"] == F.col("peak"))).alias("best_h"), F.array_min(at(near)).alias("band_low"), F.array_max(at(near)).alias("band_high"),
    ).withColumn("lift", F.col("peak") - F.col("at_zero"))
