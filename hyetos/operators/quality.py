"""Composite quality of a cell from its metrics. A missing input makes the part missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyetos.functions.scalar import c, clip, closeness, lower

NO_CATEGORY = -9999


def _weighted(*parts: tuple[float, Column]) -> Column:
    out = F.lit(0.0)
    for w, x in parts:
        out = out + w * x
    return out.cast("float")


def basic() -> Column:
    bias = 1 - lower(F.abs("relative_bias"), F.lit(1.0))
    return _weighted((0.3, bias), (0.3, F.exp(-F.col("rmse") / 5)), (0.4, clip("nse", 0, 1)))


def distribution() -> Column:
    of = lambda p: closeness(f"p{p}_test", f"p{p}_ref")
    extreme = 0.3 * of(90) + 0.3 * of(95) + 0.4 * of(99)
    general = 0.3 * of(25) + 0.4 * of(50) + 0.3 * of(75)
    spread = 1 - lower(F.abs(1 - F.col("stdev_ratio")), F.lit(1.0))
    return _weighted((0.45, extreme), (0.25, general), (0.15, spread), (0.15, clip("ks_pvalue", 0, 1)))


def temporal() -> Column:
    r, t = F.coalesce("dsl_ref", F.lit(0.0)), F.coalesce("dsl_test", F.lit(0.0))
    spells = 1 - lower(F.abs(t - r) / (r + 1e-6), F.lit(1.0))
    return _weighted((0.4, clip("csi", 0, 1)), (0.3, 0.6 * F.col("pod") + 0.4 * (1 - F.col("far"))), (0.3, spells))


def continuous(weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> Column:
    return _weighted(*zip(weights, (F.col(x).cast("double") for x in ("basic_statistical_quality", "distribution_quality", "temporal_quality")), strict=True))


def category(x: Column | str = "continuous_quality", cuts: tuple[float, float, float] = (0.4, 0.6, 0.8)) -> Column:
    """4 to 1 from good to poor; -9999 where there is no value. Compared as single precision."""
    x = c(x)
    out = F.when(x.isNull(), NO_CATEGORY)
    for k, cut in zip((4, 3, 2), cuts[::-1], strict=True):
        out = out.when(x >= F.lit(cut).cast("float"), k)
    return out.otherwise(1).cast("int")


def consistency() -> Column:
    """1 less the population standard deviation of four parts; missing parts are skipped."""
    parts = F.filter(F.array(F.greatest(1 - F.abs("relative_bias"), F.lit(0.0)) + F.lit(0) * F.col("relative_bias"), clip("nse", 0, 1), F.col("pod"), 1 - F.col("far")), lambda x: x.isNotNull())
    n = F.size(parts)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = F.try_divide(total(parts), n)
    return 1 - F.sqrt(F.try_divide(total(F.transform(parts, lambda x: (x - mean) * (x - mean))), n))


def confidence(sample: Column | None = None) -> Column:
    """`sample`: the share of years with metrics, for metrics by year; None for pooled ones."""
    ks = clip("ks_pvalue", 0, 1)
    return _weighted((0.6, consistency()), (0.4, ks)) if sample is None else _weighted((0.4, sample), (0.3, ks), (0.3, consistency()))


def assess(metrics: DataFrame, weights: tuple[float, float, float] = (0.4, 0.3, 0.3), cuts: tuple[float, float, float] = (0.4, 0.6, 0.8)) -> DataFrame:
    """The metrics with five scores and the category."""
    out = metrics.withColumns({"basic_statistical_quality": basic(), "distribution_quality": distribution(), "temporal_quality": temporal()})
    out = out.withColumn("continuous_quality", continuous(weights))
    return out.withColumns({"categorical_quality": category(cuts=cuts), "confidence_level": confidence()})
