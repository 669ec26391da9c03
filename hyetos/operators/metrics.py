"""The 31 verification metrics of paired series, for any grouping keys.

Pairs are rows with `ref` and `test`; rows where either is missing are dropped first. `metrics31` groups them once: sums,
and the group's days as an array, as a group (a cell or station in a season) has no more days than the calendar. Percentiles,
dry spells and the distance of the two distributions come from that array. `dry_spells` and `ks_statistic` of groups of any
size come from windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyetos.functions.scalar import c, clip, div, div0
from hyetos.functions.special import ks_pvalue

PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
NAMES = (
    "relative_bias", "pearson_correlation", "rmse", "mae", "ref_stdev", "test_stdev", "stdev_ratio", "pod", "far", "csi", "fpd_ref", "fpd_test",
    "mdwp_ref", "mdwp_test", "nse", "dsl_ref", "dsl_test", "ks_stat", "ks_pvalue",
    *(f"p{round(100 * p)}_{side}" for p in PERCENTILES for side in ("ref", "test")),
)


def paired(a: DataFrame, b: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """Inner join on time and place; `ref` from the first, `test` from the second. An empty overlap is an empty table."""
    return a.select(*on, F.col(value).alias("ref")).join(b.select(*on, F.col(value).alias("test")), list(on))


def valid(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("ref").isNotNull() & F.col("test").isNotNull())


def dry_spells(pairs: DataFrame, keys: Sequence[str], threshold: float = 1.0, time: str = "time") -> DataFrame:
    """The longest runs of dry rows of either side, in time order over the rows that are left."""
    order = W.partitionBy(*keys).orderBy(time)
    # The place of a row less that of the last wet one: both sides, and all other windows by keys and time, need one sort only.
    out = valid(pairs).select(*keys, time, "ref", "test").withColumn("_place", F.row_number().over(order))
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    run = lambda side: F.col("_place") - F.coalesce(F.max(F.when(~F.coalesce(F.col(side) < threshold, F.lit(False)), F.col("_place"))).over(upto), F.lit(0))
    out = out.select(*keys, *[run(side).alias(f"_n_{side}") for side in ("ref", "test")])
    n = F.count("*")
    return out.groupBy(*keys).agg(*[F.when(n >= 2, F.max(f"_n_{side}")).cast("double").alias(f"dsl_{side}") for side in ("ref", "test")])


def ks_statistic(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The largest distance of the two empirical distributions."""
    one = valid(pairs).select(*keys, F.explode(F.array(F.struct(F.col("ref").alias("x"), F.lit(1).alias("s")), F.struct(F.col("test").alias("x"), F.lit(-1).alias("s")))).alias("v")).select(*keys, "v.*")
    upto = W.partitionBy(*keys).orderBy("x").rangeBetween(W.unboundedPreceding, W.currentRow)
    n = F.count("*") / 2
    return one.withColumn("gap", F.abs(F.sum("s").over(upto))).groupBy(*keys).agg(F.when(n >= 2, div(F.max("gap"), n)).alias("ks_stat"))


def percentiles(values: Column | str, shares: Sequence[float] = PERCENTILES) -> Column:
    """As `percentile` of each share, of an array in ascending order; missing for an empty one."""
    x = c(values)
    # A lambda, so that the code of a dozen shares stays short enough to be compiled.
    place = lambda p: p * (F.size(x) - 1)
    low, high = (lambda p: F.floor(place(p))), (lambda p: F.ceil(place(p)))
    at = lambda k: F.get(x, k.cast("int"))
    between = lambda p: (high(p) - place(p)) * at(low(p)) + (place(p) - low(p)) * at(high(p))
    return F.transform(F.array(*map(F.lit, shares)), lambda p: F.when(at(low(p)) == at(high(p)), at(low(p))).otherwise(between(p)))


def _spells(days: Column, threshold: float) -> Column:
    """The longest dry runs (ref, test) of an array of days in order."""
    run = lambda s, d, side: F.when(d[side] < threshold, s[f"now_{side}"] + 1).otherwise(0)
    step = lambda s, d: F.struct(*[x for side in ("ref", "test") for x in (run(s, d, side).alias(f"now_{side}"), F.greatest(s[side], run(s, d, side)).alias(side))])
    return F.aggregate(days, F.struct(*[F.lit(0).alias(x) for x in ("now_ref", "ref", "now_test", "test")]), step)


def _gap(ref: Column, test: Column) -> Column:
    """The most by which the counts up to a value differ, over all values of two arrays of one size."""
    side = lambda values, s: F.transform(values, lambda x: F.struct(x.alias("x"), F.lit(s).alias("s")))
    both = F.sort_array(F.concat(side(ref, 1), side(test, -1)))
    # A count is whole once the next value is another one; after the last value it is 0.
    step = lambda a, v: F.struct(v["x"].alias("x"), (a["n"] + v["s"]).alias("n"), F.when(a["x"] == v["x"], a["most"]).otherwise(F.greatest(a["most"], F.abs(a["n"]))).alias("most"))
    return F.aggregate(both, F.struct(F.lit(None).cast("double").alias("x"), F.lit(0).alias("n"), F.lit(0).alias("most")), step)["most"]


def metrics31(pairs: DataFrame, keys: Sequence[str], threshold: float = 1.0, time: str = "time", pvalue: bool = True) -> DataFrame:
    """All metrics, a row for each group, with n. `pvalue`: also the one that needs a Python function."""
    keys, r, t = list(keys), F.col("ref"), F.col("test")
    wet_r, wet_t = r >= threshold, t >= threshold
    count = lambda x: F.count(F.when(x, 1))
    both = valid(pairs).withColumns({side: F.col(side).cast("double") for side in ("ref", "test")})
    days = F.collect_list(F.struct(F.col(time).alias("at"), "ref", "test"))
    one = both.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(r).alias("_r"), F.sum(t).alias("_t"), F.avg((t - r) ** 2).alias("_mse"), F.avg(F.abs(t - r)).alias("mae"),
        F.stddev_samp(r).alias("ref_stdev"), F.stddev_samp(t).alias("test_stdev"), F.var_pop(r).alias("_vr"), F.var_pop(t).alias("_vt"), F.covar_pop(r, t).alias("_cov"),
        count(wet_r & wet_t).alias("hits"), count(wet_r & ~wet_t).alias("misses"), count(~wet_r & wet_t).alias("false_alarms"),
        F.avg(F.when(wet_r, r)).alias("mdwp_ref"), F.avg(F.when(wet_t, t)).alias("mdwp_test"),
        # Here and not in a projection, as a caller's filter of a metric would take that along and work through the arrays once more for each use.
        F.sort_array(days["ref"]).alias("_ref"), F.sort_array(days["test"]).alias("_test"), _spells(F.sort_array(days), threshold).alias("_spells"), _gap(days["ref"], days["test"]).alias("_gap"),
    )
    one = one.withColumns({f"_p{side[0]}": percentiles(f"_{side}") for side in ("ref", "test")})
    h, m, f, n = (F.col(x) for x in ("hits", "misses", "false_alarms", "n"))
    varies_r, varies_t = (F.get(x, n.cast("int") - 1) > F.get(x, F.lit(0)) for x in ("_ref", "_test"))
    out = {
        "relative_bias": div(F.col("_t") - F.col("_r"), "_r"),
        "pearson_correlation": F.when(varies_r & varies_t, clip(div("_cov", F.sqrt(F.col("_vr") * F.col("_vt"))), -1, 1)),
        "rmse": F.sqrt("_mse"), "mae": F.col("mae"), "ref_stdev": F.col("ref_stdev"), "test_stdev": F.col("test_stdev"),
        "stdev_ratio": F.when(varies_r, div("test_stdev", "ref_stdev")),
        "pod": div0(h, h + m), "far": div0(f, h + f), "csi": div0(h, h + m + f),
        "fpd_ref": 100 * div(h + m, n), "fpd_test": 100 * div(h + f, n), "mdwp_ref": F.col("mdwp_ref"), "mdwp_test": F.col("mdwp_test"),
        "nse": F.when(varies_r, 1 - div("_mse", "_vr")),
        "dsl_ref": F.col("_spells")["ref"].cast("double"), "dsl_test": F.col("_spells")["test"].cast("double"), "ks_stat": div("_gap", n),
    } | {f"p{round(100 * p)}_{side}": F.col(f"_p{side[0]}")[k] for k, p in enumerate(PERCENTILES) for side in ("ref", "test")}
    made = one.select(*keys, "n", *[F.when(n >= 2, x).alias(name) for name, x in out.items()])
    if pvalue:
        made = made.withColumn("ks_pvalue", ks_pvalue(F.col("ks_stat"), F.col("n")))
    return made.select(*keys, "n", *[x for x in NAMES if pvalue or x != "ks_pvalue"])


def yearly(pairs: DataFrame, keys: Sequence[str], threshold: float = 1.0, time: str = "time", pvalue: bool = True) -> DataFrame:
    """The metrics of every year that both sides have."""
    return metrics31(pairs.withColumn("year", F.year(time)), [*keys, "year"], threshold, time, pvalue)


def combos(references: DataFrame, methods: DataFrame) -> DataFrame:
    """Every reference with every method."""
    return references.crossJoin(methods)


def contingency(pairs: DataFrame, keys: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """a, b, c, d and their sum for each group and threshold; an event is a value at or above it."""
    r, t, x = F.col("ref"), F.col("test"), F.col("threshold")
    count = lambda e: F.count(F.when(e, 1))
    each = valid(pairs).withColumn("threshold", F.explode(F.array(*[F.lit(float(v)) for v in thresholds])))
    return each.groupBy(*keys, "threshold").agg(
        count((r >= x) & (t >= x)).alias("a"), count((r < x) & (t >= x)).alias("b"), count((r >= x) & (t < x)).alias("c"), count((r < x) & (t < x)).alias("d"), F.count("*").alias("n"),
    )


def scores(table: DataFrame) -> DataFrame:
    """Ten scores of a 2 x 2 table; NULL where a denominator is 0."""
    a, b, m, d, n = (F.col(x).cast("double") for x in ("a", "b", "c", "d", "n"))
    chance = div((a + m) * (a + b), n)
    pod, pofd = div(a, a + m), div(b, b + d)
    out: dict[str, Column] = {
        "pod": pod, "far": div(b, a + b), "csi": div(a, a + b + m), "fbi": div(a + b, a + m), "ets": div(a - chance, a + b + m - chance),
        "hss": div(2 * (a * d - b * m), (a + m) * (m + d) + (a + b) * (b + d)), "hk": pod - pofd,
        "freq_obs": 100 * div(a + m, n), "freq_prd": 100 * div(a + b, n),
    }
    return table.withColumns(out | {"n_events": F.col("a") + F.col("c")})


def supported(scored: DataFrame, min_events: int = 10) -> DataFrame:
    """Scores become NULL under `min_events` observed events; counts and frequencies stay."""
    for name in ("pod", "far", "csi", "fbi", "ets", "hss", "hk"):
        scored = scored.withColumn(name, F.when(F.col("n_events") >= min_events, c(name)))
    return scored
