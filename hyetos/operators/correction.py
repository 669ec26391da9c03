"""The correction chain: mean scaling, parametric quantile mapping with a heavy tail, and blending with a predictor.

Sums, percentiles and joins are aggregates by cell and dekad. Python gets only what needs iteration: gamma fits from
two means, tail fits on the excesses of a cell, and the mapping itself, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyetos.functions.scalar import div, effective_alpha
from hyetos.functions.special import digamma, gamma_cdf, gamma_quantile, trigamma
from hyetos.operators.metrics import percentiles

CELL = ("month", "dekad", "lat_i", "lon_i")
PARAMETERS = ("gamma_shape", "gamma_scale", "gpd_threshold", "gpd_shape", "gpd_loc", "gpd_scale", "upper_cap", "p_threshold", "p_dry")


def scaling_factor(pairs: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """mean(ref) / mean(test) of each group; 1 if the test's mean is 0, NULL if one is missing."""
    means = pairs.groupBy(*keys).agg(F.avg("ref").alias("_r"), F.avg("test").alias("_t"))
    return means.select(*keys, _factor().alias("factor"))


def _factor() -> Column:
    return F.when(F.col("_t") == 0, F.when(F.col("_r").isNotNull(), 1.0)).otherwise(div("_r", "_t"))


def scale(pairs: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """The test series times its group's factor."""
    # A window: series and factors come from one shuffle and one run.
    w = W.partitionBy(*keys)
    means = pairs.dropna(subset=list(keys)).withColumns({"_r": F.avg("ref").over(w), "_t": F.avg("test").over(w)})
    return means.withColumn("scaled", F.col("test") * _factor()).drop("_r", "_t")


def l_moments(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """l1 to l4 and the ratios t2, t3, t4 from unbiased weighted moments; NULL under four values, or for a ratio without denominator."""
    order = W.partitionBy(*keys).orderBy(value)
    x = rows.filter(F.col(value).isNotNull()).withColumns({"_i": (F.row_number().over(order) - 1).cast("double"), "_n": F.count("*").over(W.partitionBy(*keys)).cast("double"), "_x": F.col(value).cast("double")})
    i, n, v = F.col("_i"), F.col("_n"), F.col("_x")
    b = [F.avg(v), F.avg(div(i, n - 1) * v), F.avg(div(i * (i - 1), (n - 1) * (n - 2)) * v), F.avg(div(i * (i - 1) * (i - 2), (n - 1) * (n - 2) * (n - 3)) * v)]
    s = x.groupBy(*keys).agg(F.count("*").alias("n"), *[y.alias(f"_b{k}") for k, y in enumerate(b)])
    b0, b1, b2, b3 = (F.col(f"_b{k}") for k in range(4))
    l1, l2, l3, l4 = b0, 2 * b1 - b0, 6 * b2 - 6 * b1 + b0, 20 * b3 - 30 * b2 + 12 * b1 - b0
    few = lambda y: F.when(F.col("n") >= 4, y)
    return s.select(*keys, "n", *[few(y).alias(k) for k, y in {"l1": l1, "l2": l2, "l3": l3, "l4": l4, "t2": div(l2, l1), "t3": div(l3, l2), "t4": div(l4, l2)}.items()])


def solve_gamma(mean: np.ndarray, mean_log: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape and scale of largest likelihood with location 0, from the mean and the mean logarithm; (1, 1) under five values or without a solution."""
    gap = np.log(np.where(mean > 0, mean, 1.0)) - mean_log
    ok = (n >= 5) & (mean > 0) & (gap > 1e-12) & np.isfinite(gap)
    s = np.where(ok, gap, 1.0)
    k = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(30):
        k = np.maximum(k - (np.log(k) - digamma(k) - s) / (1 / k - trigamma(k)), k / 10)
    ok &= np.isfinite(k) & (k > 0)
    return np.where(ok, k, 1.0), np.where(ok, mean / np.where(ok, k, 1.0), 1.0)


@F.pandas_udf(T.StructType([T.StructField("shape", T.DoubleType()), T.StructField("scale", T.DoubleType())]))
def gamma_of(mean: pd.Series, mean_log: pd.Series, n: pd.Series) -> pd.DataFrame:
    k, s = solve_gamma(mean.fillna(0).to_numpy(float), mean_log.fillna(0).to_numpy(float), n.to_numpy(float))
    return pd.DataFrame({"shape": k, "scale": s})


def fit_gamma(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Gamma fits of the positive values of each group: only two means leave the JVM."""
    x = F.when(F.col(value) > 0, F.col(value))
    s = rows.groupBy(*keys).agg(F.avg(x).alias("m"), F.avg(F.ln(x)).alias("ml"), F.count(x).alias("n"))
    return s.withColumn("g", gamma_of("m", "ml", "n")).select(*keys, "n", F.col("g.shape").alias("shape"), F.lit(0.0).alias("loc"), F.col("g.scale").alias("scale"))


def fit_gpd_many(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape and scale of largest likelihood for excesses over a threshold, by the one-parameter profile of shape / scale.

    One fit for each row of `x`; values that aren't positive are no excesses. (0, 1) under two excesses.
    """
    x = np.where(x > 0, x, 0.0)
    n = (x > 0).sum(axis=1)
    few = n < 2
    mean, top = np.where(few, 1.0, x.sum(axis=1) / np.maximum(n, 1)), np.where(few, 1.0, x.max(axis=1, initial=0.0))
    low = -(1 - 1e-9) / top
    grid = np.concatenate([low[:, None] * np.linspace(1, 1e-4, 80), np.geomspace(1e-6, 50, 160) / mean[:, None]], axis=1)
    rows = np.arange(len(x))

    def logs(theta: np.ndarray) -> np.ndarray:
        """The sum of log(1 + theta * x), with one logarithm for eight values: that of their product, or where it is near one of its distance from it."""
        total = np.zeros_like(theta)
        for at in range(0, x.shape[1], 8):
            over = theta * x[:, at : at + 1]
            product = 1 + over
            for k in range(at + 1, min(at + 8, x.shape[1])):
                other = theta * x[:, k : k + 1]
                over, product = over + other + over * other, product * (1 + other)
            low = over < -0.5
            part = np.log1p(np.where(low, 0.0, over))
            part[low] = np.log(product[low])
            total += part
        return total

    def profile(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = logs(theta) / np.maximum(n, 1)[:, None]
        shape = np.where(np.abs(theta) < 1e-12 / mean[:, None], 0.0, shape)
        ratio = np.where(shape == 0, mean[:, None], shape / np.where(theta == 0, 1, theta))
        return np.where((shape > -1) & (ratio > 0), -np.log(np.maximum(ratio, 1e-300)) - shape - 1, -np.inf), shape

    for _ in range(6):
        k = profile(grid)[0].argmax(axis=1)
        first, last = grid[rows, np.maximum(0, k - 1)], grid[rows, np.minimum(grid.shape[1] - 1, k + 1)]
        grid = np.linspace(first, last, 25, axis=1)
    likelihood, shape = profile(grid)
    k = likelihood.argmax(axis=1)
    best, shape, theta = likelihood[rows, k], shape[rows, k], grid[rows, k]
    flat = ~np.isfinite(best) | (best < -np.log(mean) - 1)
    scale = np.where(flat | (theta == 0), mean, shape / np.where(theta == 0, 1, theta))
    return np.where(few | flat, 0.0, shape), np.where(few, 1.0, scale)


def fit_gpd(excess: np.ndarray) -> tuple[float, float]:
    """`fit_gpd_many` of one sample."""
    shape, scale = fit_gpd_many(np.asarray(excess, float).reshape(1, -1))
    return float(shape[0]), float(scale[0])


def folds_of(n: int, folds: int = 5, seed: int = 42) -> list[np.ndarray]:
    """The places that each fold leaves out of n, from a seeded shuffle."""
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    return np.array_split(order, folds)


def fit_tails_of(samples: list[np.ndarray], cross_validate: bool, folds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of many samples of excesses in their own order: with folds, averaged over fits that leave out one fold each."""
    shape, scale = np.zeros(len(samples)), np.ones(len(samples))
    by_size: dict[int, list[int]] = {}
    for k, x in enumerate(samples):
        by_size.setdefault(len(x), []).append(k)
    for n, at in by_size.items():
        parts = folds_of(n, folds) if cross_validate and n >= folds else [np.zeros(0, int)] if n >= 10 else []
        for some in np.array_split(np.array(at), len(at) * 240 // 50_000 + 1):  # small enough for a core's cache
            x = np.stack([samples[k] for k in some])
            fits = [fit_gpd_many(np.delete(x, part, axis=1)) for part in parts]
            if fits:
                shape[some], scale[some] = np.mean([f[0] for f in fits], axis=0), np.mean([f[1] for f in fits], axis=0)
    return shape, scale


def fit_gpd_folds(excess: np.ndarray, folds: int = 5) -> tuple[float, float]:
    """`fit_tails_of` one sample."""
    shape, scale = fit_tails_of([np.asarray(excess, float)], True, folds)
    return float(shape[0]), float(scale[0])


@F.pandas_udf(T.StructType([T.StructField("gpd_shape", T.DoubleType()), T.StructField("gpd_scale", T.DoubleType())]))
def tails_of(excess: pd.Series) -> pd.DataFrame:
    shape, scale = fit_tails_of([np.asarray(x, float) for x in excess], True)
    return pd.DataFrame({"gpd_shape": shape, "gpd_scale": scale})


def fit_tails(rows: DataFrame, limits: DataFrame, keys: Sequence[str], value: str = "value", cross_validate: bool = True, time: str = "time") -> DataFrame:
    """Tail fits of the values above each group's `gpd_threshold`; only those values leave the JVM, as one array a group.

    Folds are dealt over the excesses in the order of `time`, where rows have it, else of size.
    """
    over = rows.join(limits.select(*keys, "gpd_threshold"), list(keys)).filter((F.col(value) > F.col("gpd_threshold")) & (F.col("gpd_threshold") > 0))
    excess = (F.col(value) - F.col("gpd_threshold")).cast("double").alias("excess")
    over = over.select(*keys, F.struct(*([F.col(time).alias("at")] if time in rows.columns else []), excess).alias("one"))

    @F.pandas_udf("gpd_shape double, gpd_scale double")
    def fitted(excess: pd.Series) -> pd.DataFrame:
        shape, scale = fit_tails_of([np.asarray(x, float) for x in excess], cross_validate)
        return pd.DataFrame({"gpd_shape": shape, "gpd_scale": scale})

    cells = over.groupBy(*keys).agg(F.sort_array(F.collect_list("one"))["excess"].alias("x"))
    return cells.select(*keys, fitted("x").alias("g"), F.size("x").cast("long").alias("n_excess")).select(*keys, "g.*", "n_excess")


@F.pandas_udf(T.DoubleType())
def gamma_cdf_of(x: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    return pd.Series(gamma_cdf(x.to_numpy(float), shape.to_numpy(float), scale.to_numpy(float)))


def reference_parameters(rows: DataFrame, keys: Sequence[str] = CELL, value: str = "value", wet: float = 1.0, percentile: float = 0.8, cap: float = 0.999, min_wet: int = 10) -> DataFrame:
    """The nine parameters of each group with at least ten wet values (strictly above `wet`)."""
    x = F.when(F.col(value) > wet, F.col(value))
    # A group's wet values as an array: the percentiles and the excesses come from it, rows aren't read or joined again.
    days = F.collect_list(F.when(F.col(value) > wet, F.struct(*([F.col("time").alias("at")] if "time" in rows.columns else []), F.col(value).cast("double").alias("x"))))
    s = rows.groupBy(*keys).agg(F.count(x).alias("n_wet"), F.count(value).alias("n_valid"), F.avg(x).alias("m"), F.avg(F.ln(x)).alias("ml"), days.alias("_days")).filter(F.col("n_wet") >= min_wet)
    s = s.withColumns({"_x": F.sort_array("_days")["x"], "_q": percentiles(F.sort_array(F.col("_days")["x"]), (percentile, cap))}).withColumns({"gpd_threshold": F.col("_q")[0], "upper_cap": F.col("_q")[1]})
    limit = F.col("gpd_threshold")
    s = s.withColumn("_over", F.when(limit > 0, F.transform(F.filter("_x", lambda v: v > limit), lambda v: v - limit)).otherwise(F.array().cast("array<double>"))).drop("_days", "_x", "_q")
    s = s.withColumns({"g": gamma_of("m", "ml", "n_wet"), "t": tails_of("_over")}).withColumns({"gamma_shape": F.col("g.shape"), "gamma_scale": F.col("g.scale"), "p_dry": 1 - div("n_wet", "n_valid")})
    s = s.withColumn("p_threshold", gamma_cdf_of("gpd_threshold", "gamma_shape", "gamma_scale"))
    return s.select(*keys, "gamma_shape", "gamma_scale", "gpd_threshold", "t.gpd_shape", F.lit(0.0).alias("gpd_loc"), "t.gpd_scale", "upper_cap", "p_threshold", "p_dry")


def _unit(p: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """The place of p between floor and 1, away from both ends; the lower end where nothing is left above floor."""
    room = 1 - floor
    return np.clip(np.where(room > 1e-10, (p - floor) / np.where(room > 1e-10, room, 1), 0), 1e-10, 1 - 1e-10)


def map_values(x: np.ndarray, sat: dict[str, np.ndarray], ref: dict[str, np.ndarray], wet: float, tail: np.ndarray) -> np.ndarray:
    """Mapped values of wet inputs: the body by both gammas, the part above the input's own threshold by the tail."""
    u = sat["p_dry"] + (1 - sat["p_dry"]) * gamma_cdf(x, sat["shape"], sat["scale"])
    # Rows of a group follow each other: its limit's place is worked out at the first of them.
    own = np.stack([sat["limit"], sat["shape"], sat["scale"]])
    first = np.append(True, (own[:, 1:] != own[:, :-1]).any(axis=0))
    u_limit = sat["p_dry"] + (1 - sat["p_dry"]) * gamma_cdf(*own[:, first])[np.cumsum(first) - 1]
    v = _unit(u, u_limit)
    shape = np.where(ref["gpd_shape"] == 0, 1.0, ref["gpd_shape"])
    heavy = np.where(ref["gpd_shape"] == 0, -ref["gpd_scale"] * np.log1p(-v), ref["gpd_scale"] / shape * ((1 - v) ** -shape - 1))
    in_tail = (x > sat["limit"]) & (1 - u_limit > 1e-10) & tail
    y = np.where(in_tail, heavy + ref["gpd_loc"] + ref["gpd_threshold"], 0.0)
    body = ~in_tail & ~(u < ref["p_dry"])
    y[body] = np.maximum(gamma_quantile(_unit(u, ref["p_dry"])[body], ref["gamma_shape"][body], ref["gamma_scale"][body]), wet)
    return np.maximum(np.minimum(y, ref["upper_cap"]), 0.0)


PERIOD = ("month", "dekad")


def isolated(run: Callable[[pd.DataFrame], pd.DataFrame], batches: Iterator[pd.DataFrame], made: Sequence[str], keys: Sequence[str] = PERIOD) -> Iterator[pd.DataFrame]:
    """`run` of each batch with a column `error`: where it fails, of each period apart, so that those that fail alone get a text and no values."""
    for one in batches:
        try:
            yield run(one).assign(error=None)
        except Exception:  # noqa: BLE001
            for _, part in one.groupby(list(keys), sort=False, dropna=False):
                try:
                    yield run(part).assign(error=None)
                except Exception as failure:  # noqa: BLE001
                    yield part.assign(**dict.fromkeys(made, None), error=f"{type(failure).__name__}: {failure}")


def quantile_map(
    rows: DataFrame, parameters: DataFrame, keys: Sequence[str] = CELL, value: str = "value", wet: float = 1.0, percentile: float = 0.8, min_wet: int = 5, *, isolate: bool = False, mapper: Callable | None = None,
) -> DataFrame:
    """`rows` with `mapped`. Cells without parameters are missing; cells of zeros stay zero, missing days too; cells with
    fewer than five wet values become zero; values that aren't wet become zero.

    `isolate`: with a column `error`, as an error in a period's values leaves all other periods be. `mapper` in place of `map_values`.
    """
    mapper, keys = mapper or map_values, list(keys)
    x = F.when(F.col(value) > wet, F.col(value))
    rest = [c for c in rows.columns if c not in keys]
    # A group's rows wait beside its sums, so that they are shuffled once and joined with nothing.
    own = rows.dropna(subset=keys).groupBy(*keys).agg(
        F.count(x).alias("s_n"), F.count(value).alias("s_valid"), F.avg(x).alias("m"), F.avg(F.ln(x)).alias("ml"), F.max(F.abs(value)).alias("s_max"), F.collect_list(F.struct(*rest)).alias("_rows"),
    )
    wet_days = F.filter(F.col("_rows")[value].cast("array<double>"), lambda v: v > wet)
    own = own.withColumns({"g": gamma_of("m", "ml", "s_n"), "s_limit": percentiles(F.sort_array(wet_days), (percentile,))[0]})
    own = own.select(*keys, "s_n", "s_limit", "s_max", (1 - div("s_n", "s_valid")).alias("s_dry"), F.col("g.shape").alias("s_shape"), F.col("g.scale").alias("s_scale"), "_rows")
    fitted = ["s_n", "s_limit", "s_max", "s_dry", "s_shape", "s_scale", *PARAMETERS]
    joined = own.join(parameters.select(*keys, *PARAMETERS), keys, "left").select(*keys, *fitted, F.explode("_rows").alias("_row")).select(*[f"_row.{c}" if c in rest else c for c in rows.columns], *fitted)

    # Dates go out as numbers: as Python's dates they would be objects.
    days = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.DateType)]
    joined, rows_of = joined.withColumns({c: F.unix_date(c) for c in days}), rows.columns

    def mapped(one: pd.DataFrame) -> pd.DataFrame:
        column = lambda c: one[c].to_numpy(float)
        y, v = np.full(len(one), np.nan), column(value)
        known = ~np.isnan([column(c) for c in ("gamma_shape", "gamma_scale", "gpd_threshold", "p_dry")]).any(axis=0)
        y[known & ~np.isnan(v)] = 0.0
        y[known & (column("s_max") == 0)] = 0.0
        at = known & (column("s_n") >= min_wet) & (v > wet)
        if at.any():
            sat = {k: column(c)[at] for k, c in (("p_dry", "s_dry"), ("shape", "s_shape"), ("scale", "s_scale"), ("limit", "s_limit"))}
            ref = {c: column(c)[at] for c in PARAMETERS}
            y[at] = mapper(v[at], sat, ref, wet, ref["gpd_threshold"] > 0)
        return one[rows_of].assign(mapped=y)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for made in isolated(mapped, batches, ["mapped"]) if isolate else map(mapped, batches):
            yield made[names]

    added = [T.StructField("mapped", T.DoubleType())] + [T.StructField("error", T.StringType())] * isolate
    names = [*rows.columns, *[f.name for f in added]]
    out = joined.mapInPandas(run, T.StructType([*[joined.schema[c] for c in rows.columns], *added]))
    return out.withColumns({c: F.date_from_unix_date(c) for c in days})


def pair_parameters(pairs: DataFrame, keys: Sequence[str] = CELL, wet: float = 1.0, percentile: float = 0.8) -> DataFrame:
    """Parameters of the reference on the days that both sides share."""
    return reference_parameters(both_sides(pairs), keys, "ref", wet, percentile, min_wet=5)


def both_sides(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("ref").isNotNull() & F.col("test").isNotNull())


def quantile_map_pairs(pairs: DataFrame, keys: Sequence[str] = CELL, wet: float = 1.0, percentile: float = 0.8, *, fitted: DataFrame | None = None, **options) -> DataFrame:
    """Both sides are fitted on the days they share; zero where either has fewer than five wet days. `test` is mapped to `ref`."""
    fitted = pair_parameters(pairs, keys, wet, percentile) if fitted is None else fitted
    out = quantile_map(both_sides(pairs), fitted, keys, "test", wet, percentile, **options)
    zero = F.coalesce("mapped", F.lit(0.0))
    return out.withColumn("mapped", F.when(F.col("error").isNull(), zero) if "error" in out.columns else zero)


def rank_map(pairs: DataFrame, keys: Sequence[str], weight: float = 1.0) -> DataFrame:
    """Each test value becomes the reference value of its rank; blended with itself by 1 - weight."""
    both = pairs.filter(F.col("ref").isNotNull() & F.col("test").isNotNull())
    rank = lambda side: F.row_number().over(W.partitionBy(*keys).orderBy(side, "time"))
    t = both.select(*keys, "time", "test", rank("test").alias("_k"))
    r = both.select(*keys, F.col("ref").alias("_q"), rank("ref").alias("_k"))
    return t.join(r, [*keys, "_k"]).select(*keys, "time", "test", ((1 - weight) * F.col("test") + weight * F.col("_q")).alias("mapped"))


def with_limits(rows: DataFrame, keys: Sequence[str] = CELL, percentile: float = 0.8) -> DataFrame:
    """`rows` with `limit`, the percentile of a cell's values, zeros included; a cell's rows lie together."""
    # A window, so that limit and values come from one run of `rows`: sums of a second run may differ in their last bit.
    return rows.dropna(subset=list(keys)).withColumn("limit", F.percentile("value", F.lit(percentile)).over(W.partitionBy(*keys)))


def blend(rows: DataFrame, keys: Sequence[str] = CELL, alpha: float = 0.7, confidence: str | None = None, percentile: float = 0.8, limited: bool = False) -> DataFrame:
    """`rows` (value, predicted) with `blended`: values above their cell's percentile, zeros included, give way to the
    prediction by 1 - alpha, less where there is little confidence; all others stay. `limited`: rows have their `limit` already."""
    table = rows if limited else with_limits(rows, keys, percentile)
    a = effective_alpha(confidence, alpha) if confidence else F.lit(alpha)
    x = F.col("value")
    use = (x > F.col("limit")) & (x > 0) & F.col("predicted").isNotNull()
    return table.withColumn("blended", F.when(use, a * x + (1 - a) * F.col("predicted")).otherwise(x)).drop("limit")


def day_normalised(rows: DataFrame, time: str = "time") -> DataFrame:
    """With `scaled`: each value over its day's largest one."""
    return rows.withColumn("_max", F.max("value").over(W.partitionBy(time))).withColumn("scaled", F.coalesce(div("value", "_max"), F.lit(0.0)))


def predict(rows: DataFrame, predictor: Callable[[np.ndarray], np.ndarray], rows_n: int, columns_n: int, time: str = "time") -> DataFrame:
    """`rows` with `predicted`: a predictor sees one day's field, divided by its largest value, as an array."""

    def run(one: pd.DataFrame) -> pd.DataFrame:
        field = np.zeros((rows_n, columns_n))
        at = one["lat_i"].to_numpy(int), one["lon_i"].to_numpy(int)
        field[at] = np.nan_to_num(one["value"].to_numpy(float))
        top = field.max()
        made = np.maximum(predictor(field / top) * top, 0) if top > 0 else field
        return one.assign(predicted=made[at])

    schema = T.StructType([*rows.schema.fields, T.StructField("predicted", T.DoubleType())])
    return rows.groupBy(time).applyInPandas(run, schema)


STEPS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


#: Cells along a block's side, and days in a block where time is a date: as many cells as one day of 512 x 512.
SIDE, DAYS = 180, 8


def _in_blocks(rows: DataFrame, side: int) -> DataFrame:
    """`rows` with the block _t, _a, _b that each is seen from, and whether it is its own.

    Fields are cut into square blocks of a few days, and cells at a border also go to the block next to it, so that each row is
    shuffled once, whatever the size of the field, and a task holds one block at a time. Borders lie half a side off 0, so that
    the first cells of a grid are no border.
    """
    place = lambda x, step: F.floor((F.col(x) + (step + side // 2)) / side)
    blocks = lambda x: F.explode(F.array_distinct(F.array(*[place(x, step) for step in (-1, 0, 1)])))
    days = F.floor(F.unix_date("time") / DAYS) if isinstance(rows.schema["time"].dataType, T.DateType) else F.col("time")
    at = rows.filter("time is not null and lat_i is not null and lon_i is not null").withColumn("_t", days).withColumn("_a", blocks("lat_i")).withColumn("_b", blocks("lon_i"))
    return at.withColumn("_own", (F.col("_a") == place("lat_i", 0)) & (F.col("_b") == place("lon_i", 0)))


def _around(one: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: which rows are its own, of these the values of the 3 x 3 cells around, 0 where there is none, and where none of the nine is."""
    t = one["time"].combine_chunks().dictionary_encode().indices.to_numpy()
    i, j = (one[x].to_numpy().astype(int) for x in ("lat_i", "lon_i"))
    v = one["value"].cast(pa.float64()).to_numpy().astype(float)
    i, j = i - i.min() + 1, j - j.min() + 1
    # A day's cells lie in one row, so that a neighbour is a fixed step away.
    width = j.max() + 2
    cell = (t * (i.max() + 2) + i) * width + j
    size = (t.max() + 1) * (i.max() + 2) * width
    there = ~np.isnan(v)
    field = np.bincount(cell[there], weights=v[there], minlength=size).astype(float)  # without a value they would be integers
    known = np.zeros(size, bool)
    known[cell[there]] = True
    own = one["_own"].to_numpy().astype(bool)
    near = cell[own][:, None] + np.array([a * width + b for a, b in STEPS])
    return own, field[near], ~known[near].any(axis=1)


def _combinations(part: pa.Table, keys: Sequence[str]) -> list[tuple[int, np.ndarray]]:
    """The combinations of keys in a block: the first row of each, and which rows have it. Mostly there is one, that of the day."""
    codes = np.stack([part[k].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy() for k in keys], axis=1)
    if (codes == codes[0]).all():
        return [(0, np.ones(len(codes), bool))]
    some, first, at = np.unique(codes, axis=0, return_index=True, return_inverse=True)
    return [(int(first[n]), at.ravel() == n) for n in range(len(some))]


def neighbourhoods(rows: DataFrame, side: int = SIDE) -> DataFrame:
    """`rows` (time, lat_i, lon_i, value) with _x0 to _x8: the values of the 3 x 3 cells around, 0 where there is none; NULL where none of the nine is."""
    names, columns = [f"_x{k}" for k in range(9)], rows.columns

    def around(one: pa.Table) -> pa.Table:
        own, x, none = _around(one)
        kept = one.filter(pa.array(own)).select(columns)
        for k, name in enumerate(names):
            kept = kept.append_column(name, pa.array(x[:, k], mask=none))
        return kept

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema.fields], *[T.StructField(x, T.DoubleType()) for x in names]])
    return _in_blocks(rows, side).groupBy("_t", "_a", "_b").applyInArrow(around, schema)


def train_filter(rows: DataFrame, keys: Sequence[str] = ("month", "dekad"), ridge: float = 1e-3, side: int = SIDE) -> DataFrame:
    """A linear 3 x 3 filter for each dekad, by least squares of the reference on the neighbourhood: (keys, weights).

    The normal equations are sums over rows, so each block of a day's field adds up its own, and 110 numbers a block are
    shuffled. `rows` has value and ref on (time, lat_i, lon_i).
    """
    table, keys = rows.select(*keys, "time", "lat_i", "lon_i", "value", "ref"), list(keys)
    schema = T.StructType([*[table.schema[k] for k in keys], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("xx", "xy")]])

    def add(one: pa.Table) -> pa.Table:
        own, x, _ = _around(one)
        part = one.filter(pa.array(own))
        y, v = (part[c].cast(pa.float64()).to_numpy().astype(float) for c in ("ref", "value"))
        good = ~np.isnan(y) & ~np.isnan(v)
        part, x, y = part.filter(pa.array(good)), np.append(x, np.ones((len(x), 1)), axis=1)[good], y[good]
        parts = _combinations(part, keys) if len(y) else []
        first = part.select(keys).take(pa.array([k for k, _ in parts], pa.int64()))
        for name, made in (("xx", [(x[at].T @ x[at]).ravel() for _, at in parts]), ("xy", [x[at].T @ y[at] for _, at in parts])):
            first = first.append_column(name, pa.array(made, pa.list_(pa.float64())))
        return first

    blocks = _in_blocks(table, side).groupBy("_t", "_a", "_b").applyInArrow(add, schema)
    sums = blocks.groupBy(*keys).agg(*[F.array(*[F.sum(F.get(c, F.lit(k))) for k in range(n)]).alias(c) for c, n in (("xx", 100), ("xy", 10))])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([solved(np.array(a, float).reshape(10, 10) + ridge * np.eye(10), np.array(b, float)) for a, b in zip(xx, xy, strict=True)])

    def solved(a: np.ndarray, b: np.ndarray) -> list[float] | None:
        """None where a dekad's equations have no finite solution."""
        try:
            out = np.linalg.solve(a, b)
        except np.linalg.LinAlgError:
            return None
        return out.tolist() if np.isfinite(out).all() else None

    return sums.select(*keys, solve("xx", "xy").alias("weights"))


def apply_filter(rows: DataFrame, models: DataFrame, keys: Sequence[str] = ("month", "dekad"), side: int = SIDE) -> DataFrame:
    """`rows` with `predicted` from a dekad's trained filter, at least 0, and 0 where it has no weights; rows without a filter are left out.

    One filter a dekad, at most 36, goes out with the tasks.
    """
    keys = list(keys)
    found = {tuple(r[k] for k in keys): r["weights"] for r in models.select(*keys, "weights").dropna(subset=keys).collect()}
    found = {k: np.array(w if w is not None else [0.0] * 10, float) for k, w in found.items()}
    columns = [c for c in rows.columns if c != "predicted"]

    def run(one: pa.Table) -> pa.Table:
        own, x, none = _around(one)
        kept = one.filter(pa.array(own)).select(columns)
        made, known = np.zeros(len(x)), np.zeros(len(x), bool)
        for k, at in _combinations(kept, keys) if len(x) else []:
            w = found.get(tuple(kept[c][k].as_py() for c in keys))
            if w is not None:
                made[at], known[at] = x[at] @ w[:9] + w[9], True
        made = np.where(none, 0.0, np.maximum(made, 0.0))
        return kept.append_column("predicted", pa.array(made)).filter(pa.array(known))

    schema = T.StructType([*[T.StructField(rows.schema[c].name, rows.schema[c].dataType) for c in columns], T.StructField("predicted", T.DoubleType())])
    return _in_blocks(rows.select(*columns), side).groupBy("_t", "_a", "_b").applyInArrow(run, schema)
