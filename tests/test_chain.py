"""The staged chain: once, resumed, swept, isolated; the rules of the mapping; the confidence table."""

import datetime
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyetos.functions.special import gamma_cdf, gamma_quantile
from hyetos.operators import correction, density, order, report
from hyetos.params import Params
from hyetos.plans import pipelines
from hyetos.plans.stages import Stages, content_key

CELL = list(correction.CELL)
PAIRS = "month int, dekad int, lat_i int, lon_i int, time date, ref double, test double"
WET = Params(wet_day=1.0)


def make(spark, path, periods=((1, 1), (1, 2), (2, 1)), change=lambda m, d, r, t: (r, t)):
    rng, rows = np.random.default_rng(11), []
    for m, d in periods:
        for i in range(3):
            for j in range(3):
                for year in range(2001, 2006):
                    for k in range(8):
                        r, t = rng.gamma(0.8, 9) * (rng.random() < 0.7), rng.gamma(0.6, 7) * (rng.random() < 0.8)
                        rows.append((m, d, i, j, datetime.date(year, m, (d - 1) * 10 + k + 1), *change(m, d, float(r), float(t))))
    spark.createDataFrame(rows, PAIRS).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def pairs(spark, tmp_path_factory):
    return make(spark, str(tmp_path_factory.mktemp("pairs") / "p"))


def same(a, b, keys):
    rows = lambda df: sorted(map(repr, df.select(*keys, F.round("value", 9).alias("v")).collect()))
    assert rows(a) == rows(b)


def test_every_stage_runs_once_and_equals_one_plan(spark, pairs, tmp_path):
    stages = Stages(spark, str(tmp_path / "s"))
    source = stages.source(pairs, content_key(pairs))
    made = pipelines.chain(stages, source, WET)
    assert stages.made == ["scaled", "parameters", "mapped", "filter", "predicted", "blended"]
    got = pipelines.values_of(made)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan and "Exchange" not in plan and plan.count("FileScan") == 3
    mapping = correction.quantile_map_pairs(made["scaled"].df.withColumn("test", F.col("scaled")), wet=1.0, fitted=made["parameters"].df)._jdf.queryExecution().executedPlan().toString()
    assert mapping.count("MapInPandas") == 1
    # The same chain as one plan.
    scaled = correction.scale(pairs).withColumn("scaled", F.greatest("scaled", F.lit(0.0)))
    mapped = correction.quantile_map_pairs(scaled.withColumn("test", F.col("scaled"))).select(*CELL, "time", "ref", F.greatest("mapped", F.lit(0.0)).alias("value"))
    blended = correction.blend(correction.apply_filter(mapped.drop("ref"), correction.train_filter(mapped)))
    for name, df, value in (("ls", scaled, "scaled"), ("lseqm", mapped, "value"), ("lseqmdl", blended, "blended")):
        same(got.filter(F.col("method") == name), df.withColumn("value", F.col(value)), [*CELL, "time"])
    assert got.filter("method = 'lseqm' and value > 0").count() > 100
    # A later run finds all of it, whatever order the rows come in; another alpha blends anew and no more.
    later = Stages(spark, stages.root)
    pipelines.chain(later, later.source(pairs.repartition(5), content_key(pairs.repartition(5))), WET)
    assert later.made == [] and len(later.found) == 6
    pipelines.chain(later, later.source(pairs, content_key(pairs)), replace(WET, blend_alpha=0.5))
    assert later.made == ["blended"]
    pipelines.chain(later, later.source(pairs, content_key(pairs)), replace(WET, gpd_percentile=0.7))
    assert later.made == ["blended", "parameters", "mapped", "filter", "predicted", "blended"]
    less = pairs.limit(pairs.count() - 1)
    assert content_key(less) != content_key(pairs) and content_key(pairs.withColumnRenamed("ref", "rex")) != content_key(pairs)


def test_a_broken_stage_is_made_again(spark, tmp_path):
    stages = Stages(spark, str(tmp_path / "s"))

    def fails(df):
        return df.select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))

    one = stages.source(spark.range(10), "ten")
    with pytest.raises(Exception, match="broken"):
        stages.stage("x", fails, one)
    assert stages.stage("x", lambda df: df, one).df.count() == 10 and stages.made == ["x"]
    assert stages.stage("x", fails, one).df.count() == 10 and stages.found == ["x"]


def test_a_bad_period_leaves_the_others(spark, tmp_path):
    periods = [(m, d) for m in range(1, 7) for d in (1, 2)]

    def bad_mapper(x, *rest):
        from hyetos.operators.correction import map_values

        if (x > 5000).any():
            raise ValueError("a value of more than 5000")
        return map_values(x, *rest)

    def change(m, d, r, t):
        if (m, d) == (2, 1):
            return None, t
        if (m, d) == (3, 2):
            return r, None
        return (r, t * 1e6) if (m, d) == (4, 1) and t > 20 else (r, -1.0) if (m, d) == (5, 1) and t > 20 else (r, t)

    pairs = make(spark, str(tmp_path / "p"), periods, change)
    stages = Stages(spark, str(tmp_path / "s"))
    # Scaling to the reference would take the planted size away: the mapping sees the values as they are.
    values, status = pipelines.run_periods(stages, stages.source(pairs.withColumn("ref", F.when((F.col("month") == 4) & (F.col("dekad") == 1), F.col("ref") * 1e5).otherwise(F.col("ref")))), WET, mapper=bad_mapper)
    got = {(r.month, r.dekad): (r.status, r.message) for r in status.collect()}
    wrong = {(2, 1): "no reference value", (3, 2): "no test value", (4, 1): "ValueError: a value of more than 5000", (5, 1): "negative values"}
    assert got == {p: ("failed", wrong[p]) if p in wrong else ("ok", None) for p in periods}
    assert {(r.month, r.dekad): r.n for r in values.groupBy("month", "dekad").agg(F.countDistinct("method").alias("n")).collect()} == {p: 3 for p in periods if p not in wrong}
    plan = spark.createDataFrame(periods, "month int, dekad int")
    assert {tuple(r) for r in report.pending(plan, status.filter("status = 'ok'"), ["month", "dekad"]).collect()} == set(wrong)
    good = pairs.filter("month = 1")
    same(values.filter("month = 1 and method <> 'lseqmdl'"), pipelines.correct(good, WET).filter("method <> 'lseqmdl'"), [*CELL, "time", "method"])
    with pytest.raises(ValueError, match="only missing values in ref"):
        pipelines.correct(pairs.filter("month = 2 and dekad = 1"), WET)


def test_confidence_is_built_once(spark, tmp_path):
    stages = Stages(spark, str(tmp_path / "s"))
    counts = spark.createDataFrame([(i, j, (i * j) % 3) for i in range(6) for j in range(5)], "lat_i int, lon_i int, count long")
    source = stages.source(counts, content_key(counts))
    first = pipelines.confidence_table(stages, source, 6, 5)
    want = {(r.lat_i, r.lon_i): r.confidence for r in density.confidence(counts, 6, 5).collect()}
    assert {(r.lat_i, r.lon_i): r.confidence for r in first.df.collect()} == pytest.approx(want) and stages.made == ["smooth", "confidence"]
    again = Stages(spark, stages.root)
    assert pipelines.confidence_table(again, again.source(counts, content_key(counts)), 6, 5).fingerprint == first.fingerprint and not again.made
    pipelines.confidence_table(again, source, 6, 5, saturation=3.0)
    assert again.made == ["confidence"]
    pipelines.confidence_table(again, source, 7, 5)
    pipelines.confidence_table(again, source, 6, 5, sigma=2.0)
    more = counts.unionByName(spark.createDataFrame([(5, 4, 1)], counts.schema))
    pipelines.confidence_table(again, again.source(more, content_key(more)), 6, 5)
    assert again.made == ["confidence"] + ["smooth", "confidence"] * 3


def test_sweep_shares_stages_and_equals_single_runs(spark, pairs, tmp_path):
    stages = Stages(spark, str(tmp_path / "s"))
    counts = spark.createDataFrame([(i, j, i + j) for i in range(3) for j in range(3)], "lat_i int, lon_i int, count long")
    plan = report.settings((1.0, 2.0), (0.5, 0.7), (0.7, 0.8), (2.0, 0.7, 0.8))
    source, seen = stages.source(pairs), stages.source(counts)
    got = {tuple(r)[:4]: (r.rmse, r.bias) for r in pipelines.sweep(stages, source, seen, plan, WET, (3, 3)).collect()}
    made = {n: stages.made.count(n) for n in set(stages.made)}
    assert made == {"source": 2, "smooth": 1, "confidence": 2, "scaled": 1, "parameters": 2, "mapped": 2, "filter": 2, "predicted": 2, "blended": 4, "scores": 4}
    for name, saturation, alpha, percentile in plan[1:4]:
        sure = density.confidence(counts, 3, 3, 1.0, saturation)
        alone = pipelines.correct(pairs, replace(WET, blend_alpha=alpha, gpd_percentile=percentile), confidence=sure).filter("method = 'lseqmdl'").join(pairs.select(*CELL, "time", "ref"), [*CELL, "time"])
        cells = alone.groupBy(*CELL).agg(F.sqrt(F.avg((F.col("value") - F.col("ref")) ** 2)).alias("e"), F.avg(F.col("value") - F.col("ref")).alias("b"))
        assert got[(name, saturation, alpha, percentile)] == pytest.approx(tuple(order.medians(cells, [], ["e", "b"]).first()), abs=1e-9)


# The rules of the mapping, value by value.


def one_value(x, s, p, wet, few):
    """What a day becomes: `s` is the cell's own distribution, `p` the reference's parameters (None: none)."""
    if p is None:
        return None
    if x is None:
        return 0.0 if s["max"] == 0 else None
    if s["max"] == 0 or few or x <= wet:
        return 0.0
    own = lambda y: s["dry"] + (1 - s["dry"]) * gamma_cdf(np.array([y]), np.array([s["shape"]]), np.array([s["scale"]]))[0]
    inside = lambda u, floor: min(max((u - floor) / (1 - floor), 1e-10), 1 - 1e-10)
    u = own(x)
    if x > s["limit"] and p["gpd_threshold"] > 0 and 1 - own(s["limit"]) > 1e-10:
        v = inside(u, own(s["limit"]))
        k = p["gpd_shape"]
        y = (p["gpd_scale"] / k * ((1 - v) ** -k - 1) if k else -p["gpd_scale"] * np.log1p(-v)) + p["gpd_threshold"]
    elif u < p["p_dry"]:
        return 0.0
    else:
        y = max(gamma_quantile(np.array([inside(u, p["p_dry"])]), np.array([p["gamma_shape"]]), np.array([p["gamma_scale"]]))[0], wet)
    return max(min(y, p["upper_cap"]), 0.0)


def test_rules_of_the_mapping(spark):
    rng = np.random.default_rng(4)
    series = {
        0: [0.0] * 30 + [None],  # all zeros
        1: [0.0] * 25 + [0.5, 1.0, 3.0, 4.0, 8.0],  # three wet days
        2: [float(x) for x in rng.gamma(0.6, 8, 60)] + [None, 0.0, 0.9, 1.0],  # drizzle, a missing day
        3: [float(x) for x in rng.gamma(0.6, 8, 60)],  # no parameters
        4: [float(x) for x in rng.gamma(0.5, 30, 60)],  # far beyond the cap
        5: [float(x) for x in rng.gamma(0.9, 5, 60)],  # no tail in the reference
    }
    base = {"gamma_shape": 0.8, "gamma_scale": 9.0, "gpd_threshold": 14.0, "gpd_shape": 0.1, "gpd_loc": 0.0, "gpd_scale": 8.0, "upper_cap": 60.0, "p_threshold": 0.7, "p_dry": 0.45}
    parameters = {c: dict(base) for c in series if c != 3}
    parameters[4]["upper_cap"], parameters[5]["gpd_threshold"] = 25.0, 0.0
    parameters[2]["gpd_shape"] = 0.0
    rows = [(1, 1, 0, c, datetime.date(2001, 1, 1) + datetime.timedelta(days=k), x) for c, xs in series.items() for k, x in enumerate(xs)]
    table = spark.createDataFrame(rows, "month int, dekad int, lat_i int, lon_i int, time date, value double")
    fitted = spark.createDataFrame([(1, 1, 0, c, *[p[n] for n in correction.PARAMETERS]) for c, p in parameters.items()], "month int, dekad int, lat_i int, lon_i int, " + ", ".join(f"{n} double" for n in correction.PARAMETERS))
    got = {(r.lon_i, r.time): r.mapped for r in correction.quantile_map(table, fitted).collect()}
    kinds = set()
    for c, xs in series.items():
        there = np.array([x for x in xs if x is not None])
        wet = there[there > 1.0]
        shape, scale = correction.solve_gamma(*(np.array([v]) for v in (wet.mean() if len(wet) else 0.0, np.log(wet).mean() if len(wet) else 0.0, len(wet))))
        s = {"max": np.abs(there).max(), "dry": 1 - len(wet) / len(there), "shape": shape[0], "scale": scale[0], "limit": np.quantile(wet, 0.8) if len(wet) else 0.0}
        for k, x in enumerate(xs):
            want = one_value(x, s, parameters.get(c), 1.0, len(wet) < 5)
            assert got[(c, datetime.date(2001, 1, 1) + datetime.timedelta(days=k))] == (pytest.approx(want, rel=1e-9) if want is not None else None), (c, x)
            kinds.add((c, want is None, want == 0.0, want == parameters.get(c, {}).get("upper_cap")))
    assert (4, False, False, True) in kinds and (2, False, True, False) in kinds and (2, True, False, False) in kinds and len(kinds) >= 10


def test_folds_follow_the_series(spark):
    """The seeded shuffle deals excesses in the order of days, not of size."""
    rng = np.random.default_rng(6)
    days = [datetime.date(2001, 1, 1) + datetime.timedelta(days=7 * k) for k in range(23)]
    x = [float(v) for v in 10 + rng.gamma(0.9, 8, 23)]
    rows = list(zip([1] * 23, days, x, strict=True))
    rng.shuffle(rows)
    table = spark.createDataFrame([(int(k), t, float(v)) for k, t, v in rows], "k int, time date, value double").repartition(4)
    got = correction.fit_tails(table, spark.createDataFrame([(1, 10.0)], "k int, gpd_threshold double"), ["k"]).first()
    order_of = np.arange(23)
    np.random.RandomState(42).shuffle(order_of)
    sizes, at, fits = [5, 5, 5, 4, 4], 0, []
    for n in sizes:
        left_out = set(order_of[at : at + n].tolist())
        at += n
        fits.append(correction.fit_gpd(np.array([v - 10 for k, v in enumerate(x) if k not in left_out])))
    assert (got.gpd_shape, got.gpd_scale) == pytest.approx(tuple(np.mean(fits, axis=0)))
    assert correction.fit_gpd_folds(np.sort(np.array(x) - 10)) != pytest.approx((got.gpd_shape, got.gpd_scale))
