"""Steps that read their rows once: metrics, sides in columns, summaries, empirical distributions, fits."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from hyetos.operators import correction, metrics, report
from hyetos.params import Params
from hyetos.plans import pipelines
from hyetos.sources import tables

CELL = list(correction.CELL)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pairs(spark):
    rng, first = random.Random(7), datetime.date(2001, 1, 1)
    rows = [(1, 1, c, 0, first + datetime.timedelta(days=d), rng.choice([None, 0.0, 0.5, 2.0, 9.0]), rng.choice([0.0, 0.5, 2.0, 7.0])) for c in range(12) for d in rng.sample(range(80), 3 * c + 1)]
    return spark.createDataFrame(rows, "month int, dekad int, lat_i int, lon_i int, time date, ref double, test double").cache()


def test_metrics_group_once_and_equal_their_parts(spark, pairs):
    made = metrics.metrics31(pairs, CELL, 1.0, pvalue=False)
    plan = plan_of(made)
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
    quantiles = [F.when(F.count("*") >= 2, F.percentile(side, F.lit(p))).alias(f"p{round(100 * p)}_{side}") for p in metrics.PERCENTILES for side in ("ref", "test")]
    parts = metrics.dry_spells(pairs, CELL, 1.0).join(metrics.ks_statistic(pairs, CELL), CELL).join(metrics.valid(pairs).groupBy(*CELL).agg(*quantiles), CELL)
    got = {r.lat_i: r for r in made.select(*parts.columns).collect()}
    want = {r.lat_i: r for r in parts.collect()}
    assert got == want and len(got) > 8


def test_metrics_of_the_grid_shuffle_once(spark):
    made = metrics.metrics31(tables.grid_day(spark, "/root/testdata/sf0.001"), CELL, 25.0, pvalue=False)
    assert plan_of(made).count("Exchange") == 1


def test_sides_in_columns_equal_joined_frames(spark, pairs):
    ref, one = F.col("ref"), lambda x: pairs.select(*CELL, "time", x.alias("value"))
    params = Params(wet_day=1.0)
    made = pipelines.verify_columns(pairs, {"a": ref, "b": ref + 1}, {"raw": F.col("test"), "ls": F.col("test") * 2}, params, pvalue=False)
    assert "Join" not in plan_of(made)
    want = pipelines.verify({"a": one(ref), "b": one(ref + 1)}, {"raw": one(F.col("test")), "ls": one(F.col("test") * 2)}, params, pvalue=False)
    rows = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select(sorted(df.columns)).collect())
    assert rows(made) == rows(want) and made.count() == 4 * metrics.valid(pairs).select(*CELL).distinct().count()


def test_scaled_in_one_run(spark, pairs):
    made = correction.scale(pairs)
    assert "Join" not in plan_of(made) and plan_of(made).count("Exchange") == 1
    want = pairs.join(correction.scaling_factor(pairs), CELL).withColumn("scaled", F.col("test") * F.col("factor")).drop("factor")
    rows = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select(sorted(df.columns)).collect())
    assert rows(made) == rows(want)


def test_summary_reads_rows_once(spark):
    rows = spark.createDataFrame([(1, 0.1, 0.3, 4), (1, 0.5, 0.4, 2), (1, 0.5, 0.5, 2), (2, 0.2, 0.1, 1), (2, None, 0.3, -9999)], "p int, a double, b double, k int")
    made = report.batch_summary(rows, "p", "a", "b", "k")
    assert "Join" not in plan_of(made)
    got = made.first()
    assert got.n_periods == 2 and got.best_period == 1 and got.worst_period == 2
    assert got.percent_improved == pytest.approx(100 / 6) and got.percent_degraded == pytest.approx((100 / 3 + 100) / 2) and got.p2 == pytest.approx(100 / 3) and got.p1 == pytest.approx(50)


def test_ecdf_computes_values_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(x):
        calls.add(1)
        return float(x % 7) if x % 5 else None

    made = report.ecdf(spark.range(100).select("id", (F.col("id") % 2).alias("k")).withColumn("value", value("id")), ["k"], "value", ["id"])
    assert {(r.id, r.ecdf) for r in made.collect() if r.k == 1 and r.value == 0} == {(i, (n + 1) / 40) for n, i in enumerate((7, 21, 49, 63, 77, 91))}
    assert calls.value == 100


def test_parameters_without_a_join(spark, pairs):
    made = correction.reference_parameters(pairs, value="ref", wet=0.1, min_wet=5)
    assert "Join" not in plan_of(made)
    x = F.when(F.col("ref") > 0.1, F.col("ref"))
    limits = pairs.groupBy(*CELL).agg(F.percentile(x, F.lit(0.8)).alias("gpd_threshold"), F.percentile(x, F.lit(0.999)).alias("upper_cap"), F.count(x).alias("n")).filter("n >= 5")
    tails = correction.fit_tails(pairs.filter("ref > 0.1"), limits, CELL, "ref")
    want = limits.join(tails, CELL, "left").selectExpr("lat_i", "gpd_threshold", "upper_cap", "coalesce(gpd_shape, 0D) shape", "coalesce(gpd_scale, 1D) scale")
    got = {r.lat_i: tuple(r)[1:] for r in made.select("lat_i", "gpd_threshold", "upper_cap", "gpd_shape", "gpd_scale").collect()}
    assert got == {r.lat_i: tuple(r)[1:] for r in want.collect()} and len(got) > 5


def test_taylor_pass_pairs_by_day(spark):
    axis = spark.createDataFrame([(0, 0.0), (1, 1.0)], "i int, x double")
    places = spark.createDataFrame([(k, 0.1 + k % 2, 0.2) for k in range(6)], "station_id int, lat double, lon double")
    day = lambda n: datetime.date(2001, 1, n)
    obs = spark.createDataFrame([(k, day(n), float(k + n * n)) for k in range(6) for n in range(1, 9)], "station_id int, time date, value double")
    cells = spark.createDataFrame([(float(a), float(b), day(n), "p", float(n + a)) for a in range(2) for b in range(2) for n in range(2, 9)], "lat double, lon double, time date, product string, value double")
    made = pipelines.taylor_pass(obs, cells, places, axis, axis)
    joins = [line.split("Join", 1)[1] for line in plan_of(made).splitlines() if "Join [" in line]
    assert any("lat" in on and "lon" in on and "time" in on for on in joins)
    assert sorted((r.station_id, r.n, round(r.bias, 6)) for r in made.collect()) == [(k, 7, round(sum(n + k % 2 - k - n * n for n in range(2, 9)) / 7, 6)) for k in range(6)]
