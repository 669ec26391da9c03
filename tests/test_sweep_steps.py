"""Steps of the sweep through the chain: rows are shuffled once a step, and what settings share is worked out once."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyetos.functions.special import gamma_cdf, gamma_quantile
from hyetos.operators import correction
from hyetos.params import Params
from hyetos.plans import pipelines
from hyetos.plans.stages import Stages

CELL = list(correction.CELL)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pairs(spark, tmp_path_factory):
    rng, path = np.random.default_rng(3), str(tmp_path_factory.mktemp("pairs") / "p")
    days = [datetime.date(2001 + y, m, d) for y in range(4) for m in (1, 2) for d in range(1, 11)]
    rows = [(t.month, 1, i, j, t, float(rng.gamma(0.8, 9)), float(rng.gamma(0.6, 7))) for i in range(-2, 4) for j in range(5) for t in days if rng.random() < 0.8]
    spark.createDataFrame(rows, "month int, dekad int, lat_i int, lon_i int, time date, ref double, test double").write.parquet(path)
    return spark.read.parquet(path)


def test_settings_of_the_blending_shuffle_nothing(spark, pairs, tmp_path):
    stages = Stages(spark, str(tmp_path / "s"))
    counts = stages.source(pairs.select("lat_i", "lon_i").distinct().withColumn("confidence", F.lit(0.5)))
    made = pipelines.chain(stages, stages.source(pairs), Params(), confidence=counts)
    rows = made["predicted"].df
    both = correction.blend(rows.join(F.broadcast(counts.df), ["lat_i", "lon_i"]), confidence="confidence", limited=True)
    assert "Exchange hashpartitioning" not in plan_of(both) and "Window" not in plan_of(both)
    want = correction.blend(rows.drop("limit").join(counts.df, ["lat_i", "lon_i"]), confidence="confidence").select(*CELL, "time", "blended")
    got = made["blended"].df.select(*CELL, "time", "blended")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == pairs.count()
    refs = made["blended"].df.select(*CELL, "time", "ref")  # scores need no join
    assert refs.exceptAll(pairs.select(*CELL, "time", "ref")).isEmpty()


def test_mapping_joins_groups_and_not_rows(spark, pairs):
    found = correction.pair_parameters(pairs)
    fitted = spark.createDataFrame(found.collect(), found.schema)
    made = correction.quantile_map_pairs(pairs, fitted=fitted)
    plan = plan_of(made)
    assert plan.count("FileScan") == 1 and made.columns == [*pairs.columns, "mapped"] and made.schema["time"].dataType.simpleString() == "date"
    assert made.count() == pairs.count() and made.select(*CELL, "time").exceptAll(pairs.select(*CELL, "time")).isEmpty()


def test_filter_from_sums_of_blocks(spark, pairs):
    """Blocks of several days and dekads, cut anywhere: the same weights and predictions as from neighbourhoods, row by row."""
    rows = pairs.select(*CELL, "time", F.when(F.col("test") > 1, F.col("test")).alias("value"), "ref")
    near = [r for r in correction.neighbourhoods(rows).collect()]
    want = {}
    for m in (1, 2):
        good = [r for r in near if r.month == m and r.value is not None]
        x, y = np.array([[*(r[f"_x{k}"] for k in range(9)), 1.0] for r in good]), np.array([r.ref for r in good])
        want[m, 1] = np.linalg.solve(x.T @ x + 1e-3 * np.eye(10), x.T @ y)
    for side in (2, 7, 180):
        models = correction.train_filter(rows, side=side)
        assert {(r.month, r.dekad): r.weights for r in models.collect()} == {k: pytest.approx(w.tolist(), rel=1e-7) for k, w in want.items()}
        some = models.filter("month = 1").unionByName(models.filter("month = 2").withColumn("weights", F.lit(None).cast("array<double>")))
        got = {(r.lat_i, r.lon_i, r.time): r.predicted for r in correction.apply_filter(rows.drop("ref"), some, side=side).collect()}
        x = {(r.lat_i, r.lon_i, r.time): max(0.0, float(np.dot([*(r[f"_x{k}"] for k in range(9)), 1.0], want[1, 1]))) if r.month == 1 and r["_x0"] is not None else 0.0 for r in near}
        assert got == {k: pytest.approx(v, rel=1e-6, abs=1e-9) for k, v in x.items()}
        assert correction.apply_filter(rows, models.filter("month = 1"), side=side).filter("month = 2").isEmpty()


def test_quantiles_are_inverses():
    rng = np.random.default_rng(2)
    for low, high in ((0.05, 2), (2, 60), (60, 2000)):
        a, p = rng.uniform(low, high, 4000), np.concatenate([rng.random(3996), [1e-10, 1e-3, 1 - 1e-6, 1 - 1e-10]])
        assert np.abs(gamma_cdf(gamma_quantile(p, a), a) - p).max() < 3e-12
        x = rng.gamma(a)
        assert np.abs(np.array([gamma_cdf(x[k : k + 1], a[k : k + 1])[0] for k in range(200)]) - gamma_cdf(x, a)[:200]).max() == 0  # whatever stands beside it


def plain_tail(x):
    """The profile likelihood with a logarithm for each value."""
    low, mean = -(1 - 1e-9) / x.max(), x.mean()
    grid = np.concatenate([low * np.linspace(1, 1e-4, 80), np.geomspace(1e-6, 50, 160) / mean])

    def profile(theta):
        shape = np.array([sum(np.log1p(t * v) for v in x) / len(x) for t in theta])
        return np.where((shape > -1) & (shape / theta > 0), -np.log(np.maximum(shape / theta, 1e-300)) - shape - 1, -np.inf), shape

    for _ in range(6):
        k = profile(grid)[0].argmax()
        grid = np.linspace(grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)], 25)
    best, shape = profile(grid)
    k = best.argmax()
    return (0.0, mean) if best[k] < -np.log(mean) - 1 or not np.isfinite(best[k]) else (shape[k], shape[k] / grid[k])


@pytest.mark.parametrize("n", [2, 3, 9, 20])
def test_tails_equal_sums_of_logarithms(n):
    x = np.random.default_rng(n).gamma(0.9, 8, (12, n))
    x[:3] = x[:3, :1]  # equal excesses: theta goes to its lower end
    shape, scale = correction.fit_gpd_many(x)
    assert np.isfinite(shape).all() and np.isfinite(scale).all()
    for k, row in enumerate(x):
        assert (shape[k], scale[k]) == pytest.approx(plain_tail(row), rel=1e-5, abs=1e-5)
