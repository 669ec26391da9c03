"""Guards, tail fits of many samples, and wide files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyetos.operators import correction, report, stations


def test_guards(spark):
    rows = spark.createDataFrame([(1, None, 2.0), (2, None, 3.0)], "k int, a double, b double")
    assert stations.checked(rows, ["b"]).count() == 2
    with pytest.raises(ValueError, match="missing values in a"):
        stations.checked(rows, ["a", "b"])
    with pytest.raises(ValueError, match="is empty"):
        stations.checked(rows.limit(0), ["b"])
    with pytest.raises(ValueError, match="share no k"):
        stations.paired_or_error(rows, rows.withColumn("k", F.col("k") + 10).select("k"), ["k"])


def test_tails_together_are_tails_alone():
    rng = np.random.default_rng(3)
    samples = [np.sort(rng.gamma(0.8, 9.0, n)) for n in (0, 3, 5, 9, 10, 10, 40)]
    shape, scale = correction.fit_tails_of(samples, True)
    for k, x in enumerate(samples):
        parts = [np.delete(x, part) for part in correction.folds_of(len(x))] if len(x) >= 5 else []
        want = np.mean([correction.fit_gpd(y) for y in parts], axis=0) if parts else (0.0, 1.0)
        assert (shape[k], scale[k]) == pytest.approx(tuple(want))

    def likelihood(x, shape, scale):
        y = 1 + shape * x / scale
        return -len(x) * np.log(scale) - (1 / shape + 1) * np.log(y).sum() if (y > 0).all() else -np.inf

    s, c = correction.fit_gpd(samples[-1])
    best = likelihood(samples[-1], s, c)
    assert all(likelihood(samples[-1], s + a, c * b) <= best + 1e-6 for a in (-0.05, 0.01, 0.05) for b in (0.9, 1.01, 1.1))


def test_wide_files(spark, tmp_path):
    long = spark.createDataFrame([(1, "x", 0.5, 2.0), (1, "y", 0.25, 3.0), (2, "x", 0.75, 4.0)], "station_id int, product string, r double, sdr double")
    stations.write_wide(long, str(tmp_path / "w"), "station_id", "product", ["r", "sdr"], ["x", "y"])
    got = {r.station_id: r for r in spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "w")).collect()}
    assert (got[1].x_r, got[1].y_sdr, got[2].x_sdr, got[2].y_r) == (0.5, 3.0, 4.0, None)


def test_preferred_and_placed(spark):
    rows = spark.createDataFrame([(1, "ls", 1.0), (1, "dl", 2.0), (2, "ls", 3.0), (2, "eqm", 4.0)], "k int, method string, v double")
    got = {r.k: r.method for r in report.preferred(rows, ["k"], "method", ("ls", "eqm"), "dl").collect()}
    assert got == {1: "dl", 2: "eqm"}
    assert {r.method: r.place for r in report.placed(rows, "method", ("dl", "ls")).collect()} == {"dl": 1, "ls": 2, "eqm": 3}


def test_ranks_are_those_of_one_sort(spark):
    rng = np.random.default_rng(4)
    values = [round(float(x), 1) for x in rng.normal(0, 5, 300)]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    want = {k: n + 1 for n, (v, k) in enumerate(sorted((v, k) for k, v in enumerate(values)))}
    assert {r.k: r["rank"] for r in report.ranked(rows, "v", ["k"], partitions=7).collect()} == want
    assert report.ranked(rows.filter("k = 3"), "v", ["k"]).first()["rank"] == 1
