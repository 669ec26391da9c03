"""The trained predictor: gradients, seeds, early stop, and a nonlinear field that no linear filter can follow."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyetos.operators import correction, network

NET = network.Network((6,), (0.0,))


def test_gradient_is_that_of_the_error():
    rng = np.random.default_rng(1)
    net = network.Network((3, 2), (0.0, 0.0))
    flat, x, y = net.start(rng), rng.random((4, 5)), rng.random((4, 5))
    error, gradient = net.gradient(flat, x, y)
    assert error == pytest.approx(net.loss(flat, x, y)) and len(gradient) == net.size()
    for k in rng.choice(net.size(), 30, replace=False):
        step = np.zeros(net.size())
        step[k] = 1e-6
        assert gradient[k] == pytest.approx((net.loss(flat + step, x, y) - net.loss(flat - step, x, y)) / 2e-6, abs=1e-6)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Cells become the excess over their left neighbour, if any: piecewise linear, for two dekads in opposite directions."""
    rng, rows = np.random.default_rng(7), []
    for year in range(2001, 2009):
        for dekad in (1, 2):
            for k in range(6):
                x = rng.random((6, 6))
                x[0, 0], x[5, 5] = 1.0, 1.0
                near = np.pad(x, ((0, 0), (1, 1)))[:, :6] if dekad == 1 else np.pad(x, ((0, 0), (1, 1)))[:, 2:]
                y = np.maximum(x - near, 0)
                y[0, 0] = 1.0
                day = datetime.date(year, 1, (dekad - 1) * 10 + k + 1)
                rows += [(1, dekad, day, i, j, float(10 * x[i, j]), float(10 * y[i, j])) for i in range(6) for j in range(6)]
    path = str(tmp_path_factory.mktemp("planted") / "rows")
    spark.createDataFrame(rows, "month int, dekad int, time date, lat_i int, lon_i int, value double, ref double").coalesce(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def fields(planted, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fields") / "fields")
    network.day_fields(planted, 6, 6).write.parquet(path)
    return spark.read.parquet(path)


def test_beats_the_linear_filter_on_held_out_days(planted, fields):
    models = network.train(fields, 6, 6, NET, epochs=30, batch_years=2, rate=0.03, held=0.25, patience=30, seed=3)
    assert models.count() == 2 and models.filter("weights is null").count() == 0
    later = planted.filter("year(time) >= 2007")
    made = network.apply(later, models, 6, 6, NET)
    linear = correction.apply_filter(later, correction.train_filter(planted.filter("year(time) < 2007")))
    error = lambda df: {r.dekad: r.e for r in df.filter("lat_i + lon_i > 0").groupBy("dekad").agg(F.avg((F.col("predicted") - F.col("ref")) ** 2).alias("e")).collect()}
    ours, theirs = error(made), error(linear)
    assert all(ours[d] < 0.7 * theirs[d] for d in (1, 2)), (ours, theirs)


def test_a_seed_gives_the_same_weights(fields):
    net = network.Network((4, 3), (0.3, 0.0))
    run = lambda seed, table: {r.dekad: (r.epochs, r.error, r.weights) for r in network.train(table, 6, 6, net, epochs=2, batch_years=3, seed=seed).collect()}
    first = run(42, fields)
    assert run(42, fields.repartition(5)) == first and run(43, fields)[1][2] != first[1][2]


def test_stops_early_and_survives_odd_periods(spark, fields):
    """Weights that jump about don't get better; a dekad without held-out years trains on; one that isn't trained predicts nothing."""
    few = fields.filter("dekad = 1 or year < 2004")
    models = {r.dekad: r for r in network.train(few, 6, 6, NET, epochs=6, batch_years=8, rate=50.0, held=0.25, patience=1).collect()}
    assert models[1].epochs < 6 and models[2].epochs == 6 and models[2].error is None
    rows = spark.createDataFrame([(3, 3, datetime.date(2001, 3, 25), 0, 0, 5.0), (3, 3, datetime.date(2001, 3, 25), 0, 1, None)], "month int, dekad int, time date, lat_i int, lon_i int, value double")
    got = network.apply(rows, network.train(fields.limit(0), 6, 6, NET), 6, 6, NET)
    assert [r.predicted for r in got.collect()] == [None, None]
