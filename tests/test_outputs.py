"""Validation end to end, parameters on a finer grid, and sinks."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyetos.operators import correction, metrics, stations
from hyetos.params import Params
from hyetos.plans import pipelines
from hyetos.sources import files


def day(k):
    return datetime.date(2001, 1, 1) + datetime.timedelta(days=k)


def test_validation_end_to_end(spark):
    rng = np.random.default_rng(5)
    field = {(i, j): rng.gamma(0.7, 10, 60) for i in range(3) for j in range(3)}
    cells = spark.createDataFrame([(float(i), 100.0 + j, day(k), float(v)) for (i, j), x in field.items() for k, v in enumerate(x)], "lat double, lon double, time date, value double")
    spots = {"a": (0.2, 100.4, (0, 0)), "b": (1.9, 101.8, (2, 2)), "few": (1.0, 101.0, (1, 1))}
    obs = {s: field[at][: 10 if s == "few" else 60] * (1.5 if s == "a" else 1.0) for s, (_, _, at) in spots.items()}
    rows = spark.createDataFrame([(s, day(k), float(v)) for s, x in obs.items() for k, v in enumerate(x)], "station_id string, time date, value double")
    places = spark.createDataFrame([(s, lat, lon, f"P{s}") for s, (lat, lon, _) in spots.items()], "station_id string, lat double, lon double, Province string")
    axes = [spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "i int, x double") for xs in ([0.0, 1.0, 2.0], [100.0, 101.0, 102.0])]
    each, scores, summary = pipelines.validate(rows, cells, places, *axes, Params(min_events=3))
    got = {r.station_id: r for r in each.collect()}
    assert set(got) == {"a", "b"} and got["a"].Province == "Pa" and got["a"].n_valid_days == 60
    assert got["b"].rmse == 0 and got["b"].pearson_correlation == pytest.approx(1) and got["b"].ks_pvalue == pytest.approx(1)
    x, y = obs["a"], field[(0, 0)]
    assert got["a"].relative_bias == pytest.approx(y.sum() / x.sum() - 1) and got["a"].rmse == pytest.approx(np.sqrt(np.mean((y - x) ** 2)))
    at = {(r.station_id, r.threshold): r for r in scores.collect()}
    hits, events = ((x >= 10) & (y >= 10)).sum(), (x >= 10).sum()
    assert len(at) == 14 and at[("a", 10.0)].n_events == events and at[("a", 10.0)].pod == pytest.approx(hits / events) and at[("a", 150.0)].pod is None
    described = {r.metric: r for r in summary.collect()}
    assert set(described) == set(metrics.NAMES) and described["rmse"]["count"] == 2 and described["rmse"].max == pytest.approx(got["a"].rmse)
    with pytest.raises(ValueError, match="share no day"):
        pipelines.validate(rows.withColumn("time", F.date_add("time", 400)), cells, places, *axes, Params())
    with pytest.raises(ValueError, match="only missing values in value"):
        pipelines.validate(rows.withColumn("value", F.lit(None).cast("double")), cells, places, *axes, Params())


def test_parameters_on_a_finer_grid(spark):
    """Between four coarse cells bilinear, beyond them the nearest; shapes stay positive and shares within 0 and 1."""
    shape = {(0.0, 0.0): 1.0, (0.0, 1.0): 2.0, (1.0, 0.0): 3.0, (1.0, 1.0): None, (2.0, 0.0): -5.0, (2.0, 1.0): 4.0}
    names = list(correction.PARAMETERS)
    rows = [(1, 2, a, b, *[v if n == "gamma_shape" else (None if v is None else v / 3) for n in names]) for (a, b), v in shape.items()]
    coarse = spark.createDataFrame(rows, "month int, dekad int, lat double, lon double, " + ", ".join(f"{n} double" for n in names))
    ax = lambda xs: spark.createDataFrame([(k, float(x)) for k, x in enumerate(xs)], "i int, x double")
    got = {(r.lat, r.lon): r for r in pipelines.fine_parameters(coarse, (ax([0, 1, 2]), ax([0, 0.25, 0.8, 2, 2.5])), (ax([0, 1]), ax([0, 0.5, 1]))).collect()}
    assert len(got) == 15 and all((r.month, r.dekad) == (1, 2) for r in got.values())
    assert got[(0.0, 0.5)].gamma_shape == 1.5 and got[(0.25, 0.0)].gamma_shape == pytest.approx(1.5) and got[(0.0, 0.5)].p_dry == 0.5
    assert got[(0.25, 0.5)].gamma_shape in (1.0, 2.0)  # a corner is missing: the nearest cell
    assert got[(2.0, 0.0)].gamma_shape == 1e-6 and got[(2.0, 0.0)].p_dry == 0.0 and got[(2.0, 1.0)].p_dry == 1.0 and got[(2.5, 1.0)].gamma_shape == 4.0
    assert got[(2.0, 0.0)].gpd_shape == pytest.approx(-5 / 3)  # only what has a range is held to it


def test_metric_sink(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.createDataFrame([(1, 1, 0, 0.1), (1, 2, 0, 0.2), (2, 1, 0, None)], "month int, dekad int, lat_i int, rmse double")
    files.write_metrics(rows, path, ["month", "dekad"], {"rmse": "mm"})
    files.write_metrics(rows.filter("month = 1 and dekad = 1").withColumn("rmse", F.lit(0.5)), path, ["month", "dekad"])
    got = {(r.month, r.dekad): r.rmse for r in spark.read.parquet(path).collect()}
    assert got == {(1, 1): 0.5, (1, 2): pytest.approx(0.2, abs=1e-7), (2, 1): None} and dict(spark.read.parquet(path).dtypes)["rmse"] == "float"
    files.write_metrics(rows, str(tmp_path / "n"), ["month"], {"rmse": "mm"})
    assert spark.read.parquet(str(tmp_path / "n")).schema["rmse"].metadata["comment"] == "mm"


def test_wide_file_by_station_and_dekad(spark, tmp_path):
    long = spark.createDataFrame([(1, 3, "x", 0.5, 2.0), (1, 3, "y", 0.25, 3.0), (1, 4, "x", 0.75, 4.0), (2, 3, "z", 9.0, 9.0)], "station_id int, dekad int, product string, r double, sdr double")
    stations.write_wide(long, str(tmp_path / "w"), ["station_id", "dekad"], "product", ["r", "sdr"], ["x", "y"])
    got = {(r.station_id, r.dekad): r for r in spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "w")).collect()}
    assert set(got) == {(1, 3), (1, 4), (2, 3)} and (got[(1, 3)].x_r, got[(1, 3)].y_sdr, got[(1, 4)].y_r, got[(2, 3)].x_r) == (0.5, 3.0, None, None)


def test_provenance_has_what_the_caller_says(spark, tmp_path):
    cells = spark.createDataFrame([("ls", 1, 1, 0, 0, day(0), 1.0)], "method string, month int, dekad int, lat_i int, lon_i int, time date, value double")
    files.write_corrected(cells, str(tmp_path / "c"), **files.described(Params(), "gauges", "satellite"))
    got = {r.name: r.value for r in spark.read.parquet(str(tmp_path / "c") + "/provenance").collect()}
    assert got["reference"] == "gauges" and got["test"] == "satellite" and got["blend_alpha"] == "0.7" and got["spark_version"] == spark.version and "written_at" in got and got["package_version"]
