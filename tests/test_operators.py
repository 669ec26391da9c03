"""Operators on small tables: closed forms, invariants and missing values."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyetos.functions import scalar as S
from hyetos.operators import align, correction, density, metrics, polygons, quality, stations, taylor
from hyetos.params import Params
from hyetos.sources import files


def day(k):
    return datetime.date(2001, 1, 1) + datetime.timedelta(k)


@pytest.fixture
def pairs(spark):
    values = [(0.0, 0.0), (5.0, 4.0), (None, 3.0), (0.0, 2.0), (9.0, 9.0), (1.0, 0.0), (2.0, None), (30.0, 20.0)]
    rows = [("a", day(k), r, t) for k, (r, t) in enumerate(values)] + [("same", day(k), float(k), float(k)) for k in range(10)] + [("flat", day(k), 2.0, 2.0) for k in range(5)] + [("one", day(0), 1.0, 1.0), ("none", day(0), None, 1.0)]
    return spark.createDataFrame(rows, "station_id string, time date, ref double, test double")


def test_metrics(pairs):
    got = {r.station_id: r for r in metrics.metrics31(pairs, ["station_id"]).collect()}
    assert set(got) == {"a", "same", "flat", "one"}
    a = got["a"]
    assert a.n == 6 and a.relative_bias == pytest.approx((35 - 45) / 45) and a.pod == pytest.approx(3 / 4) and a.far == pytest.approx(1 / 4)
    assert (a.dsl_ref, a.dsl_test) == (1.0, 1.0)
    s = got["same"]
    assert (s.pod, s.csi, s.far, s.ks_stat) == (1, 1, 0, 0) and s.pearson_correlation == pytest.approx(1) and s.nse == pytest.approx(1) and s.ks_pvalue == 1
    assert got["flat"].pearson_correlation is None and got["flat"].nse is None and got["flat"].stdev_ratio is None
    assert got["one"].rmse is None and got["one"].n == 1


def test_empty(pairs):
    assert metrics.metrics31(pairs.limit(0), ["station_id"]).count() == 0
    assert taylor.stats(taylor.sums(pairs.limit(0), ["station_id"])).count() == 0


def test_gates_and_scores(pairs):
    assert stations.station_metrics(pairs, min_days=6, pvalue=False).count() == 2
    scored = {(r.station_id, r.threshold): r for r in stations.multi_threshold(pairs, thresholds=(1, 50), min_days=1, min_events=2).collect()}
    assert scored["a", 1.0].pod == pytest.approx(3 / 4) and scored["a", 50.0].pod is None and scored["a", 50.0].freq_obs == 0
    row = stations.dry_and_wet_rates(pairs, ["station_id"]).filter("station_id = 'a'").first()
    assert row.correct_dry == pytest.approx(1 / 2) and row.wet_ratio == pytest.approx(1.0)


def test_taylor_identities_and_merge(pairs):
    whole = taylor.stats(taylor.sums(pairs, ["station_id"]))
    parts = taylor.sums(pairs.withColumn("k", F.dayofmonth("time") % 3), ["station_id", "k"])
    merged = {r.station_id: r for r in taylor.stats(taylor.merge(parts, ["station_id"])).collect()}
    for r in whole.filter("r is not null").collect():
        assert r.crmse**2 == pytest.approx(r.sigma_o**2 + r.sigma_p**2 - 2 * r.sigma_o * r.sigma_p * r.r)
        assert r.rmse**2 == pytest.approx(r.crmse**2 + r.bias**2) and merged[r.station_id].r == pytest.approx(r.r)


def test_quality_of_a_perfect_cell(pairs):
    r = quality.assess(metrics.metrics31(pairs, ["station_id"])).filter("station_id = 'same'").first()
    assert r.categorical_quality == 4 and r.continuous_quality == pytest.approx(1.0, abs=1e-6) and r.confidence_level == pytest.approx(1.0, abs=1e-6)
    assert quality.assess(metrics.metrics31(pairs, ["station_id"])).filter("station_id = 'one'").first().categorical_quality == -9999


def test_alignment(spark):
    source = spark.createDataFrame([(0.0,), (1.0,), (3.0,)], "x double")
    target = spark.createDataFrame([(-1.0,), (0.5,), (2.0,), (2.9,), (9.0,)], "x double")
    assert {r.target: r.source for r in align.nearest(source, target).collect()} == {-1.0: 0.0, 0.5: 1.0, 2.0: 3.0, 2.9: 3.0, 9.0: 3.0}
    assert {r.target: r.source for r in align.nearest(source, target, ties="smaller").collect()}[0.5] == 0.0
    assert {r.target: r.source for r in align.nearest(source, target, bounded=True).collect()}[9.0] is None
    cells = spark.createDataFrame([(float(a), float(b), 2.0 * a - 3.0 * b + 1) for a in (0, 1, 3) for b in (0, 1, 3)], "lat double, lon double, value double")
    m = align.brackets(source, target)
    for r in align.regrid_bilinear(cells, m, m, ["value"]).collect():
        assert r.value == pytest.approx(2 * r.lat - 3 * r.lon + 1)
    holes = cells.withColumn("value", F.when((F.col("lat") == 1) & (F.col("lon") == 1), None).otherwise(F.col("value")))
    assert {(r.lat, r.lon): r.value for r in align.regrid_bilinear(holes, m, m, ["value"]).collect()}[0.5, 0.5] is None


def test_scaling_makes_means_equal(spark):
    rows = [(1, 1, 0, 0, float(r), float(t)) for r, t in ((1, 2), (5, 3), (0, 9))] + [(1, 1, 0, 1, 4.0, 0.0)]
    table = spark.createDataFrame(rows, "month int, dekad int, lat_i int, lon_i int, ref double, test double")
    got = {r.lon_i: r for r in correction.scale(table).groupBy("lon_i").agg(F.avg("ref").alias("a"), F.avg("scaled").alias("b")).collect()}
    assert got[0].a == pytest.approx(got[0].b) and got[1].b == 0.0


def test_l_moments_of_few_values(spark):
    table = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3)] + [("b", float(x)) for x in (1, 2, 3, 10)] + [("c", 2.0)] * 5, "k string, value double")
    got = {r.k: r for r in correction.l_moments(table, ["k"]).collect()}
    assert got["a"].l1 is None and got["b"].l1 == 4.0 and got["c"].t3 is None


def test_confidence_around_one_station(spark):
    """One station: its cell and its neighbours get the products of the kernel's weights along both axes, the border gives back what would leave."""
    rows, columns, sigma = 9, 11, 0.8
    counts = spark.createDataFrame([(i, j, 5 if (i, j) == (0, 6) else 0) for i in range(rows) for j in range(columns)], "lat_i int, lon_i int, count long")
    w = dict(density.kernel(sigma))
    along = lambda at, to, n: sum(v for k, v in w.items() if (m := (to + k) % (2 * n)) == at or 2 * n - 1 - m == at)
    got = {(r.lat_i, r.lon_i): r.confidence for r in density.confidence(counts, rows, columns, sigma, 4.0).collect()}
    assert len(got) == rows * columns
    for (i, j), c in got.items():
        assert c == pytest.approx(min(5 * along(0, i, rows) * along(6, j, columns) / 4, 1), abs=1e-12)
    assert got[(0, 6)] > got[(1, 6)] > got[(2, 6)] > 0 and sum(5 * along(0, i, rows) for i in range(rows)) == pytest.approx(5)


def test_fill(spark):
    cells = spark.createDataFrame([(i, j, 5.0 if (i, j) == (0, 0) else None) for i in range(4) for j in range(4)], "lat_i int, lon_i int, value double")
    assert density.fill_once(cells).filter("value is not null").count() == 4
    assert density.fill(cells).filter("value = 5.0").count() == 16


def test_blend_of_two_cells(spark):
    """Of two cells with other thresholds and confidences only values above their own threshold give way, by their own weight."""
    a, b = [float(v) for v in (0, 0, 2, 4, 6, 8, 20)], [float(v) for v in (1, 1, 1, 1, 30)]
    rows = [(1, 1, 0, 0, x, 3.0 * x, 0.25) for x in a] + [(1, 1, 0, 1, x, None if x == 30 else 9.0, 1.0) for x in b] + [(1, 1, 0, 1, None, 4.0, 1.0)]
    table = spark.createDataFrame(rows, "month int, dekad int, lat_i int, lon_i int, value double, predicted double, sure double")
    for alpha in (0.2, 0.9):
        got = correction.blend(table, alpha=alpha, confidence="sure", percentile=0.6).collect()
        weight = 1 - 0.25 * (1 - alpha)
        want = {0: {x: weight * x + (1 - weight) * 3 * x if x > np.quantile(a, 0.6) else x for x in a}, 1: {x: x for x in b} | {None: None}}
        assert len(got) == 13 and all(r.blended == (pytest.approx(want[r.lon_i][r.value]) if r.value is not None else None) for r in got)
        assert sum(r.blended is not None and r.blended != r.value for r in got) == 3


def test_quantile_map(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(1, 1, 0, 0, day(k), float(r), float(t)) for k, (r, t) in enumerate(zip(rng.gamma(0.7, 12, 800), rng.gamma(0.5, 8, 800), strict=True))] + [(1, 1, 0, 1, day(k), 0.0, 0.0) for k in range(20)]
    table = spark.createDataFrame(rows, "month int, dekad int, lat_i int, lon_i int, time date, ref double, test double")
    p = correction.reference_parameters(table, value="ref")
    assert p.count() == 1
    got = correction.quantile_map(table.withColumn("value", F.col("test")), p).filter("lon_i = 0").agg(F.avg("ref").alias("r"), F.avg("test").alias("t"), F.avg("mapped").alias("m"), F.min("mapped").alias("low"), F.sum((F.col("mapped") > 1).cast("int")).alias("wet"), F.sum((F.col("test") > 1).cast("int")).alias("test_wet")).first()
    assert abs(got.m - got.r) < abs(got.t - got.r) / 3 and got.low >= 0 and got.wet <= got.test_wet
    assert correction.quantile_map(table.withColumn("value", F.col("test")), p).filter("lon_i = 1 and mapped is not null").count() == 0
    assert correction.quantile_map_pairs(table).filter("lon_i = 1 and mapped = 0").count() == 20


def test_predictors(spark):
    rows = spark.createDataFrame([(1, 1, day(k), i, j, float(k + i + j), 2.0 * (k + i + j)) for k in range(12) for i in range(3) for j in range(3)], "month int, dekad int, time date, lat_i int, lon_i int, value double, ref double")
    same = correction.predict(rows, lambda field: field, 3, 3)
    assert same.filter(F.abs(F.col("predicted") - F.col("value")) > 1e-9).count() == 0
    made = correction.apply_filter(rows, correction.train_filter(rows))
    assert made.agg(F.avg(F.abs(F.col("predicted") - F.col("ref")))).first()[0] < 0.5


def test_station_files(spark, tmp_path):
    (tmp_path / "places.csv").write_text("ID;ID_WMO;Station;Lon;Lat;Elevation;a1name\n1;11;A;100.5;-1.5;3;P\n2;22;B;;-2;4;Q\n")
    (tmp_path / "obs.csv").write_text("ID,Date,JD,11,22\n1,02-01-2001,2,8888.0,1\n1,01-01-2001,1,3.5,x\n")
    places = files.station_locations(spark, str(tmp_path / "places.csv"))
    assert [r.ID_WMO for r in places.collect()] == [11]
    got = {(r.station_id, str(r.date)): r.value for r in files.station_observations(spark, str(tmp_path / "obs.csv"), places).collect()}
    assert got == {(11, "2001-01-02"): None, (11, "2001-01-01"): 3.5}
    (tmp_path / "bad.csv").write_text("A,B\n1,2\n")
    with pytest.raises(ValueError, match="Lat, Lon"):
        files.station_locations(spark, str(tmp_path / "bad.csv"))


def test_corrected_sink(spark, tmp_path):
    rows = spark.createDataFrame([("ls", 1, k, day(k), 0, 0, 1.5) for k in (1, 2)], "method string, month int, dekad int, time date, lat_i int, lon_i int, value double")
    for _ in range(2):
        files.write_corrected(rows, str(tmp_path / "out"), alpha="0.7")
    assert files.read_corrected(spark, str(tmp_path / "out"), "ls", 1, 2).count() == 1
    files.write_corrected(rows, str(tmp_path / "out"), policy="skip")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        files.write_corrected(rows, str(tmp_path / "out"), policy="abort")


def test_polygons(spark):
    text = '{"features":[{"type":"Feature","properties":{"iso":"X"},"geometry":{"type":"Polygon","coordinates":[[[0.15,0.15],[0.35,0.15],[0.35,0.25],[0.15,0.25],[0.15,0.15]]]}}]}'
    shapes = files.features(spark.createDataFrame([(text,)], "value string"))
    assert shapes.first().properties["iso"] == "X"
    cells = {(r.lat_i, r.lon_i) for r in polygons.rasterize(shapes, 0.1).collect()}
    assert cells == {(i, j) for i in (1, 2) for j in (1, 2, 3)}


def test_params(tmp_path):
    (tmp_path / "p.json").write_text('{"wet_day": 2.0, "thresholds": [1, 5]}')
    from hyetos.params import load

    p = load(str(tmp_path / "p.json"))
    assert p.wet_day == 2.0 and p.thresholds == (1, 5) and Params().path("corrected_dir", method="ls") == "./output/ls"
    (tmp_path / "q.json").write_text('{"nope": 1}')
    with pytest.raises(ValueError):
        load(str(tmp_path / "q.json"))


def test_dekads():
    assert S.dekad_range(2, 3) == (21, 31)
    with pytest.raises(ValueError):
        S.dekad_range(13, 1)


def test_streams(spark, tmp_path):
    from hyetos.streaming import series

    rows = [("p", 1, day(k), float(k), float(2 * k)) for k in range(40)]
    schema = "product string, station_id long, time date, ref double, test double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = series.running_sums(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in taylor.sums(spark.createDataFrame(rows, schema).withColumns(S.dekad_columns()), ["product", "station_id", "month", "dekad"]).collect()}
    assert {tuple(r) for r in spark.table("sums").collect()} == want and not math.isnan(len(want))
