"""Queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
SOME = (
    "dekad_filter", "inner_align", "nearest_unbounded", "bilinear_regrid", "metrics31_pooled", "station_metrics", "threshold_scores", "quality_assessment", "taylor_station", "taylor_dekad_median",
    "gaussian_confidence", "nan_smooth", "fillmiss_one_pass", "extreme_threshold_blend", "rank_quantile_map", "lag_correlation", "best_product",
)


def test_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", SOME)
def test_against_duckdb(spark, name):
    from hyetos.plans import catalogue

    db = duckdb.connect()
    for file in os.listdir(DATA):
        db.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    got, want = catalogue.queries()[name](spark, DATA).toPandas(), db.sql(catalogue.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda t: sorted(map(repr, t[columns].astype(object).where(t[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["lag_correlation_hourly", "best_offset_hourly"])
def test_every_hour_against_duckdb(spark, name):
    test_against_duckdb(spark, name)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_sweep_has_every_hour(spark):
    from hyetos.plans import catalogue

    got = catalogue.queries()["lag_correlation_hourly"](spark, DATA)
    assert sorted(r.h for r in got.select("h").distinct().collect()) == list(range(-48, 49))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_rolling_windows_of_every_hour(spark):
    from hyetos.plans import catalogue

    test_against_duckdb(spark, "rolling_24h_hourly")
    assert catalogue.queries()["rolling_24h_hourly"](spark, DATA).filter("hour % 24 <> 0").count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_nearest_day_of_every_supplier(spark):
    from hyetos.plans import catalogue

    db = duckdb.connect()
    have = {}
    for k, x in db.sql(f"SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) FROM '{DATA}/lineitem.parquet'").fetchall():
        have.setdefault(k, []).append(x)
    days = [x for (x,) in db.sql(f"SELECT DISTINCT CAST(o_orderdate AS DATE) FROM '{DATA}/orders.parquet'").fetchall()]
    want = {(k, str(x), str(min(xs, key=lambda y: (abs((y - x).days), -y.toordinal())))) for k, xs in have.items() for x in days}
    got = catalogue.queries()["nearest_time_asof_by_supplier"](spark, DATA).collect()
    assert len(got) == len(want) and {(r.supplier, r.target, r.source) for r in got} == want
