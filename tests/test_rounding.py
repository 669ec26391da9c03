"""Values that are rounded for the comparison with SQL."""

import duckdb
from pyspark.sql import functions as F

from hyetos.functions import scalar as S


def test_millionths_are_rounded_as_in_sql(spark):
    """Ratios that end half way between two millionths, or a last bit beside it."""
    ratios = [101.63499999999999 / 80, 0.8659375, -0.8659375, 1 / 640, 3 / 1280, -1e-9, 0.0, 123456.7890125, 1e300, *[k / n for n in (640, 1280, 1920, 3200) for k in range(1, n, 7)]]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(ratios)], "k int, x double").select(S.r6(F.col("x")).alias("y"), "k").orderBy("k").collect()
    said = duckdb.sql(f"SELECT round(x, 6) + 0.0::DOUBLE FROM (SELECT unnest({ratios}::DOUBLE[]) AS x)").fetchall()
    assert [r.y for r in got] == [x for (x,) in said]
