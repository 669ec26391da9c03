"""Exact quantiles and ranks of large and skewed groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyetos.operators import order, report


def test_quantiles_are_those_of_percentile(spark):
    rng = np.random.default_rng(2)
    rows = [("few", float(x), None) for x in (3, 1, 2)] + [("one", 5.0, 1.0), (None, 1.0, 2.0), (None, 4.0, 2.0), ("none", None, None)]
    rows += [("zeros", 0.0, float(x)) for x in rng.normal(size=5000)] + [("wild", float(x), float(np.exp(20 * x))) for x in rng.normal(size=5000)] + [("wild", 1e300, -1e300)]
    table = spark.createDataFrame(rows, "k string, a double, b double").repartition(5)
    shares = {"_low": 0.0, "_q": 0.25, "_m": 0.5, "_p": 0.999, "_top": 1.0}
    want = table.groupBy("k").agg(*[F.percentile(v, F.lit(p)).alias(f"{v}{n}") for v in ("a", "b") for n, p in shares.items()])
    for accuracy in (100, 100_000):
        got = {r.k: r for r in order.quantiles(table, ["k"], ["a", "b"], shares, accuracy).collect()}
        assert len(got) == 6
        for r in want.collect():
            for name in r.asDict():
                assert got[r.k][name] == pytest.approx(r[name], rel=1e-12) if isinstance(r[name], float) else got[r.k][name] == r[name]
    assert order.medians(table, [], ["a"]).first().a == table.agg(F.percentile("a", F.lit(0.5))).first()[0]
    assert order.medians(table.limit(0), [], ["a"]).collect() == [(None,)] and order.medians(table.limit(0), ["k"], ["a"]).collect() == []


def test_one_group_of_ten_million_rows(spark):
    """Of the second pass only values inside the brackets leave the tasks, and one count each."""
    big = spark.range(10_000_000).select(F.lit(1).alias("k"), ((F.col("id") * 48271) % 2147483647 / 7.0).alias("x"))
    got = order.quantiles(big, ["k"], ["x"], {"_m": 0.5, "_p": 0.9})
    values = np.sort(np.arange(10_000_000, dtype=np.int64) * 48271 % 2147483647 / 7.0)
    r = got.first()
    assert r.x_m == pytest.approx(np.quantile(values, 0.5), rel=1e-12) and r.x_p == pytest.approx(np.quantile(values, 0.9), rel=1e-12)


@pytest.mark.parametrize("values", ["outlier", "ties", "same"])
def test_ranks_of_skewed_values(spark, values):
    x = {"outlier": [float(k) / 1e6 for k in range(9999)] + [1e12], "ties": [float(k % 3) for k in range(10000)], "same": [1.0] * 10000}[values]
    rows = spark.createDataFrame([(k, v, k % 2) for k, v in enumerate(x)], "id long, x double, key int").repartition(6)
    got = order.ranks(rows, "x", ["id"], partitions=8)
    want = {k: n for n, k in enumerate(sorted(range(10000), key=lambda k: (x[k], k)), 1)}
    assert {r.id: r["rank"] for r in got.collect()} == want and got.filter("group_size <> 10000").count() == 0
    sizes = [r["count"] for r in rows.repartitionByRange(8, "x", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * 10000 / 8
    each = {r.id: (r["rank"], r.group_size) for r in order.ranks(rows, "x", ["id"], ["key"], 8).collect()}
    for key in (0, 1):
        assert {k: each[k] for k in range(key, 10000, 2)} == {k: (n, 5000) for n, k in enumerate(sorted(range(key, 10000, 2), key=lambda k: (x[k], k)), 1)}


def test_rows_that_are_all_equal_are_spread(spark):
    rows = spark.range(0, 8000, 1, 4).select(F.lit(3.0).alias("x"))
    got = order.ranks(rows, "x", partitions=8)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 8001))


def test_ecdf_and_longitude_ranks(spark):
    rows = spark.createDataFrame([("a", 2.0, 1), ("a", None, 2), ("a", 1.0, 3), ("a", 2.0, 4), ("b", 7.0, 5)], "k string, v double, id int")
    assert {r.id: r.ecdf for r in report.ecdf(rows, ["k"], "v", ["id"]).collect()} == {3: 1 / 3, 1: 2 / 3, 4: 1.0, 5: 1.0}
    assert {r.id: r["rank"] for r in report.ranked(rows.filter("v is not null"), "v", ["id"]).collect()} == {3: 1, 1: 2, 4: 3, 5: 4}
