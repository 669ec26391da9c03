"""The nearest day of each group, without pairs and without frames that are computed anew for every row."""

import datetime
import random

import pytest

from hyetos.operators import align

DAY = datetime.date(2024, 1, 1)


@pytest.mark.parametrize("ties", ["larger", "smaller"])
def test_nearest_days_against_all_pairs(spark, ties):
    rng = random.Random(3)
    have = {(k, DAY + datetime.timedelta(days=rng.randrange(60))) for k in "abc" for _ in range(8)} | {("d", DAY), ("e", None), ("a", None)}
    want = {DAY + datetime.timedelta(days=rng.randrange(-20, 90)) for _ in range(50)}
    got = align.nearest_days(spark.createDataFrame(list(have), "k string, x date"), spark.createDataFrame([(x,) for x in want], "x date"), by=["k"], ties=ties)
    side = -1 if ties == "larger" else 1
    best = lambda k, t: min((x for j, x in have if j == k and x), key=lambda x: (abs((x - t).days), side * x.toordinal()), default=None)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((k, t, best(k, t))) for k in "abcde" for t in want)


def test_no_frame_to_the_last_row(spark):
    rows = spark.createDataFrame([(1.0,), (4.0,)], "x double")
    assert "unboundedfollowing" not in align.nearest(rows, rows)._jdf.queryExecution().executedPlan().toString().lower()
