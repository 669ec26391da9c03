"""Lag curves: no pairs are shuffled, and the best offset is found where sums differ from run to run."""

import datetime
import random

from pyspark.sql import functions as F

from hyetos.operators import report, taylor


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_offset_of_a_curve_that_is_not_repeatable(spark):
    noise = F.udf(lambda h: random.random() * 1e-12, "double").asNondeterministic()
    curve = spark.createDataFrame([(0, h, 1 - abs(h - 2) / 40) for h in range(-48, 49)] + [(1, h, None) for h in range(3)], "band int, h int, r double")
    got = taylor.best_offset(curve.withColumn("r", F.col("r") + noise("h")), ["band"]).collect()
    assert [(r.band, r.best_h, r.band_low, r.band_high) for r in got] == [(0, 2, 2, 2)]


def test_lag_sums_against_pairs(spark):
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1, 5)
    rows = [(start + datetime.timedelta(minutes=rng.randrange(6 * 24 * 60)), rng.randrange(6), rng.choice(["view", "click", "error"]), float(rng.randrange(100))) for _ in range(300)]
    rolled = report.rolling_days(spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string, value double"))
    table = {(r.station_id, r.hour): (r.ref, r.test) for r in rolled.collect()}
    at = lambda ts: int((ts - datetime.datetime(1970, 1, 1)).total_seconds() // 3600)
    hours = range(min(at(r[0]) for r in rows), max(at(r[0]) for r in rows) + 1)
    plain = {(k, h): tuple(sum(r[3] for r in rows if r[1] == k and r[2] == e and h - 23 <= at(r[0]) <= h) for e in ("view", "click")) for k in {r[1] for r in rows} for h in hours}
    assert table == plain
    for offsets in (range(-48, 49), (-25, 0, 7)):
        sums = report.lag_sums(rolled.withColumn("band", F.col("station_id") % 2), offsets, ["band"])
        assert "Join" not in plan(sums)
        want = {}
        for (k, hour), (ref, _) in table.items():
            for h in offsets:
                if hour % 24 == 0 and (k, hour + h) in table:
                    test = table[k, hour + h][1]
                    want[k % 2, h] = [a + b for a, b in zip(want.get((k % 2, h), [0] * 6), (1, ref, test, ref * ref, test * test, ref * test), strict=True)]
        assert {(r.band, r.h): [r.n, r.so, r.sp, r.soo, r.spp, r.sop] for r in sums.collect()} == want
