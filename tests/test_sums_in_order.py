"""Float sums that thresholds and percentiles are compared with."""

import datetime
import itertools
import random

from pyspark.sql import functions as F

from hyetos.operators import correction
from hyetos.sources import tables


def test_events_of_a_day_are_added_in_their_order(spark, tmp_path):
    """Three values with a sum of 25 whose sum depends on the order."""
    values = next(v for v in ((a / 100, b / 100, (2500 - a - b) / 100) for a in range(101, 900, 7) for b in range(103, 900, 11)) if len({x + y + z for x, y, z in itertools.permutations(v)}) > 1)
    at = datetime.datetime(2024, 1, 1)
    for k, order in enumerate(itertools.permutations(range(3))):
        rows = [(n, at + datetime.timedelta(hours=n), 7, "view", values[n], "{}") for n in order]
        for n, row in enumerate(rows):
            spark.createDataFrame([row], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.mode("append").parquet(f"{tmp_path}/{k}/events.parquet")
        assert tables.station_pairs(spark, f"{tmp_path}/{k}").first().ref == values[0] + values[1] + values[2]


def test_limits_of_a_blend_come_from_the_same_run(spark):
    """Values that differ from run to run in the last bits: the largest of six is above the percentile, the one that is the percentile isn't."""
    noise = F.udf(lambda k: random.random() * 1e-9, "double").asNondeterministic()
    rows = spark.range(600).select((F.col("id") % 100).alias("k"), (1 + F.floor(F.col("id") / 100)).cast("double").alias("value"), F.lit(50.0).alias("predicted"))
    out = correction.blend(rows.withColumn("value", F.col("value") + noise("k")), ["k"], alpha=0.5)
    assert out.filter("blended > 20").count() == 100 and out.filter("blended > 20 and value < 5.5").count() == 0
