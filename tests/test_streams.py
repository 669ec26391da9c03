"""Streams: dry spells in any order, and a keyed table that repeated batches leave as it is."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from hyetos.streaming import series, sinks

START = datetime.datetime(2024, 1, 1)


def day(k):
    return START + datetime.timedelta(days=k)


@pytest.mark.parametrize("seed", [1, 2])
def test_dry_spells_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(s, day(k), rng.choice([0.0, 0.3, 2.0, 9.0, None, 0.1])) for s in "abc" for k in range(40) if rng.random() < 0.9]
    want = {}
    for s in "abc":
        spell = 0
        for _, ts, v in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            spell = spell + 1 if v is not None and v < 1 else 0
            want[(s, ts)] = spell
    late = sorted(rows, key=lambda r: r[1] + datetime.timedelta(days=rng.uniform(0, 6)))  # up to six days late
    parts = [late[k : k + 25] for k in range(0, len(late), 25)] + [[(s, day(400), 5.0) for s in "abc"], [("z", day(500), 5.0)], [("z", day(501), 5.0)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "station_id string, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    stream = spark.readStream.schema("station_id string, ts timestamp, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = []
    query = series.dry_spells(stream, delay="7 days").writeStream.outputMode("append").foreachBatch(lambda batch, _: got.extend(batch.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(got) == len({(r.station_id, r.ts) for r in got})  # each goes out once
    assert {(r.station_id, r.ts): r.dry_days for r in got if r.ts < day(100)} == want


def test_upsert_survives_a_stop_between_write_and_commit(spark, tmp_path):
    batches = [[(k, f"first {k}", 0) for k in range(20)], [(k, f"second {k}", 0) for k in range(10, 30)] + [(None, "null", 0)], [(5, "older", 1), (5, "newer", 2), (None, "null again", 0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "k int, text string, at int").coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    table, stops = f"{tmp_path}/table", [1, 2]

    def stop(epoch):
        if epoch in stops:
            stops.remove(epoch)
            raise RuntimeError(f"killed in epoch {epoch}")

    def run():
        stream = spark.readStream.schema("k int, text string, at int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(sinks.upsert(table, ["k"], "at", 4, stop)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    def now():
        return sorted(((r.k, r.text) for r in sinks.read(spark, table).collect()), key=str)

    with pytest.raises(ValueError, match="no commit"):
        sinks.read(spark, table)
    want = {}
    for n, rows in enumerate(batches[:1]):
        want.update({k: x for k, x, _ in rows})
    with pytest.raises(Exception, match="killed in epoch 1"):
        run()
    assert now() == sorted(want.items(), key=str)  # what epoch 1 wrote isn't seen
    with pytest.raises(Exception, match="killed in epoch 2"):
        run()
    want.update({k: x for k, x, _ in batches[1]})
    assert now() == sorted(want.items(), key=str)
    run()
    want.update({5: "newer", None: "null again"})
    assert now() == sorted(want.items(), key=str)
    sinks.upsert(table, ["k"])(spark.createDataFrame([(1, "again", 0)], "k int, text string, at int"), 2)  # an epoch that is committed already
    assert now() == sorted(want.items(), key=str) and sinks.read(spark, table).filter(F.col("k").isNull()).count() == 1
