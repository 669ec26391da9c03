"""Structured Streaming forms of the running aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyetos.functions.scalar import dekad_columns
from hyetos.operators import taylor


def running_sums(pairs: DataFrame) -> DataFrame:
    """Six sums by product, station, month and dekad (update or complete mode); statistics follow by `taylor.stats`."""
    return taylor.sums(pairs.withColumns(dekad_columns()), ["product", "station_id", "month", "dekad"])


def without_duplicates(rows: DataFrame, delay: str = "7 days") -> DataFrame:
    """One row for each station and time stamp, remembered for `delay`."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["station_id", "ts"])


def rolling_day(rows: DataFrame, delay: str = "2 days", start: str = "0 hours") -> DataFrame:
    """24-hour sums every hour, by station; `start` moves the windows (append mode)."""
    window = F.window("ts", "24 hours", "1 hour", start)
    return rows.withWatermark("ts", delay).groupBy(window, "station_id").agg(F.sum("value").alias("value")).select("station_id", F.col("window.end").alias("until"), "value")


def dekad_totals(rows: DataFrame, delay: str = "31 days") -> DataFrame:
    """Sums by calendar dekad: its key is derived, as no window of fixed width fits it (update mode)."""
    days = rows.withWatermark("ts", delay).withColumns(dekad_columns("ts"))
    return days.groupBy("station_id", "year", "month", "dekad").agg(F.sum("value").alias("value"), F.count("value").alias("n"))


def dry_spells(rows: DataFrame, threshold: float = 1.0, delay: str = "7 days") -> DataFrame:
    """(station_id, ts, dry_days): how many values in a row, up to and with each, lie under `threshold`.

    Rows may come in any order within `delay`: a station's state holds those that the watermark hasn't passed, and the
    length of the spell before them. When it passes a row, no earlier one can come, and the row's count goes out, once
    (append mode). So the result is that of all rows in order; rows beyond the delay are dropped. A missing value ends the
    spell; rows of one station and time count in the order of their values, missing ones first.
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        spell, times, values = state.get if state.exists else (0, [], [])
        came = [b for b in batches]
        held = pd.concat([pd.DataFrame({"ts": pd.Series(list(times), dtype="datetime64[ns]"), "value": pd.Series(list(values), dtype=float)}), *[b[["ts", "value"]] for b in came]])
        held = held.sort_values(["ts", "value"], na_position="first")
        passed = held["ts"] <= pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        done, held = held[passed], held[~passed]
        dry = (done["value"] < threshold).to_numpy()
        # Within a run of dry rows the count rises by one from the last row that wasn't dry, or from the spell before.
        at = np.arange(1, len(dry) + 1)
        last_wet = np.maximum.accumulate(np.where(dry, -spell, at)) if len(dry) else at
        counts = at - last_wet
        if len(held):
            state.update((int(counts[-1]) if len(counts) else spell, held["ts"].dt.to_pydatetime().tolist(), [None if np.isnan(v) else float(v) for v in held["value"]]))
            state.setTimeoutTimestamp(max(int(held["ts"].min().timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        else:
            state.update((int(counts[-1]) if len(counts) else spell, [], []))
        yield pd.DataFrame({"station_id": [key[0]] * len(done), "ts": done["ts"].to_numpy(), "dry_days": counts})

    kind = dict(rows.dtypes)["station_id"]
    kept = "spell long, times array<timestamp>, values array<double>"
    return rows.withWatermark("ts", delay).groupBy("station_id").applyInPandasWithState(run, f"station_id {kind}, ts timestamp, dry_days long", kept, "append", "EventTimeTimeout")
