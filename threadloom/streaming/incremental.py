"""Structured Streaming forms: windowed counts, gap sessions, run segments.

Timestamps without zone must be cast before a watermark; ``event_time`` does it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed_counts(df: DataFrame, label: str, window: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Counts and sums of ``value`` per window and label; late rows fall under the watermark."""
    g = df.groupBy(F.window(ts, window), label).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), label, "n", "total")


def gap_sessions(df: DataFrame, key: str, gap: str = "30 minutes", ts: str = "ts") -> DataFrame:
    """Segments of a key's rows that lie no more than ``gap`` apart."""
    g = df.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_segments(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """W01 over a stream: for each key the open run is state; a run is emitted
    once its value changes: ``key, value, start, end`` in positions."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pos, at, open_value = state.get if state.exists else (0, 0, None)
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for v in rows[value]:
            if open_value is not None and v != open_value:
                out.append((k[0], open_value, at, pos))
                at = pos
            open_value, pos = v, pos + 1
        state.update((pos, at, open_value))
        yield pd.DataFrame(out, columns=["key", "value", "start", "end"])

    types = dict(df.dtypes)
    return df.groupBy(key).applyInPandasWithState(step, f"key {types[key]}, value {types[value]}, start long, end long", f"pos long, at long, value {types[value]}", "append", "NoTimeout")
