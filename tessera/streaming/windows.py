"""Aggregates over event time: sliding windows, and sessions that end after a gap.

One definition serves tables and streams. On a stream with a watermark a window leaves once the
watermark has passed its end; its state goes with it, and rows that come later are dropped. `closed`
takes from a table's windows those that a stream of its rows has emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sliding(rows: DataFrame, time: str, keys: list[str], length: str, step: str, aggregates: list[Column]) -> DataFrame:
    """keys, window (start, end) and aggregates: each row is in every window that covers it. Partial
    sums are made before the exchange."""
    return rows.groupBy(F.window(time, length, step), *keys).agg(*aggregates)


def sessions(rows: DataFrame, time: str, keys: list[str], gap: str, aggregates: list[Column]) -> DataFrame:
    """keys, session (start, end) and aggregates: a session goes on while each row comes less than gap
    after the one before it, and ends gap after its last row."""
    return rows.groupBy(*keys, F.session_window(time, gap).alias("session")).agg(*aggregates)


def closed(windows: DataFrame, window: str, rows: DataFrame, time: str, lateness: str) -> DataFrame:
    """Windows that the watermark passes: those that end no later than the last row, less lateness."""
    last = rows.agg(F.expr(f"max({time}) - INTERVAL {lateness}").alias("_mark"))
    # Watermarks are whole milliseconds.
    return windows.crossJoin(F.broadcast(last)).where(F.unix_millis(f"{window}.end") <= F.unix_millis("_mark")).drop("_mark")  # one row
