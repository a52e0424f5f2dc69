"""Registered queries over `events` as a table and as a stream.

A streamed query deals the events into files in order of time, streams them in FILES micro-batches
(of one file each up to FILE_ROWS rows a file), and returns what has left the state at the end. Its SQL names the windows and keys that the watermark
closes by then. Times are whole microseconds since 1970.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admissions
from ..sources.tables import read_table
from ..streaming import latest, replay, windows
from .registry import query

FILES, FILE_ROWS, LATENESS, LATE_S = 4, 1_000_000, "2 hours", 7200
GAP, GAP_S = "3 hours", 10_800
LENGTH, STEP, LENGTH_S, STEP_S = "6 hours", "2 hours", 21_600, 7200
DAY_S = 86_400


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The table, with `at` as an instant and the day since 1970."""
    rows = read_table(spark, folder, "events")
    return rows.withColumn("at", replay.epoch_time("ts")).drop("ts").withColumn("day", F.expr(f"unix_seconds(at) div {DAY_S}"))


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder)
    each = max(1, math.ceil(rows.count() / FILES / FILE_ROWS))
    path = replay.deal(rows, F.col("at"), FILES * each)
    return replay.stream_of(spark, path, rows.schema, each).withWatermark("at", LATENESS)


def _aggregates() -> list[Column]:
    return [F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total")]


def _sessions(rows: DataFrame) -> DataFrame:
    return windows.sessions(rows, "at", ["user_id"], GAP, _aggregates())


def _sliding(rows: DataFrame) -> DataFrame:
    return windows.sliding(rows, "at", ["event_type"], LENGTH, STEP, _aggregates())


def _flat(found: DataFrame, window: str, key: str) -> DataFrame:
    return found.select(key, *(F.unix_micros(f"{window}.{x}").alias(f"{x}_us") for x in ("start", "end")), "events", "total")


_SESSION_SQL = f"""WITH timed AS (SELECT user_id, value, epoch_us(ts) AS us FROM events),
begun AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= {GAP_S * 1_000_000} THEN 0 ELSE 1 END AS fresh FROM timed),
named AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS nth FROM begun),
found AS (SELECT user_id, min(us) AS start_us, max(us) + {GAP_S * 1_000_000} AS end_us, count(*) AS events, round(sum(value), 2) AS total FROM named GROUP BY user_id, nth)
SELECT user_id, start_us, end_us, events, total FROM found"""
_SLIDING_SQL = f"""WITH placed AS (SELECT event_type, value, (epoch_us(ts) // {STEP_S * 1_000_000} - k) * {STEP_S * 1_000_000} AS start_us FROM events, range({LENGTH_S // STEP_S}) r(k)),
found AS (SELECT event_type, start_us, start_us + {LENGTH_S * 1_000_000} AS end_us, count(*) AS events, round(sum(value), 2) AS total FROM placed GROUP BY event_type, start_us)
SELECT event_type, start_us, end_us, events, total FROM found"""
_PASSED = f" WHERE end_us // 1000 <= (SELECT max(epoch_ms(ts)) - {LATE_S * 1000} FROM events)"


@query("event_sessions", _SESSION_SQL)
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_sessions(events(spark, folder)), "session", "user_id")


@query("event_sessions_streamed", _SESSION_SQL + _PASSED)
def event_sessions_streamed(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(replay.run(_sessions(_stream(spark, folder))), "session", "user_id")


@query("event_sliding_windows", _SLIDING_SQL)
def event_sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_sliding(events(spark, folder)), "window", "event_type")


@query("event_sliding_windows_streamed", _SLIDING_SQL + _PASSED)
def event_sliding_windows_streamed(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(replay.run(_sliding(_stream(spark, folder))), "window", "event_type")


@query("event_latest_streamed", f"""WITH timed AS (SELECT *, epoch_us(ts) // {DAY_S * 1_000_000} AS day, epoch_us(ts) AS us FROM events),
best AS (SELECT *, count(*) OVER (PARTITION BY user_id, day) AS rows FROM timed QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY us DESC, event_id DESC) = 1)
SELECT user_id, day, event_id, event_type, value, us AS at_us, rows, CAST(0 AS BIGINT) AS tied FROM best WHERE us // 1000 + {DAY_S * 1000} < (SELECT max(epoch_ms(ts)) - {LATE_S * 1000} FROM events)""")
def event_latest_streamed(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each user and day, once the day's rows have been quiet for a day."""
    stream = _stream(spark, folder).select("user_id", "day", "event_id", "event_type", "value", "at")
    found = replay.run(latest.latest_per_key(stream, "at", ["user_id", "day"], ["at", "event_id"], DAY_S * 1000))
    return found.withColumn("at_us", F.unix_micros("at")).drop("at")


# Orders that come as texts or as fractions now and then.
@query("event_type_conflicts", """WITH typed AS (SELECT user_id, CASE event_id % 40 WHEN 3 THEN 'str' WHEN 4 THEN 'float' WHEN 5 THEN 'null' ELSE 'int' END AS kind FROM events)
SELECT user_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM typed GROUP BY user_id HAVING count(DISTINCT kind) > 1""")
def event_type_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    case = F.col("event_id") % 40
    shown = F.when(case == 3, F.concat(F.lit('"'), k, F.lit('"'))).when(case == 4, F.concat(k, F.lit(".5"))).when(case == 5, F.lit("null")).otherwise(k)
    rows = read_table(spark, folder, "events").select("user_id", F.parse_json(shown).alias("order"))
    return admissions.type_conflicts(rows, "user_id", ("order",)).select("user_id", F.array_join("kinds", ",").alias("kinds"))
