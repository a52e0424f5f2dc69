"""Streams against the tables of their rows: several micro-batches, late rows, restarts, ties."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.streaming import latest, replay, windows

SCHEMA = "k string, at timestamp, n long, v double"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def rows_at(spark, *rows):
    """(key, minutes after the start, n)"""
    return spark.createDataFrame([(k, START + datetime.timedelta(minutes=m), n, n / 2) for k, m, n in rows], SCHEMA)


def dealt(spark, tmp_path, *batches):
    path = str(tmp_path / "in")
    for b in batches:
        rows_at(spark, *b).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path, late="10 minutes"):
    return replay.stream_of(spark, path, SCHEMA).withWatermark("at", late)


def agg():
    return [F.count("*").alias("rows"), F.sum("n").alias("total")]


BATCHES = [[("a", 0, 1), ("b", 5, 2), ("a", 25, 3)], [("a", 50, 4), ("b", 52, 5)], [("a", 95, 6), ("c", 96, 7)], [("z", 400, 8)]]


def found(df):
    return sorted((r.k, int((r[0 if not isinstance(r[0], str) else 1].start.replace(tzinfo=None) - datetime.datetime(2024, 1, 1)).total_seconds() // 60), r.rows, r.total) for r in df.collect())


def test_sessions_of_streams_and_tables(spark, tmp_path):
    path = dealt(spark, tmp_path, *BATCHES)
    streamed = replay.run(windows.sessions(stream(spark, path), "at", ["k"], "30 minutes", agg()))
    table = rows_at(spark, *(x for b in BATCHES for x in b))
    whole = windows.sessions(table, "at", ["k"], "30 minutes", agg())
    assert found(whole) == [("a", 0, 3, 8), ("a", 95, 1, 6), ("b", 5, 1, 2), ("b", 52, 1, 5), ("c", 96, 1, 7), ("z", 400, 1, 8)]
    assert found(streamed) == found(windows.closed(whole, "session", table, "at", "10 minutes")) == found(whole)[:-1]


def test_a_row_just_a_gap_later_joins(spark):
    """The session's end belongs to it."""
    whole = windows.sessions(rows_at(spark, ("a", 0, 1), ("a", 30, 1), ("b", 0, 1), ("b", 31, 1)), "at", ["k"], "30 minutes", agg())
    assert [x[0] for x in found(whole)] == ["a", "b", "b"]


def test_late_rows(spark, tmp_path):
    """A late row whose window is open counts; one whose window has left is dropped. (Rows are held
    against the watermark that the batch before the last one has set.)"""
    batches = [[("a", 0, 1), ("a", 61, 1)], [("a", 55, 10), ("a", 130, 1)], [("a", 131, 0)], [("a", 40, 100), ("a", 118, 1000)], [("z", 600, 1)]]
    streamed = replay.run(windows.sliding(stream(spark, dealt(spark, tmp_path, *batches)), "at", ["k"], "1 hour", "1 hour", agg()))
    assert found(streamed) == [("a", 0, 2, 11), ("a", 60, 1, 1), ("a", 120, 2, 1)]


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    path, out, checkpoint = dealt(spark, tmp_path, *BATCHES[:2]), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    make = lambda: windows.sessions(stream(spark, path), "at", ["k"], "30 minutes", agg())
    first = found(replay.run(make(), checkpoint, out))
    dealt(spark, tmp_path, *BATCHES[2:])
    both = found(replay.run(make(), checkpoint, out))
    assert len(first) < len(both) == 5 and both == found(replay.run(make()))


def test_latest_row_of_each_key(spark, tmp_path):
    """The timer of a key runs from its newest row; equal winners are counted; late rows are dropped;
    a restart gives the same."""
    batches = [[("a", 0, 1), ("a", 3, 2), ("b", 4, 9), ("b", 4, 9)], [("a", 12, 1), ("b", 4, 9), ("b", 2, 50)], [("a", 70, 5), ("a", 20, 99)], [("z", 400, 1)]]
    path, out, checkpoint = dealt(spark, tmp_path, *batches[:2]), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    make = lambda: latest.latest_per_key(stream(spark, path), "at", ["k"], ["at", "n"], 30 * 60_000)
    got = lambda df: sorted((r.k, int((r["at"] - START.replace(tzinfo=None)).total_seconds() // 60), r.n, r.v, r.rows, r.tied) for r in df.collect())
    replay.run(make(), checkpoint, out)
    dealt(spark, tmp_path, *batches[2:])
    # a's first stretch ends at 12; at 70 it begins anew only if its timer has run, which the watermark (2) has not yet let it do.
    want = [("a", 70, 5, 2.5, 5, 0), ("b", 4, 9, 4.5, 4, 2)]
    assert got(replay.run(make(), checkpoint, out)) == got(replay.run(make())) == want


def test_earliest(spark, tmp_path):
    batches = [[("a", 5, 2), ("a", 5, 1), ("a", 7, 0)], [("z", 400, 1)]]
    early = latest.latest_per_key(stream(spark, dealt(spark, tmp_path, *batches)), "at", ["k"], ["at", "n"], 60_000, "earliest")
    assert [(r.k, r.n, r.rows, r.tied) for r in replay.run(early).collect()] == [("a", 1, 3, 0)]


def test_payload_keeps_its_types(spark, tmp_path):
    """Whole numbers beside nulls, both kinds of times and decimals come back as they went in."""
    path = str(tmp_path / "in")
    make = "named_struct('k', '{}', 'at', TIMESTAMP'2024-01-0{} 00:00:00.000001Z', 'big', {}, 'local', TIMESTAMP_NTZ'2024-01-01 02:30:00.123456', 'd', cast(1.25 AS decimal(9,3)), 'l', array(1, null))"
    rows = spark.sql("SELECT x.* FROM (SELECT explode(array(" + ", ".join(make.format(*x) for x in (("a", 1, "9007199254740993"), ("b", 1, "cast(null AS bigint)"), ("z", 9, "1L"))) + ")) AS x)")
    rows.coalesce(1).write.parquet(path)
    made = replay.stream_of(spark, path, rows.schema).withWatermark("at", "1 minute")
    got = replay.run(latest.latest_per_key(made, "at", ["k"], ["at"], 60_000)).drop("rows", "tied")
    want = rows.where("k <> 'z'")
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_dealing_keeps_all_rows(spark):
    df = spark.range(100).withColumn("part", (F.col("id") % 3).cast("int"))
    path = replay.deal(df, F.col("part"), 3)
    assert spark.read.parquet(path).count() == 100


def test_dealing_holds_the_order_over_many_partitions(spark):
    """A table of several partitions, each over all times: files don't overlap, and none is late."""
    df = rows_at(spark, *((f"k{n % 7}", n % 900, n) for n in range(3600))).repartition(4)
    path = replay.deal(df, F.col("at"), 8)
    made = replay.run(stream(spark, path, "1 minute").withColumn("file", F.input_file_name()).groupBy(F.window("at", "10 minutes"), "file").agg(F.count("*").alias("rows")))
    assert made.agg(F.sum("rows")).first()[0] == 3560  # all but the last, open window
    times = spark.read.schema(SCHEMA).parquet(path).groupBy(F.input_file_name()).agg(F.min("at").alias("a"), F.max("at").alias("z")).orderBy("a").collect()
    assert len(times) == 8 and all(x.z < y.a for x, y in zip(times, times[1:]))


def test_many_keys_share_a_state(spark, tmp_path):
    """Keys of two columns, nulls and both zeros among them, over several batches: as a table has them,
    and a state holds a row a bucket."""
    batches = [[(None if n % 50 == 7 else f"k{n % 300}", n % 40 + 100 * b, n) for n in range(b, 1500, 2)] for b in range(3)] + [[("z", 2000, 0)], [("z", 2001, 0)]]
    path, checkpoint = dealt(spark, tmp_path, *batches[:4]), str(tmp_path / "checkpoint")
    both = lambda df: df.withColumn("half", F.when(F.col("n") % 4 == 0, F.lit(-0.0)).otherwise(0.0))
    make = lambda: latest.latest_per_key(both(stream(spark, path)), "at", ["k", "half"], ["at", "n"], 300 * 60_000, buckets=8)
    out = str(tmp_path / "out")
    got = replay.run(make(), checkpoint, out)
    table = both(rows_at(spark, *(x for b in batches[:3] for x in b)))
    want = table.groupBy("k", "half").agg(F.max(F.struct("at", "n", "v")).alias("w"), F.count("*").alias("rows"))
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(got.select("k", "half", "at", "n", "v", "rows")) == shown(want.select("k", "half", "w.*", "rows"))
    assert got.where("tied <> 0").count() == 0
    held = spark.read.format("statestore").load(checkpoint)
    assert held.count() == 1  # of z; the others have left
    dealt(spark, tmp_path, [(f"y{n}", 2002, n) for n in range(500)])
    replay.run(make(), checkpoint, out)
    assert spark.read.format("statestore").load(checkpoint).count() == 8


def test_null_order_is_refused(spark, tmp_path):
    path = dealt(spark, tmp_path, [("a", 5, 2), ("z", 400, 1)])
    spark.sql("SELECT 'a' AS k, TIMESTAMP'2024-01-01 00:09:00Z' AS at, cast(null AS bigint) AS n, 0.5D AS v").write.mode("append").parquet(path)
    with pytest.raises(Exception, match="null order value"):
        replay.run(latest.latest_per_key(stream(spark, path), "at", ["k"], ["at", "n"], 60_000))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_without_zone_are_utc(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        one = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.000001' AS ts").select(F.unix_micros(replay.epoch_time("ts"))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert one == 1710037800000001
