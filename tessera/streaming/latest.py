"""The winner of each key on a stream: what deduplicate_admissions gives for a table.

A key's state is its best row so far and how many rows it has had; a timer in event time ends the key
once nothing of it has come for `quiet` (by the watermark). Then its winner leaves, the state goes,
and what comes still later begins a key anew if the watermark lets it in at all. Rows that are later
than the watermark are dropped by Spark before they get here.

Keys are dealt to buckets by their hash, and a bucket's keys share a state, a timer and a call: the state
is a table of a row a key, and a micro-batch is folded into it by grouping, not key by key. The rows of a
bucket come as batches of Arrow rows, and only the best of each key is kept. Ties at the winning
keys are counted, not decided silently: `tied` is the number of other rows that equal the winner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import on_workers


def _packed(schema: T.StructType, names: list[str]) -> tuple[Column, Callable]:
    """The named columns as one JSON text, and what makes columns of it again. Pandas would turn whole
    numbers beside nulls into floating point; a text stays as it is."""
    kinds = {x: schema[x].dataType for x in names}
    micros, texts = ([x for x in names if isinstance(kinds[x], k)] for k in (T.TimestampType, T.TimestampNTZType))
    out = F.to_json(F.struct(*(F.unix_micros(x).alias(x) if x in micros else F.col(x).cast("string").alias(x) if x in texts else F.col(x) for x in names))) if names else F.lit("{}")
    shape = T.StructType([T.StructField(x, T.LongType() if x in micros else T.StringType() if x in texts else kinds[x]) for x in names])

    def back(df: DataFrame) -> DataFrame:
        df = df.withColumn("_packed", F.from_json("_packed", shape))
        value = {x: F.col(f"_packed.{x}") for x in names}
        return df.withColumns({x: F.timestamp_micros(value[x]) if x in micros else value[x].cast(kinds[x]) for x in names}).drop("_packed")

    return out, back


#: Buckets of keys. A task holds one of them at a time; a checkpoint is bound to their number.
BUCKETS = 512


def _folded(rows, names: list[str], ascending: bool):
    """A row for each `_key`: its best order values and their payload (the earliest of equal ones), the
    rows, how many of them equal the best, and the newest time."""
    import pandas as pd

    rows = rows.sort_values(names, ascending=ascending, kind="stable", ignore_index=True)
    code, keys = pd.factorize(rows["_key"])
    code = pd.Series(code)
    best = rows.loc[~code.duplicated()].reset_index(drop=True)  # the k-th of them has code k
    equal = rows["equal"].where((rows[names].to_numpy() == best[names].to_numpy()[code]).all(axis=1), 0)
    for name, value in (("rows", rows["rows"].groupby(code).sum()), ("equal", equal.groupby(code).sum()), ("newest", rows["newest"].groupby(code).max())):
        best[name] = value.to_numpy()
    return best


def latest_per_key(stream: DataFrame, time: str, keys: list[str], order: list[str], quiet_ms: int, keep: str = "latest", buckets: int = BUCKETS) -> DataFrame:
    """keys, the other columns of the winner by `order` (time first, as a rule), rows (of the key) and
    tied. stream has a watermark on time. Null order values raise. Order columns are whole numbers,
    texts or times; a key that is quiet for longer than quiet_ms, by the watermark, is done."""
    on_workers(stream.sparkSession)
    schema = stream.schema
    # Keys meet as texts, so the two zeros of fractions are made one, as grouping would.
    stream = stream.withColumns({x: F.col(x) + F.lit(0).cast(schema[x].dataType) for x in keys if isinstance(schema[x].dataType, T.FractionalType) and not isinstance(schema[x].dataType, T.DecimalType)})
    key, keys_back = _packed(schema, keys)
    payload, back = _packed(schema, [x for x in schema.names if x not in (*keys, *order)])
    times = [isinstance(schema[x].dataType, T.TimestampType) for x in order]
    orders = [(F.unix_micros(x) if t else F.col(x)).alias(f"_order_{i}") for i, (x, t) in enumerate(zip(order, times))]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")
    at = [time] if time not in keys else []
    given = stream.select(bucket, *at, F.unix_millis(time).alias("newest"), *orders, key.alias("_key"), payload.alias("_payload"))
    out_schema = T.StructType([
        T.StructField("_key", T.StringType()), *(T.StructField(f"_order_{i}", T.LongType() if t else schema[x].dataType) for i, (x, t) in enumerate(zip(order, times))),
        T.StructField("_payload", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("tied", T.LongType()),
    ])
    names, ascending = [f"_order_{i}" for i in range(len(order))], keep != "latest"

    def work(_: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd
        import pyarrow as pa

        mark = state.getCurrentWatermarkMs()
        held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else None
        fresh = None
        for frame in frames if not state.hasTimedOut else ():
            if frame[names].isnull().any().any():
                raise ValueError("a null order value on the stream")
            frame = frame[["_key", *names, "_payload", "newest"]].assign(rows=1, equal=1)
            fresh = _folded(frame if fresh is None else pd.concat([fresh, frame], ignore_index=True), names, ascending)
        done = None
        if held is not None:
            # A timer runs only for keys that nothing has come of in this batch.
            over = held["due"] < mark
            if fresh is not None:
                over &= ~held["_key"].isin(fresh["_key"])
            done, held = held[over], held[~over]
        if fresh is not None:
            if held is not None:
                again = held["_key"].isin(fresh["_key"])
                fresh = _folded(pd.concat([held.loc[again, fresh.columns], fresh], ignore_index=True), names, ascending)
                held = held[~again]
            fresh["due"] = (fresh["newest"] + quiet_ms).clip(lower=mark + 1)
            held = fresh if held is None else pd.concat([held, fresh], ignore_index=True)
        if held is None or held.empty:
            state.remove()
        else:
            table, sink = pa.Table.from_pandas(held, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(int(held["due"].min()))
        if done is not None and len(done):
            yield done.assign(tied=done["equal"] - 1)[out_schema.names].reset_index(drop=True)

    won = given.groupBy("_bucket").applyInPandasWithState(work, out_schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    restored = won.withColumns({x: F.timestamp_micros(f"_order_{i}") if t else F.col(f"_order_{i}") for i, (x, t) in enumerate(zip(order, times))}).drop(*names)
    restored = back(restored.withColumnRenamed("_payload", "_packed"))
    restored = keys_back(restored.withColumnRenamed("_key", "_packed"))
    return restored.select(*schema.names, "rows", "tied")
