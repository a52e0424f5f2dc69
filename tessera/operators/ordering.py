"""Running totals over a whole table's order, without a task that sees it whole.

Rows are dealt by ranges of the order, ranges are totalled, and what the ranges before a row's add up
to is carried into it: each task orders one range. Only a row a range reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import materialized


def carried(df: DataFrame, order: list[Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """df with, for each name in sums, the total of its column over all rows that stand before a row
    in the order (the row itself not included). Rows that are equal in the order stand in any one; an
    order that tells all rows apart has one result. A null counts as 0.

    Range bounds come from a sample that another run would draw anew, so the dealt rows are written
    before they are totalled."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    own = {f"_own_{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())}
    dealt = materialized(df.withColumns(own).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    totals = sorted(dealt.groupBy("_range").agg(*(F.sum(c).alias(c) for c in own)).collect())
    before, so_far = [], [0] * len(own)
    for row in totals:
        before.append((row[0], *so_far))
        so_far = [a + b for a, b in zip(so_far, row[1:])]
    names = list(own)
    schema = ", ".join(["_range int", *(f"_before_{i} {dealt.schema[c].dataType.simpleString()}" for i, c in enumerate(names))])
    carry = spark.createDataFrame(before, schema)
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumns({f"_within_{i}": F.coalesce(F.sum(c).over(within), F.lit(0)) for i, c in enumerate(names)})
    out = summed.join(F.broadcast(carry), "_range")  # a row a range
    return out.withColumns({name: F.col(f"_before_{i}") + F.col(f"_within_{i}") for i, name in enumerate(sums)}).drop(
        "_range", *names, *(f"_{k}_{i}" for k in ("within", "before") for i in range(len(names)))
    )


def numbered(df: DataFrame, order: list[Column], copies: Column | None = None, name: str = "number") -> DataFrame:
    """df with each row's place in the order, from 0; a row with copies takes as many places."""
    return carried(df, order, {name: (copies if copies is not None else F.lit(1)).cast("long")})
