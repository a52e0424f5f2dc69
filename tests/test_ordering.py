"""Running totals and places over a whole table's order."""

import random

from pyspark.sql import functions as F

from tessera.operators.ordering import carried, numbered


def test_totals_of_what_stands_before(spark):
    r = random.Random(4)
    rows = [(k, r.choice([None, 1, 2, 3]), r.choice("abc")) for k in range(300)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, v long, g string").repartition(4)
    got = {x.k: (x.v_before, x.n_before) for x in carried(df, [F.col("g").desc(), F.col("k").asc()], {"v_before": F.col("v"), "n_before": F.lit(1)}, 7).collect()}
    v = n = 0
    for k, x, _ in sorted(rows, key=lambda x: (-ord(x[2]), x[0])):
        assert got[k] == (v, n)
        v, n = v + (x or 0), n + 1


def test_places_with_copies(spark):
    df = spark.createDataFrame([("b", 3), ("a", 1), ("c", 2)], "s string, copies long")
    assert {x.s: x.number for x in numbered(df, [F.col("s").asc()], F.col("copies")).collect()} == {"a": 0, "b": 1, "c": 4}
    assert numbered(df.where("copies > 9"), [F.col("s").asc()]).count() == 0
