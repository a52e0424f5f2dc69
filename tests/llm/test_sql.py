"""Operators whose whole result SQL can express, against that SQL on the smallest tables."""

import os

import duckdb
import pytest

from tessera.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for name_ in ("documents", "benchmark"):
        con.execute(f"create view {name_} as select * from '{FOLDER}/{name_}.parquet'")
    df, relation = QUERIES[name](spark, FOLDER), con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert sorted(map(tuple, df.select(*relation.columns).collect()), key=str) == sorted(relation.fetchall(), key=str)
