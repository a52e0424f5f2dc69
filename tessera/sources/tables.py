"""Sources: Parquet tables, in-memory records, JSON manifests; and the clinical shapes of the
driver's tables."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import DedupPolicy

#: The mapping's deduplication keys; the short one leaves ambiguous winners on purpose.
POLICY_KEYS = ("l_linenumber", "l_partkey", "l_suppkey")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def from_records(spark: SparkSession, records: Iterable[Mapping], schema: str | None = None) -> DataFrame:
    """Small in-memory records as a DataFrame."""
    rows = [dict(r) for r in records]
    return spark.createDataFrame(rows, schema) if schema else spark.createDataFrame(rows)


def read_json(path: str) -> dict:
    """A small JSON manifest or configuration, on the driver."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def policy(keep: str = "latest", ties: tuple[str, ...] = POLICY_KEYS) -> DedupPolicy:
    return DedupPolicy("CATEGORY", "R", "l_shipdate", keep, ties)


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """SUBJECT_ID, HADM_ID, TEXT, CATEGORY and the order keys, a row for each line item."""
    lines, orders = read_table(spark, folder, "lineitem"), read_table(spark, folder, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").cast("string").alias("SUBJECT_ID"), F.col("o_orderkey").cast("string").alias("HADM_ID"),
        F.concat_ws(" ", "l_linestatus", F.col("l_partkey").cast("string")).alias("TEXT"), F.col("l_returnflag").alias("CATEGORY"), "l_shipdate", *POLICY_KEYS,
    )


def diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    """SUBJECT_ID, HADM_ID, ICD9_CODE; parts of size 1 have an invalid code."""
    lines, part, orders = (read_table(spark, folder, x) for x in ("lineitem", "part", "orders"))
    code = F.when(F.col("p_size") == 1, F.lit("A41.9")).otherwise(F.concat(F.lit("4"), F.lpad(F.regexp_replace("p_brand", r"\D", ""), 2, "0")))
    joined = lines.join(part, lines["l_partkey"] == part["p_partkey"]).join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.select(F.col("o_custkey").cast("string").alias("SUBJECT_ID"), F.col("o_orderkey").cast("string").alias("HADM_ID"), code.alias("ICD9_CODE"))
