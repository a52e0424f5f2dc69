"""What the operators share: inputs, the shared folder, written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import on_workers
from ..sources.staging import clean_up, forget, materialized, shared_dir  # noqa: F401

#: Word separators in bytes and as a Java character class: \x20 and \x09-\x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut and a lost executor loses nothing.
    The application's tables go when it ends, or by `forget` or `clean_up` before."""
    return materialized(df, name)


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


#: Bytes of an Arrow batch, about; Spark's own bound is eight times that.
BATCH_BYTES = 8 << 20


def modest_batches(spark: SparkSession) -> None:
    """Ask for smaller Arrow batches in this session, as whole texts make wide rows. All operators
    with Python on executors start here, so workers are told where this package is, too."""
    on_workers(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of df with the smallest hash of key, about; fewer than 2 n reach one task,
    however many rows and tasks there are. (A key that many rows repeat is in or out as one,
    and the last limit holds in any case.) For rows of a few numbers: they are sorted whole."""
    df = hash_share(df, n, key)
    return df.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 40)), *df.columns).limit(n)


def hash_share(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """About n rows of df (1.2 n), by a bound on the hash of keys; nothing is moved or sorted."""
    total = df.count()
    if total > 2 * n:
        space = 1 << 40
        df = df.where(F.pmod(F.xxhash64(*keys), F.lit(space)) < int(space * 1.2 * n / total))
    return df


def parts_for(spark: SparkSession, n: int = 0) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), n)
