"""Tables written on the way, where driver and executors both see them.

They stand in spark.checkpoint.dir under the application's id. Lineage ends at them, so a lost
executor costs no recomputation of what led there. The application deletes them when it ends. A table can
be audited as it is written, and is seen only if its audit is accepted.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

_own = ""


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    global _own
    _own = _own or tempfile.mkdtemp(prefix="tessera-")
    return _own


def path_of(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession):
    """The application's own folder in the shared one, and its file system."""
    return path_of(spark, f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}")


def materialized(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table in the application's folder."""
    spark = df.sparkSession
    folder, files = scratch(spark)
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    path = f"{folder.toString()}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that `materialized` made and nothing will read again."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path:
            place, files = path_of(df.sparkSession, path)
            files.delete(place, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that this application has written on the way; lazy results that stand on
    them can't be read after."""
    folder, files = scratch(spark)
    files.delete(folder, True)


class _Seen(dict):
    """Observed metrics; what Spark didn't observe, as it knew that there are no rows, counts 0."""

    def __missing__(self, name: str) -> int:
        return 0


def _seen(observations: list[Observation]) -> dict:
    found = _Seen()
    for o in observations:
        try:
            found.update(o.get)
        except Py4JJavaError:  # a row without a schema stands for no metrics
            pass
    return found


def audited(df: DataFrame, observations: list[Observation], accept: Callable[[dict], None], path: str | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df as a table, by one job, once accept has seen what was observed while its rows were
    written. accept raises to refuse them; nothing is left then. With a path the table is moved there
    after it was accepted, whole, and never over one that is there; else it stays in the
    application's folder.

    Observations must stand behind the last exchange of df's plan: tasks of the last stage count
    once, however often executors are lost."""
    spark = df.sparkSession
    if path:
        target, files = path_of(spark, path)
        if files.exists(target):
            raise FileExistsError(path)
        staged = f"{target.getParent().toString()}/.staged-{uuid.uuid4().hex}"
    else:
        folder, files = scratch(spark)
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        staged = f"{folder.toString()}/{uuid.uuid4().hex}-audited"
    place, files = path_of(spark, staged)
    try:
        df.write.partitionBy(*partition_by).parquet(staged)
        accept(_seen(observations))
        if path and not files.rename(place, target):
            raise OSError(f"{path}: the accepted table could not be moved there")
    except BaseException:
        files.delete(place, True)
        raise
    out = spark.read.schema(df.schema).parquet(path or staged)
    if not path:
        out._written = staged
    return out
