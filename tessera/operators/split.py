"""Deterministic partitions by subject."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..contracts import PARTITIONS, SplitAssignment, SplitAudit, SplitConfig, require
from ..functions.hashing import below, canonical_json, sha256_hex, subject_hash
from ..sources.staging import audited


def partition_of(subject: Column, config: SplitConfig) -> Column:
    """A row-wise expression: no shuffle, and equal for all rows of a subject."""
    score = subject_hash(subject, config.seed)
    train, validation, _ = config.ratios
    return F.when(below(score, train), PARTITIONS[0]).when(below(score, train + validation), PARTITIONS[1]).otherwise(PARTITIONS[2])


def partition_counts(examples: DataFrame) -> DataFrame:
    """partition, subjects, admissions in a fixed order of partitions, zeros included."""
    spark = examples.sparkSession
    names = spark.createDataFrame(list(enumerate(PARTITIONS)), "place int, partition string")
    counts = examples.groupBy("partition").agg(F.count_distinct("subject_id").alias("subjects"), F.count("*").alias("admissions"))
    filled = names.join(F.broadcast(counts), "partition", "left")  # counts has three rows at most
    return filled.select("place", "partition", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("subjects", "admissions")))


def subject_overlap(examples: DataFrame) -> DataFrame:
    """Subjects in several partitions, found in one pass."""
    return examples.groupBy("subject_id").agg(F.array_sort(F.collect_set("partition")).alias("partitions")).where(F.size("partitions") > 1)


def split_by_subject(examples: DataFrame, config: SplitConfig, ordered: bool = False) -> SplitAssignment:
    """Every admission of a subject in the partition of the subject's hash.

    Raises ValueError on an empty input, a repeated admission, or one of several subjects."""
    dealt = examples.withColumn("partition", partition_of(F.col("subject_id"), config))
    # Admissions, then subjects, then partitions, by one plan that ends in three rows.
    admissions = dealt.groupBy("hadm_id").agg(F.count("*").alias("n"), F.min("subject_id").alias("subject_id"), F.max("subject_id").alias("z"), F.min("partition").alias("partition"))
    wrong = F.min(F.when(F.col("n") > 1, F.struct("hadm_id", (~F.col("subject_id").eqNullSafe(F.col("z"))).alias("clash")))).alias("wrong")
    subjects = admissions.groupBy("partition", "subject_id").agg(F.sum("n").alias("n"), wrong)
    rows = {r.partition: r for r in subjects.groupBy("partition").agg(F.count("*").alias("subjects"), F.sum("n").alias("admissions"), F.min("wrong").alias("wrong")).collect()}
    require((len(rows) > 0, "split examples cannot be empty"))
    first = min((r.wrong for r in rows.values() if r.wrong), default=None)
    if first:
        raise ValueError(f"{'conflicting admission ownership for' if first.clash else 'duplicate admission before split:'} {first.hadm_id}")
    counts = lambda what: tuple((p, rows[p][what] if p in rows else 0) for p in PARTITIONS)
    audit = SplitAudit(config.algorithm, config.seed, config.ratios, counts("subjects"), counts("admissions"))
    return SplitAssignment(dealt.orderBy("partition", "subject_id", "hadm_id") if ordered else dealt, audit, checked=True)


def write_split(assignment: SplitAssignment, path: str) -> DataFrame:
    """The examples at path, a folder a partition, by one job that counts them as it writes: unless
    they are as the audit says, nothing is left there."""
    seen = Observation()
    tag = F.col("partition")
    counted = assignment.examples.observe(seen, F.count(F.lit(1)).alias("all"), *(F.count_if(tag == p).alias(p) for p in PARTITIONS))
    want = dict(assignment.audit.admission_counts)

    def accept(got: dict) -> None:
        require(
            (got["all"] == sum(want.values()), f"audit: {sum(want.values())} admissions counted, {got['all']} written"),
            *((got[p] == want[p], f"audit: {want[p]} admissions of {p} counted, {got[p]} written") for p in PARTITIONS),
        )

    return audited(counted, [seen], accept, path, ("partition",))


def assert_subject_disjoint(assignment: SplitAssignment) -> None:
    bad = subject_overlap(assignment.examples).select("partitions").limit(1).collect()
    require((not bad, f"subject overlap between {' and '.join(bad[0][0][:2])}" if bad else ""))


def partition_manifest_digest(assignment: SplitAssignment) -> str:
    """SHA-256 of the audit as canonical JSON; nothing but counts and the configuration."""
    assert_subject_disjoint(assignment)
    return sha256_hex(canonical_json(asdict(assignment.audit)))


# -- across runs ---------------------------------------------------------------------------------

#: Entries of a theta sketch, as a power of two: its estimates err by some 1 / sqrt(2**SKETCH_BITS).
SKETCH_BITS = 14


def subject_sketches(examples: DataFrame, run: str, bits: int = SKETCH_BITS) -> DataFrame:
    """run, partition and a mergeable sketch of its subjects: some 8 * 2**bits bytes a row, whatever
    the run's size. Kept per run, they tell of overlaps without the runs' rows."""
    return examples.groupBy("partition").agg(F.theta_sketch_agg("subject_id", bits).alias("subjects")).select(F.lit(run).alias("run"), "partition", "subjects")


def partition_estimates(sketches: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """partition and its subjects over all runs, about: sketches merge, a subject of several runs
    counts once."""
    return sketches.groupBy("partition").agg(F.theta_sketch_estimate(F.theta_union_agg("subjects", bits)).alias("subjects"))


def subject_counts(examples: DataFrame, sketches: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """partition and its subjects over all runs, exactly: by the merged sketch where that holds every
    subject, which is where it tells of fewer than 2**bits; the other partitions' rows are counted."""
    told = partition_estimates(sketches, bits)
    full = told.where(F.col("subjects") >= 1 << bits).select("partition")
    counted = examples.join(F.broadcast(full), "partition", "left_semi").groupBy("partition").agg(F.count_distinct("subject_id").alias("subjects"))  # a row a partition
    return told.where(F.col("subjects") < 1 << bits).unionByName(counted)


def touching(sketches: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """run, partition, other_partition and shared (about): where a run's partition may share a subject
    with another partition of any run. Sketches of fewer than 2**bits subjects hold them all and miss
    nothing; others may be samples, so where one takes part the pair is named whatever they share.
    Each run is held against the merged sketch of each partition, not against each run."""
    merged = sketches.groupBy("partition").agg(F.theta_union_agg("subjects", bits).alias("_all")).withColumnRenamed("partition", "other_partition")
    both = sketches.join(F.broadcast(merged), F.col("partition") != F.col("other_partition"))  # a row a partition
    shared = F.theta_sketch_estimate(F.theta_intersection("subjects", "_all"))
    sampled = F.greatest(F.theta_sketch_estimate("subjects"), F.theta_sketch_estimate("_all")) >= F.lit(1 << bits)
    return both.select("run", "partition", "other_partition", shared.alias("shared"), sampled.alias("_sampled")).where("shared > 0 OR _sampled").drop("_sampled")


def confirmed_overlap(examples: DataFrame, touched: DataFrame) -> DataFrame:
    """subject_overlap of examples (with their run) over what touches alone: rows of the named runs'
    partitions, and of the partitions that these touch."""
    own = touched.select("run", "partition").distinct()
    others = touched.select(F.col("other_partition").alias("partition")).distinct()
    rows = examples.select("run", "partition", "subject_id")
    named = rows.join(F.broadcast(own), ["run", "partition"], "left_semi")  # three rows a run at most
    beside = rows.join(F.broadcast(others), "partition", "left_semi").select("run", "partition", "subject_id")
    return subject_overlap(named.unionByName(beside))
