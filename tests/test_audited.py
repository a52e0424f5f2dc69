"""Tables that are audited as they are written, notes without column types, sketches across runs."""

import json
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.contracts import PARTITIONS, DedupAudit, DedupPolicy, SplitAssignment, SplitAudit, SplitConfig
from tessera.operators import admissions, split
from tessera.sources.staging import audited, materialized

D = "Discharge summary"
POLICY = DedupPolicy("CATEGORY", D, "note_order", "latest", ("note_row_id",))
NOTE = "SUBJECT_ID string, HADM_ID string, TEXT string, CATEGORY string, note_order long, note_row_id string"
CODE = "SUBJECT_ID string, HADM_ID string, ICD9_CODE string"
ROWS = [("S1", "A1", "old", D, 1, "r1"), ("S1", "A1", "new", D, 2, "r2"), ("S2", "A2", "x", D, 1, "r3"), ("S3", "A3", "z", D, 1, "r4"), ("S2", "A2", "y", "Nursing", 9, "r5")]
CODES = [("S1", "A1", "4019"), ("S1", "A1", "junk"), ("S2", "A2", "V10"), ("S2", "A2", "V10"), ("S3", "A3", "bad"), ("S9", "A9", "4019")]


def under(folder):
    return sorted(x for x in os.listdir(folder) if not x.endswith(".crc"))


def test_refused_tables_leave_nothing(spark, tmp_path):
    def refuse(got):
        assert got == {"n": 5}
        raise ValueError("no")

    make = lambda: (lambda o: (spark.range(5).observe(o, F.count(F.lit(1)).alias("n")), o))(Observation())
    df, seen = make()
    with pytest.raises(ValueError, match="no"):
        audited(df, [seen], refuse, str(tmp_path / "out"))
    assert under(tmp_path) == []
    df, seen = make()
    assert audited(df, [seen], lambda got: None, str(tmp_path / "out")).count() == 5 and under(tmp_path) == ["out"]
    df, seen = make()
    with pytest.raises(FileExistsError):
        audited(df, [seen], lambda got: None, str(tmp_path / "out"))
    bad = spark.range(5).withColumn("x", F.expr("raise_error('in the middle')"))
    with pytest.raises(Exception, match="in the middle"):
        audited(bad, [], lambda got: None, str(tmp_path / "other"))
    assert under(tmp_path) == ["out"]


def test_deduplication_publishes_or_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame(ROWS, NOTE)
    got = admissions.deduplicate_admissions(df, POLICY, path=str(tmp_path / "good"))
    assert got.audit == DedupAudit(5, 4, 3, 1, 1) and spark.read.parquet(str(tmp_path / "good")).count() == 3
    for more, word in ((ROWS[1], "ambiguous"), (("S7", "A2", "x", D, 0, "r"), "ownership"), (("S7", " A7", "x", D, 0, "r"), "HADM_ID")):
        with pytest.raises(ValueError, match=word):
            admissions.deduplicate_admissions(spark.createDataFrame([*ROWS, more], NOTE), POLICY, path=str(tmp_path / "bad"))
    assert under(tmp_path) == ["good"]


def test_prepared_examples_equal_the_two_steps(spark, tmp_path):
    notes, codes = spark.createDataFrame(ROWS, NOTE), spark.createDataFrame(CODES, CODE)
    got = admissions.prepare_examples(notes, POLICY, codes, "drop", str(tmp_path / "made"))
    two = admissions.build_admission_examples(admissions.deduplicate_admissions(notes, POLICY).records, codes, unlabelled="drop")
    rows = lambda df: sorted((r.subject_id, r.hadm_id, r.text, tuple(r.labels), r.partition) for r in df.collect())
    assert rows(got.examples) == rows(two) == [("S1", "A1", "new", ("4019",), None), ("S2", "A2", "x", ("V10",), None)]
    assert got.audit == DedupAudit(5, 4, 3, 1, 1) and got.unlabelled_count == 1
    cases = [(notes, codes, "refuse", "A3"), (notes, codes.union(spark.createDataFrame([("S1", "A2", "x")], CODE)), "drop", "ownership"), (notes.union(notes), codes, "drop", "ambiguous"), (notes.where("1 = 0"), codes, "drop", "empty"), (notes, codes.where("1 = 0"), "refuse", "empty"), (notes, codes, "maybe", "unlabelled")]
    for n, c, way, word in cases:
        with pytest.raises(ValueError, match=word):
            admissions.prepare_examples(n, POLICY, c, way, str(tmp_path / "bad"))
    assert under(tmp_path) == ["made"]
    assert admissions.prepare_examples(notes, POLICY, codes.where("1 = 0"), "drop").unlabelled_count == 3


def test_one_exchange_each_side(spark):
    seen = [Observation(), Observation()]
    big = lambda df: df.hint("merge")
    left = admissions._observed_winners(spark.createDataFrame(ROWS, NOTE), POLICY, seen[0]).select("subject_id", "hadm_id", "text", F.lit(1).alias("_times"))
    plan = admissions._observed_examples(big(left), spark.createDataFrame(CODES, CODE), "drop", seen[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Broadcast" not in plan


def test_split_is_published_with_its_audit(spark, tmp_path):
    rows = [(f"S{k % 40}", str(k), "t", ["4019"], None) for k in range(200)]
    made = split.split_by_subject(spark.createDataFrame(rows, "subject_id string, hadm_id string, text string, labels array<string>, partition string"), SplitConfig("sha256_subject", 8408, 0.6, 0.2, 0.2))
    out = split.write_split(made, str(tmp_path / "split"))
    assert {r.partition: r["count"] for r in out.groupBy("partition").count().collect()} == {p: n for p, n in made.audit.admission_counts if n}
    assert [x for x in under(tmp_path / "split") if "=" in x] == sorted(f"partition={p}" for p, n in made.audit.admission_counts if n)
    counts = tuple(zip(PARTITIONS, (1, 1, 198)))
    wrong = SplitAssignment(made.examples, SplitAudit("sha256_subject", 8408, (0.6, 0.2, 0.2), counts, counts), checked=True)
    with pytest.raises(ValueError, match="counted"):
        split.write_split(wrong, str(tmp_path / "wrong"))
    assert under(tmp_path) == ["split"]


def variants(spark, *rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.parse_json("j").alias("v"))


def note(hadm, order, tie="r", **more):
    return {"SUBJECT_ID": "S" + str(hadm), "HADM_ID": hadm, "TEXT": f"{order}", "CATEGORY": D, "note_order": order, "note_row_id": tie} | more


def test_untyped_notes(spark):
    """Kinds may differ between admissions, not within one; numbers beyond doubles keep their order."""
    rows = [note("A1", 2**53), note("A1", 2**53 + 1), note("A2", "b"), note("A2", "a"), note("A3", 1.5), note("A3", 2.5), note("A4", 7, 1), note("A4", 7, 2), note("A5", 1) | {"CATEGORY": "Nursing", "note_order": "x"}]
    records, policy = admissions.notes_from_variants(variants(spark, *rows), "v", POLICY)
    got = admissions.deduplicate_admissions(records, policy)
    assert {r.hadm_id: r.text for r in got.records.collect()} == {"A1": str(2**53 + 1), "A2": "b", "A3": "2.5", "A4": "7"} and got.audit.eligible_record_count == 8
    for bad, word in (([*rows, note("A1", "2")], "note_order.*int, str"), ([*rows, note("A2", "c", 3)], "note_row_id"), ([*rows, note("A3", 2)], "float, int"), ([*rows, {k: v for k, v in note("A9", 1).items() if k != "TEXT"}], "TEXT")):
        with pytest.raises(ValueError, match=word):
            admissions.notes_from_variants(variants(spark, *bad), "v", POLICY)


def test_kinds(spark):
    values = [1, 10**25, 1.5, 1e300, "x", True, None, [1], {"a": 1}]
    df = spark.createDataFrame([(json.dumps(x),) for x in values], "j string").select(admissions.value_kind(F.parse_json("j")).alias("k"))
    assert [r.k for r in df.collect()] == ["int", "int", "float", "float", "str", "bool", "null", "list", "dict"]


def test_sketches_across_runs(spark):
    """Estimates keep their error, exact ones are exact, and subjects found are those of the exact form."""
    base = spark.range(60_000).select(F.concat(F.lit("s"), F.col("id")).alias("subject_id"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("partition"), F.concat(F.lit("r"), F.col("id") % 3).alias("run"))
    leak = spark.createDataFrame([("s1", "test", "r2"), ("s5", "train", "r0"), ("new", "validation", "r1")], "subject_id string, partition string, run string")
    rows = materialized(base.unionByName(leak))
    for bits in (10, 14):
        made = [split.subject_sketches(rows.where(F.col("run") == r), r, bits) for r in ("r0", "r1", "r2")]
        sketches = materialized(made[0].unionByName(made[1]).unionByName(made[2]))
        for r in split.partition_estimates(sketches, bits).collect():
            want = {"train": 48_001, "test": 12_001, "validation": 1}[r.partition]
            assert abs(r.subjects - want) <= 4 * want / 2 ** (bits / 2)
            assert want > 1 << bits or r.subjects == want
        touched = split.touching(sketches, bits)
        got = split.confirmed_overlap(rows, touched)
        assert sorted(x.subject_id for x in got.collect()) == sorted(x.subject_id for x in split.subject_overlap(rows).collect()) == ["s1", "s5"]
    clean = split.subject_sketches(spark.createDataFrame([("a", "train"), ("b", "test")], "subject_id string, partition string"), "r")
    assert split.touching(clean).count() == 0


def test_subject_counts_are_exact_beyond_the_sketch(spark):
    """Partitions of just under, at, just over and far over the entries of a sketch, in two runs that share subjects."""
    sizes = {"train": 5_000, "validation": 1_024, "test": 1_023, "more": 1_025}
    one = [spark.range(n).select(F.concat(F.lit(p), F.col("id")).alias("subject_id"), F.lit(p).alias("partition"), F.explode(F.array(F.lit("r0"), F.lit("r1"))).alias("run")) for p, n in sizes.items()]
    rows = materialized(one[0].unionByName(one[1]).unionByName(one[2]).unionByName(one[3]))
    made = [split.subject_sketches(rows.where(F.col("run") == r), r, 10) for r in ("r0", "r1")]
    sketches = materialized(made[0].unionByName(made[1]))
    assert {r.partition: r.subjects for r in split.subject_counts(rows, sketches, 10).collect()} == sizes
    # The same from two runs that touch nothing: a full sketch may be a sample, so it is named.
    assert {r.partition for r in split.touching(sketches, 10).collect()} == set(sizes)
