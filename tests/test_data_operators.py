import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.contracts import DedupAudit, DedupPolicy, LabelConfig, LabelContract, LabelFitAudit, SplitConfig, TokenizerConfig
from tessera.functions.hashing import boundary, vocabulary_digest
from tessera.functions.identifiers import is_native_code, parse_native_icd9
from tessera.operators.admissions import build_admission_examples, deduplicate_admissions
from tessera.operators.labels import fit_training_label_contract, long_labels, transform_labels
from tessera.operators.split import assert_subject_disjoint, partition_manifest_digest, split_by_subject, subject_overlap
from tessera.operators.tokens import VocabularyTokenizer, tokenize_batch

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests
POLICY = DedupPolicy("CATEGORY", "Discharge summary", "note_order", "latest", ("note_row_id",))
NOTE = "SUBJECT_ID string, HADM_ID string, TEXT string, CATEGORY string, note_order long, note_row_id string"
CODE = "SUBJECT_ID string, HADM_ID string, ICD9_CODE string"
D = "Discharge summary"


def notes(spark, *rows):
    return spark.createDataFrame(list(rows), NOTE)


def test_latest_note_wins_in_any_row_order(spark):
    rows = [("S1", "A1", "old", D, 1, "r1"), ("S1", "A1", "new", D, 2, "r2"), ("S2", "A2", "x", D, 1, "r3"), ("S2", "A2", "y", "Nursing", 9, "r4")]
    for order in (rows, rows[::-1]):
        got = deduplicate_admissions(notes(spark, *order), POLICY, ordered=True)
        assert [(r.hadm_id, r.text) for r in got.records.collect()] == [("A1", "new"), ("A2", "x")]
        assert got.audit == DedupAudit(4, 3, 2, 1, 1)
    early = DedupPolicy("CATEGORY", D, "note_order", "earliest", ("note_row_id",))
    assert {r.text for r in deduplicate_admissions(notes(spark, *rows), early).records.collect()} == {"old", "x"}


def test_tie_break_decides_and_a_full_tie_raises(spark):
    tied = [("S1", "A1", "one", D, 2**53 + 1, "r1"), ("S1", "A1", "two", D, 2**53 + 1, "r2"), ("S1", "A1", "three", D, 2**53, "r9")]
    assert deduplicate_admissions(notes(spark, *tied), POLICY).records.first().text == "two"
    with pytest.raises(ValueError, match="ambiguous"):
        deduplicate_admissions(notes(spark, tied[0], tied[0]), POLICY)
    below = [("S1", "A1", "a", D, 1, "r"), ("S1", "A1", "b", D, 1, "r"), ("S1", "A1", "c", D, 2, "r")]
    assert deduplicate_admissions(notes(spark, *below), POLICY).records.first().text == "c"


@pytest.mark.parametrize(
    "rows, word",
    [
        ([], "empty"),
        ([("S1", "A1", "x", "other", 1, "r")], "empty"),
        ([("S1", "A1", "x", D, 1, "r"), ("S2", "A1", "x", D, 2, "r")], "ownership"),
        ([(None, "A1", "x", D, 1, "r")], "SUBJECT_ID"),
        ([("S1", " A1", "x", D, 1, "r")], "HADM_ID"),
        ([("S1", "", "x", D, 1, "r")], "HADM_ID"),
    ],
)
def test_dedup_refuses(spark, rows, word):
    with pytest.raises(ValueError, match=word):
        deduplicate_admissions(notes(spark, *rows), POLICY)


def test_dedup_needs_columns_and_identifier_types(spark):
    df = notes(spark, (" S1\t", "A1", "x", D, 1, "r"))
    assert deduplicate_admissions(df, POLICY).records.first().subject_id == "S1"
    with pytest.raises(ValueError, match="note_order"):
        deduplicate_admissions(df.drop("note_order"), POLICY)
    with pytest.raises(ValueError, match="HADM_ID"):
        deduplicate_admissions(df.withColumn("HADM_ID", F.lit(1.5)), POLICY)
    with pytest.raises(ValueError, match="type"):
        deduplicate_admissions(df.withColumn("note_row_id", F.lit(True)), POLICY)


def test_audit_contract():
    for bad in ((1, 2, 1, 1, 1), (2, 1, 2, 0, 0), (2, 2, 1, 0, 1), (2, 2, 1, 1, 0), (-1, 0, 0, 0, 0), (2, 2, 0, 2, 1)):
        with pytest.raises(ValueError):
            DedupAudit(*bad)


def test_codes(spark):
    good, bad = ["250.00", "4019", "V10", "V1012.1", "E800", "E8001.22"], ["25", "a41", "v10", "4019.123", "A41.9", "", "4019\n"]
    rows = spark.createDataFrame([(x,) for x in good + bad + [None]], "c string").select(is_native_code(F.col("c"))).collect()
    assert [r[0] for r in rows] == [True] * len(good) + [False] * (len(bad) + 1)
    assert parse_native_icd9("\t4019 ") == "4019"
    with pytest.raises(ValueError):
        parse_native_icd9("A41.9")


def test_examples_join(spark):
    n = notes(spark, ("S1", "A1", "x", D, 1, "r"), ("S2", "A2", "y", D, 1, "r"))
    codes = [("S1", "A1", "4019"), ("S1", "A1", " 250.00"), ("S1", "A1", "4019"), ("S2", "A2", "V10"), ("S2", "A2", "junk"), ("S9", "A9", "4019")]
    got = build_admission_examples(n, spark.createDataFrame(codes, CODE), ordered=True).collect()
    assert [(r.subject_id, r.hadm_id, r.labels, r.partition) for r in got] == [("S1", "A1", ["250.00", "4019"], None), ("S2", "A2", ["V10"], None)]
    for more, word in (([("S1", "A2", "4019")], "ownership"), ([], "A2")):
        with pytest.raises(ValueError, match=word):
            build_admission_examples(n, spark.createDataFrame(codes[:3] + more, CODE))
    with pytest.raises(ValueError, match="duplicate"):
        build_admission_examples(n.union(n), spark.createDataFrame(codes, CODE))
    with pytest.raises(ValueError, match="empty"):
        build_admission_examples(n, spark.createDataFrame([], CODE))


def examples(spark, *rows):
    return spark.createDataFrame([(*r, None)[:5] if len(r) == 4 else r for r in rows], "subject_id string, hadm_id string, text string, labels array<string>, partition string")


CONFIG = SplitConfig("sha256_subject", 8408, 0.6, 0.2, 0.2)


def test_split_golden_membership_and_digest(spark):
    A, B, C = (f"SYNTH-SUBJECT-{x}" for x in "ABC")
    rows = [(A, "H1", "t", ["4019"]), (A, "H2", "t", ["4019"]), (B, "H3", "t", ["4019"]), (C, "H4", "t", ["4019"])]
    got = split_by_subject(examples(spark, *rows), CONFIG)
    assert {(r.subject_id, r.partition) for r in got.examples.collect()} == {(A, "train"), (B, "test"), (C, "validation")}
    assert got.audit.subject_counts == (("train", 1), ("validation", 1), ("test", 1)) and got.audit.admission_counts[0] == ("train", 2)
    assert got.train.count() == 2 and got.validation.count() == 1 and got.test.count() == 1
    assert_subject_disjoint(got)
    assert partition_manifest_digest(got) == partition_manifest_digest(split_by_subject(examples(spark, *rows[::-1]), CONFIG))
    for bad, word in ((rows + rows[:1], "duplicate"), (rows + [("Z", "H1", "t", ["4019"])], "conflict"), ([], "empty")):
        with pytest.raises(ValueError, match=word):
            split_by_subject(examples(spark, *bad), CONFIG)
    moved = got.examples.withColumn("partition", F.when(F.col("hadm_id") == "H1", "test").otherwise(F.col("partition")))
    assert subject_overlap(moved).first().partitions == ["test", "train"]


def test_boundaries_agree_with_float_scores():
    import hashlib

    assert boundary(0.6) == "9999999999999400000000000000000000000000000000000000000000000001"
    assert boundary(0.8) == "cccccccccccccc00000000000000000000000000000000000000000000000000"
    assert boundary(2.0) is None
    for k in range(3000):
        digest = hashlib.sha256(f"8408:{k}".encode())
        score = int(digest.hexdigest(), 16) / float(1 << 256)
        assert (digest.hexdigest() < boundary(0.6)) == (score < 0.6)


def test_vocabulary_golden_hashes(spark):
    assert vocabulary_digest(["4019", "250.00"]) == "4781b019696fb1dc513d1860ff646cb49ad9368e042ba097b445973c98b0ac67"
    rows = [("S1", "A1", "t", ["4019", "250.00"], "train"), ("S2", "A2", "t", ["4019"], "train")]
    both = fit_training_label_contract(examples(spark, *rows), LabelConfig("all_training_labels", 1))
    assert both.vocabulary == ("250.00", "4019") and both.audit == LabelFitAudit(2, 2)
    one = fit_training_label_contract(examples(spark, *rows), LabelConfig("all_training_labels", 2))
    assert one.vocabulary_hash == "1a799f91e80489f19f12e5f18a5b3fec090c14d22b5ff66251cf34f781101b7d"
    encoded = transform_labels(examples(spark, *rows), one)
    assert [r.encoded for r in encoded.rows.orderBy("hadm_id").collect()] == [[1], [1]]
    assert (encoded.audit.example_count, encoded.audit.unknown_label_count, encoded.audit.examples_with_unknown_labels) == (2, 1, 1)
    assert long_labels(examples(spark, *rows), one).where("label_index is null").count() == 1
    for bad, word in ((rows + rows[:1], "duplicate_training_admission"), ([("S", "A", "t", ["4019"], "test")], "training")):
        with pytest.raises(ValueError, match=word):
            fit_training_label_contract(examples(spark, *bad), LabelConfig("all_training_labels", 1))
    with pytest.raises(ValueError, match="vocabulary"):
        fit_training_label_contract(examples(spark, *rows), LabelConfig("all_training_labels", 5))
    with pytest.raises(ValueError):
        LabelContract("all_training_labels", 1, ("a",), "0" * 64, LabelFitAudit(1, 1))


class Opaque:
    """Offers encode_content alone."""

    def __init__(self, base):
        for k in ("identifier", "revision", "pad_token_id", "prefix_special_token_ids", "suffix_special_token_ids", "encode_content"):
            setattr(self, k, getattr(base, k))


def test_tokens_golden(spark):
    words = {x: 11 + k for k, x in enumerate("one two three four five six".split())}
    base = VocabularyTokenizer("synthetic-fake", "test-1", words, 99, 0, (101,), (102,))
    texts = spark.createDataFrame([(0, "one two"), (1, "one two three  four zzz"), (2, "")], "id int, text string")
    for tokenizer in (base, Opaque(base)):
        got = tokenize_batch(texts, tokenizer, TokenizerConfig("synthetic-fake", "test-1", 5, "right", "max_length"))
        rows = {r.id: (r.input_ids, r.attention_mask) for r in got.rows.collect()}
        assert rows[0] == ([101, 11, 12, 102, 0], [1, 1, 1, 1, 0]) and rows[1] == ([101, 11, 12, 13, 102], [1] * 5) and rows[2] == ([101, 102, 0, 0, 0], [1, 1, 0, 0, 0])
        assert (got.audit.example_count, got.audit.truncated_example_count, got.audit.total_content_tokens_before, got.audit.total_content_tokens_after, got.audit.special_tokens_per_example) == (3, 1, 7, 5, 2)
        left = tokenize_batch(texts, tokenizer, TokenizerConfig("synthetic-fake", "test-1", 5, "left", "do_not_pad"))
        assert {r.id: r.input_ids for r in left.rows.collect()}[1] == [101, 13, 14, 99, 102]
        none = tokenize_batch(texts, tokenizer, TokenizerConfig("synthetic-fake", "test-1", 2, "left", "max_length"))
        assert all(r.input_ids == [101, 102] for r in none.rows.collect())
    for config, word in ((TokenizerConfig("synthetic-fake", "test-1", 1, "left", "max_length"), "special"), (TokenizerConfig("synthetic-fake", "test-2", 5, "left", "max_length"), "revision")):
        with pytest.raises(ValueError, match=word):
            tokenize_batch(texts, base, config)
    with pytest.raises(ValueError, match="text"):
        tokenize_batch(spark.createDataFrame([(None,)], "text string"), base, TokenizerConfig("synthetic-fake", "test-1", 5, "left", "max_length"))


@pytest.mark.parametrize("identifier, revision, ok", [("synthetic-a", "test:1", True), ("synthetic-a", "v1", False), ("m", "commit:" + "a" * 40, True), ("m", "commit:" + "a" * 41, False), ("m", "sha256:" + "0" * 64, True), ("m", "main", False), ("m", "", False)])
def test_revision_contract(identifier, revision, ok):
    if ok:
        TokenizerConfig(identifier, revision, 5, "right", "max_length")
    else:
        with pytest.raises(ValueError):
            TokenizerConfig(identifier, revision, 5, "right", "max_length")


def test_configs_refuse():
    for f in (lambda: SplitConfig("md5", 1, 0.6, 0.2, 0.2), lambda: SplitConfig("sha256_subject", 1, 0.6, 0.2, 0.3), lambda: LabelConfig("some", 1), lambda: LabelConfig("all_training_labels", 0), lambda: DedupPolicy("c", "v", "o", "first", ())):
        with pytest.raises(ValueError):
            f()
