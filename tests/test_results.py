"""Results held against their audits, sources and the gated sink, batch forms, command rules."""

import datetime
import json

import pytest

from tessera import contracts as C
from tessera.operators import admissions, governance, models, privacy, provenance
from tessera.sources import tables

ARTIFACT = {"artifact_type": "aggregate_metrics", "metrics": {"record_count": 2}} | {x: False for x in privacy.REQUIRED_FALSE_FLAGS}


def test_results_agree_with_their_audits(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "hadm_id string, subject_id string")
    assert C.DedupResult(rows, C.DedupAudit(2, 2, 2, 0, 0)).records.count() == 2
    for records, audit, word in ((rows, (3, 3, 3, 0, 0), "present"), (rows.union(rows), (4, 4, 4, 0, 0), "more than once")):
        with pytest.raises(ValueError, match=word):
            C.DedupResult(records, C.DedupAudit(*audit))
    digest = "a" * 64
    encoded = lambda *x: spark.createDataFrame([(list(v),) for v in x], "encoded array<int>")
    assert C.EncodedLabels(encoded((0, 1), (1, 1)), digest, C.LabelTransformAudit(2, 0, 0)).vocabulary_hash == digest
    for given, n, word in ((encoded((0, 1)), 2, "present"), (encoded((0, 1), (1,)), 2, "rows of"), (encoded((0, 2), (1, 1)), 2, "more than 0 and 1")):
        with pytest.raises(ValueError, match=word):
            C.EncodedLabels(given, digest, C.LabelTransformAudit(n, 0, 0))
    with pytest.raises(ValueError, match="vocabulary_hash"):
        C.EncodedLabels(encoded((0,)), "0" * 64, C.LabelTransformAudit(1, 0, 0))
    audit = C.TokenizationAudit("synthetic-x", "test-1", 4, "right", "do_not_pad", 1, 0, 2, 2, 0)
    batch = lambda m: spark.createDataFrame([([1, 2], m)], "input_ids array<int>, attention_mask array<int>")
    assert C.TokenizedBatch(batch([1, 1]), audit).rows.count() == 1
    for given, word in ((batch([1]), "another length"), (batch([1, 1]).union(batch([1, 1])), "present")):
        with pytest.raises(ValueError, match=word):
            C.TokenizedBatch(given, audit)


def test_assignments_agree_with_their_audits(spark):
    counts = lambda *n: tuple(zip(C.PARTITIONS, n))
    audit = lambda *n: C.SplitAudit("sha256_subject", 1, (0.6, 0.2, 0.2), counts(*n), counts(*n))
    rows = lambda *x: spark.createDataFrame(list(x), "subject_id string, hadm_id string, partition string")
    good = rows(("a", "1", "train"), ("b", "2", "test"))
    assert C.SplitAssignment(good, audit(1, 0, 1)).test.count() == 1
    bad = [(good, (1, 1, 1), "counts"), (rows(("a", "1", "train"), ("a", "2", "test")), (1, 0, 1), "overlap"), (rows(("a", "1", "holdout")), (1, 0, 0), "tag"), (rows(("a", "1", None)), (1, 0, 0), "tag")]
    for given, n, word in bad:
        with pytest.raises(ValueError, match=word):
            C.SplitAssignment(given, audit(*n))


@pytest.mark.parametrize("counts", [(5, 6, 2, 4, 1), (5, 3, 4, -1, 0), (5, 3, 2, 2, 1), (5, 3, 0, 3, 1), (5, 3, 2, 1, 0), (5, 3, 3, 0, 1), (5, 4, 2, 2, 3)])
def test_impossible_dedup_counts(counts):
    with pytest.raises(ValueError, match="audit"):
        C.DedupAudit(*counts)


def test_json_source(tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"seed": 8408, "name": "é"}), encoding="utf-8")
    assert tables.read_json(str(path)) == {"seed": 8408, "name": "é"}
    with pytest.raises(FileNotFoundError):
        tables.read_json(str(tmp_path / "none.json"))
    path.write_text("{", encoding="utf-8")
    with pytest.raises(ValueError):
        tables.read_json(str(path))


def test_only_audited_tables_are_written(spark, tmp_path):
    df = spark.range(2)
    assert privacy.write_public(df, f"{tmp_path}/good", ARTIFACT, "public_report").allowed
    assert spark.read.parquet(f"{tmp_path}/good").count() == 2
    for artifact, destination, word in ((ARTIFACT | {"metrics": {"subject_id": 1}}, "public_report", "identifier_forbidden"), (ARTIFACT, "elsewhere", "destination_not_public")):
        with pytest.raises(PermissionError, match=word):
            privacy.write_public(df, f"{tmp_path}/bad", artifact, destination)
    assert not (tmp_path / "bad").exists()


def test_batch_gate_reads_places_as_the_driver_form_does(spark):
    day = datetime.date(2029, 1, 1)
    manifest = governance.RightsEnvironmentManifest(1, False, "d", "r", "t", "approved", datetime.date(2030, 1, 1), "x", frozenset({"secure-a"}), False, frozenset(), "p", "a")
    schema = "fixture_only boolean, rights_status string, rights_expires_on date, approved_locations array<string>, kaggle_allowed boolean, raw_transfer_allowed_locations array<string>, requested_location string, raw_transfer_requested boolean, as_of_date date"
    for place in ("\tSecure-A\n", "secure-a", " SECURE-A", " ", None, "kaggle:x"):
        row = (False, "approved", datetime.date(2030, 1, 1), ["secure-a"], False, [], place, False, day)
        got = governance.data_access_decisions(spark.createDataFrame([row], schema)).first()
        want = governance.evaluate_data_access(manifest, place, as_of_date=day)
        assert (got.allowed, tuple(got.reasons)) == (want.allowed, want.reasons), place


def test_parameters_named_by_blanks_and_many_that_train(spark):
    schema = "name string, trainable boolean, count long"
    blank = models.audit_full_trainability(spark.createDataFrame([("\t", True, 1), ("head.w", True, 1)], schema), "head")
    assert "parameter_records_invalid" in blank.reasons
    names = sorted(f"base.{k}" for k in range(1500))
    rows = [(x, True, 1) for x in names] + [("enc.query.lora_A.weight", True, 1), ("head.w", True, 1)]
    a = models.audit_lora_trainability(spark.createDataFrame(rows, schema), ("query",), "head")
    assert "unexpected_trainable_base" in a.reasons and a.unexpected_trainable_parameters == tuple(names)


@pytest.mark.parametrize("command, allowed", [
    (["python", "-m", "unittest"], True), (["Python3.EXE", "-m", "compileall", "src/x"], True), (["python", "-m", "unittest", "tests/data/x"], False), (["python", "-c", "x"], False), (["python", "-m"], False),
    (["python", "-m", "unittest2"], False), (["rg", "pattern", "src"], True), (["RG.exe"], True), (["rg", "--pre", "x"], False), (["rg", "a", "--PREtty"], False), (["rg", "a;b"], False), (["rg", "a|b"], False),
    (["rg", "/etc/x"], False), (["rg", "a/../b"], False), (["rg", "c:x"], False), (["rg", "a\\b"], False), (["rg", "Secrets/x"], False), (["rg", "my-secrets/x"], True), (["bash"], False), (["test-path", "weights"], False),
])
def test_commands(command, allowed):
    assert provenance.command_allowed(command) is allowed


@pytest.mark.parametrize("path, allowed", [
    ("artifacts/synthetic/a.json", True), ("Artifacts/Synthetic/x/y.json", True), ("artifacts/synthetic/", False), ("artifacts/synthetic", False), ("artifacts/synthetic//a", False), ("artifacts/synthetic/./a", False),
    ("artifacts/synthetic/../a", False), ("artifacts/synthetic/.hidden", True), ("artifacts/synthetic/a.PT", False), ("artifacts/synthetic/a:b", False), ("x/artifacts/synthetic/a", False), ("artifacts/synthetic/a\\b", False),
])
def test_artifact_paths(path, allowed):
    assert provenance.artifact_allowed(path) is allowed


def test_checks_of_examples(spark):
    """Each refusal of the combined checks, and what must not be refused."""
    notes = spark.createDataFrame([("s1", "1", "t"), ("s2", "2", "u")], "SUBJECT_ID string, HADM_ID string, TEXT string")
    codes = lambda *x: spark.createDataFrame(list(x), "SUBJECT_ID string, HADM_ID string, ICD9_CODE string")
    good = [("s1", "1", "4019"), ("s2", "2", "250.00"), ("s9", "9", "4019")]  # an unknown admission may name anyone
    assert {r.hadm_id: r.labels for r in admissions.build_admission_examples(notes, codes(*good)).collect()} == {"1": ["4019"], "2": ["250.00"]}
    for extra, word in (([("s9", "1", "4019")], "ownership"), ([(None, "1", "4019")], "ownership"), ([("s9", "1", "bad")], "ownership")):
        with pytest.raises(ValueError, match=word):
            admissions.build_admission_examples(notes, codes(*good, *extra))
    with pytest.raises(ValueError, match="'2'"):
        admissions.build_admission_examples(notes, codes(good[0], ("s2", "2", "bad")))
    with pytest.raises(ValueError, match="duplicate"):
        admissions.build_admission_examples(notes.union(notes), codes(*good))
    plain = spark.createDataFrame([("1", "4019"), ("2", "4019")], "HADM_ID string, ICD9_CODE string")
    assert admissions.build_admission_examples(notes, plain).count() == 2


def test_batch_training_gate(spark):
    day = datetime.date(2029, 1, 1)
    fixed = governance.FIXTURE_LOCATION
    manifest = lambda fixture: governance.RightsEnvironmentManifest(1, fixture, "d", "r", "t", "approved", datetime.date(2030, 1, 1), "x", frozenset({fixed, "kaggle"}), False, frozenset(), "p", "a")
    good = {"location": fixed} | {x: x == "synthetic_only" for x in governance.RUNTIME_FLAGS}
    cases = [(f, good | change) for f in (True, False) for change in ({}, *({x: not good[x]} for x in governance.RUNTIME_FLAGS), {"location": " Kaggle "}, {"location": "x"}, {"location": None}, {"gpu_job": None})]
    rows = [(k, f, "approved", datetime.date(2030, 1, 1), [fixed, "kaggle"], False, [], r["location"], day, *(r[x] for x in governance.RUNTIME_FLAGS)) for k, (f, r) in enumerate(cases)]
    schema = "k int, fixture_only boolean, rights_status string, rights_expires_on date, approved_locations array<string>, kaggle_allowed boolean, raw_transfer_allowed_locations array<string>, requested_location string, as_of_date date, " + ", ".join(f"{x} boolean" for x in governance.RUNTIME_FLAGS)
    got = {r.k: (r.allowed, tuple(r.reasons)) for r in governance.training_decisions(spark.createDataFrame(rows, schema)).collect()}
    for k, (fixture, runtime) in enumerate(cases):
        want = governance.authorize_training(manifest(fixture), runtime, as_of_date=day)
        assert got[k] == (want.allowed, want.reasons), (fixture, runtime)


def test_batch_registries(spark):
    def spec(name, **other):
        family, kind = models.SYSTEMS[name]
        own = {"tokenizer_reference": None, "tokenizer_revision": None} if name == "rule" else {"tokenizer_reference": f"{family}-t", "tokenizer_revision": "commit:" + "b" * 40}
        return models.ModelSpec(**({"logical_system": name, "family": family, "adaptation": kind, "model_reference": f"{family}-m", "model_revision": "commit:" + "a" * 40, "label_contract_digest": "l", "output_contract": "o"} | own | other))

    every = [spec(x) for x in models.SYSTEMS]
    changed = lambda name, **other: [spec(x, **(other if x == name else {})) for x in models.SYSTEMS]
    cases = {
        "valid": every, "missing": every[1:], "twice": [*every, every[2]], "loose": changed("general_full", model_revision="main"), "family": changed("domain_full", model_reference="x"), "label": changed("rule", label_contract_digest="z"),
        "output": changed("rule", output_contract="z"), "blank": changed("rule", output_contract=" "), "ruled": changed("rule", tokenizer_reference="t"), "odd": changed("rule", family="domain"), "none": changed("rule", model_reference=None),
        "other": [*every[:4], models.ModelSpec(**(every[4].as_mapping() | {"logical_system": "new"}))], "case": changed("general_lora", model_revision=" COMMIT:" + "A" * 40),
    }
    names = list(every[0].as_mapping())
    rows = [(k, *(s.as_mapping()[x] for x in names)) for k, specs in cases.items() for s in specs]
    table = spark.createDataFrame(rows, "registry_id string, " + ", ".join(f"{x} string" for x in names))
    got = {r.registry_id: (r.allowed, set(r.reasons), r.system_count) for r in models.registry_audits(table).collect()}
    for k, specs in cases.items():
        want = models.validate_five_system_registry(specs)
        assert got[k] == (want.allowed, set(want.reasons), want.system_count), k
