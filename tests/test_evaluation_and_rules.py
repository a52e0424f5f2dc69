import datetime
import json

import pytest

from tessera.operators import governance as G
from tessera.operators import models as M
from tessera.operators import privacy as P
from tessera.operators.metrics import MetricsResult, TaggedScores, UntouchedTestSession, from_matrix, multilabel_metrics, select_global_threshold
from tessera.operators.provenance import RunProvenance

TRUTH, SCORES = ((1, 0, 1), (0, 1, 0)), ((0.9, 0.2, 0.8), (0.7, 0.6, 0.1))


def measured(spark, truth=TRUTH, scores=SCORES, threshold=0.5, ks=(1, 5), policy="available"):
    return multilabel_metrics(from_matrix(spark, truth, "y"), from_matrix(spark, scores, "score"), threshold, ks, policy)


def test_metrics(spark):
    got = measured(spark)
    assert got.micro_f1 == 6 / 7 and got.macro_f1 == pytest.approx(8 / 9) and got.per_label_support == (1, 1, 1)
    assert (got.sample_count, got.label_count) == (2, 3)
    assert dict(got.precision_at_k)[1] == 0.5 and dict(got.precision_at_k)[5] == 0.5
    assert dict(measured(spark, policy="k").precision_at_k)[5] == pytest.approx(0.3)
    assert dict(measured(spark, ((0, 1),), ((0.5, 0.5),), ks=(1,)).precision_at_k)[1] == 0.0  # ties by index
    assert measured(spark, ((0, 0),), ((0.1, 0.1),), ks=(1,)).micro_f1 == 0.0
    assert measured(spark, ((1,),), ((0.5,),), ks=(1,)).micro_f1 == 1.0  # the threshold itself counts


@pytest.mark.parametrize(
    "changed, code",
    [
        ({"truth": ((2, 0, 1), (0, 1, 0))}, "metric_matrix_invalid"), ({"scores": ((0.9, 0.2, 1.8), (0.7, 0.6, 0.1))}, "metric_matrix_invalid"),
        ({"scores": ((0.9, 0.2, float("nan")), (0.7, 0.6, 0.1))}, "metric_matrix_invalid"), ({"truth": TRUTH[:1]}, "metric_matrix_invalid"), ({"truth": (), "scores": ()}, "metric_matrix_invalid"),
        ({"threshold": 1.5}, "threshold_invalid"), ({"threshold": True}, "threshold_invalid"), ({"ks": ()}, "precision_k_invalid"), ({"ks": (1, 1)}, "precision_k_invalid"),
        ({"ks": (True,)}, "precision_k_invalid"), ({"ks": 3}, "precision_k_invalid"), ({"policy": "x"}, "short_label_policy_invalid"),
    ],
)
def test_metrics_refuse(spark, changed, code):
    with pytest.raises(ValueError, match=code):
        measured(spark, **changed)


def test_threshold(spark):
    tagged = TaggedScores("validation", from_matrix(spark, ((1,), (0,)), "y"), from_matrix(spark, ((0.6,), (0.2,)), "score"))
    low = select_global_threshold(tagged, (0.75, 0.25, 0.5), "micro_f1", "lowest_threshold")
    assert (low.threshold, low.objective_value, low.candidate_scores) == (0.25, 1.0, ((0.25, 1.0), (0.5, 1.0), (0.75, 0.0)))
    assert select_global_threshold(tagged, (0.75, 0.25, 0.5), "micro_f1", "highest_threshold").threshold == 0.5
    for args, code in (((tagged, (), "micro_f1", "lowest_threshold"), "threshold_candidates_invalid"), ((tagged, (0.1, 0.1), "micro_f1", "lowest_threshold"), "threshold_candidates_invalid"), ((tagged, (0.1,), "macro", "lowest_threshold"), "objective"), ((tagged, (0.1,), "micro_f1", "x"), "tie_break"), ((TaggedScores("test", None, None), (0.1,), "micro_f1", "lowest_threshold"), "validation_partition_required"), ((1, (0.1,), "micro_f1", "lowest_threshold"), "validation_scores_invalid")):
        with pytest.raises(ValueError, match=code):
            select_global_threshold(*args)


def test_session_is_used_once():
    result = MetricsResult(1.0, 1.0, (), (), 1, 1)
    s = UntouchedTestSession()
    assert not s.used and s.evaluate_once(lambda: result) is result and s.used
    for bad, kind, code in ((None, TypeError, "test_evaluator_invalid"), (lambda: 3, TypeError, "test_evaluator_result_invalid"), (lambda: 1 / 0, ZeroDivisionError, "division")):
        s = UntouchedTestSession()
        with pytest.raises(kind, match=code):
            s.evaluate_once(bad)
        with pytest.raises(RuntimeError, match="test_session_already_used"):
            s.evaluate_once(lambda: result)


MANIFEST = {
    "schema_version": 1, "fixture_only": False, "dataset_reference": "d", "source_revision": "r", "data_use_terms_reference": "t", "rights_status": "approved", "rights_expires_on": "2030-01-02",
    "decision_reference": "x", "approved_locations": ["Secure-A", "kaggle"], "kaggle_allowed": False, "raw_transfer_allowed_locations": ["secure-a"], "retention_policy_reference": "p", "artifact_policy_reference": "a",
}
DAY = datetime.date(2030, 1, 1)


def test_access():
    m = G.RightsEnvironmentManifest.from_mapping(MANIFEST)
    assert G.evaluate_data_access(m, " SECURE-a ", True, as_of_date=DAY) == G.GateDecision(True, ())
    assert G.evaluate_data_access(m, "secure-a", as_of_date=datetime.date(2030, 1, 2)).reasons == ("rights_expired",)
    assert G.evaluate_data_access(m, "secure-a", as_of_date=datetime.datetime(2029, 1, 1)).reasons == ("as_of_date_invalid",)
    assert G.evaluate_data_access(m, "kaggle", True, as_of_date=DAY).reasons == ("kaggle_not_allowed", "raw_transfer_not_allowed")
    assert G.evaluate_data_access(m, "kaggle:x", 1, as_of_date=DAY).reasons == ("location_not_approved", "kaggle_not_allowed", "raw_transfer_request_invalid")
    assert G.evaluate_data_access(m, " ", True, as_of_date=DAY).reasons == ("requested_location_invalid",)
    assert G.evaluate_data_access(None, "x", as_of_date=DAY).reasons == ("manifest_invalid",)


@pytest.mark.parametrize(
    "change, code",
    [
        ({"schema_version": True}, "unsupported_schema_version"), ({"fixture_only": 1}, "fixture_only_must_be_boolean"), ({"rights_status": "maybe"}, "invalid_rights_status"), ({"rights_expires_on": "soon"}, "rights_expiry_invalid"),
        ({"approved_locations": []}, "approved_locations_empty"), ({"approved_locations": "x"}, "locations_must_be_sequence"), ({"approved_locations": ["a", "A "]}, "duplicate_locations"), ({"kaggle_allowed": None}, "kaggle_allowed"),
        ({"raw_transfer_allowed_locations": ["z"]}, "raw_transfer_location_not_approved"), ({"dataset_reference": " "}, "required_string_invalid"), ({"more": 1}, "unexpected_manifest_fields"),
    ],
)
def test_manifest_refuses(change, code):
    with pytest.raises(ValueError, match=code):
        G.RightsEnvironmentManifest.from_mapping(MANIFEST | change)


def test_training_gate():
    m = G.RightsEnvironmentManifest.from_mapping(MANIFEST | {"fixture_only": True, "approved_locations": [G.FIXTURE_LOCATION], "raw_transfer_allowed_locations": []})
    good = {"location": G.FIXTURE_LOCATION} | {x: x == "synthetic_only" for x in G.RUNTIME_FLAGS}
    assert G.authorize_training(m, good, as_of_date=DAY).allowed
    codes = ("network_must_be_disabled", "external_logging_forbidden", "training_raw_transfer_forbidden", "synthetic_only_required", "gpu_job_forbidden", "restricted_runtime_forbidden")
    for flag, code in zip(G.RUNTIME_FLAGS, codes, strict=True):
        assert G.authorize_training(m, good | {flag: not good[flag]}, as_of_date=DAY).reasons == (code,)
    assert G.authorize_training(m, good | {"gpu_job": 0}, as_of_date=DAY).reasons == ("runtime_invalid",)
    assert G.authorize_training(G.RightsEnvironmentManifest.from_mapping(MANIFEST), good, as_of_date=DAY).reasons == ("location_not_approved", "live_manifest_training_forbidden")
    assert G.authorize_training({}, good, as_of_date=DAY).reasons == ("manifest_invalid",)


def artifact(**more):
    return {"artifact_type": "aggregate_metrics", **{x: False for x in P.REQUIRED_FALSE_FLAGS}, "metrics": {"micro_f1": 0.5, "record_count": 4}, "limitations": "Synthetic."} | more


@pytest.mark.parametrize(
    "value, destination, reasons",
    [
        (artifact(), "public_report", ()), (artifact(), "elsewhere", ("destination_not_public",)), (artifact(), " Public_Report ", ()),
        (artifact(**{"Note-Text": "x"}), "public_report", ("note_text_forbidden", "artifact_structure_invalid")),
        (artifact(limitations="see model.PT"), "public_report", ("checkpoint_forbidden",)), (artifact(limitations="hf_abcdefgh1"), "public_report", ("secret_forbidden",)),
        (artifact(metrics={"subject_id": 1}), "public_report", ("identifier_forbidden", "artifact_structure_invalid")), (artifact(metrics={"micro_f1": True}), "public_report", ("artifact_structure_invalid",)),
        (artifact(contains_raw_data=True), "public_report", ("raw_data_flag_forbidden",)), (artifact(contains_checkpoints=None), "public_report", ("artifact_flags_invalid",)),
        ([], "public_report", ("artifact_root_invalid",)), (artifact(limitations=("a",)), "public_report", ("unsupported_artifact_value", "artifact_structure_invalid")),
        (artifact(metrics={"micro_f1": float("inf")}), "public_report", ("unsupported_artifact_value", "artifact_structure_invalid")),
    ],
)
def test_artifacts(value, destination, reasons):
    got = P.validate_public_artifact(value, destination)
    assert got.reasons == reasons and got.allowed == (not reasons)


def test_cycles_and_repeated_findings():
    loop = artifact()
    loop["metrics"] = {"micro_f1": 1, "own": loop}
    assert "cyclic_artifact_structure" in P.validate_public_artifact(loop, "public_report").reasons
    twice = P.validate_public_artifact(artifact(text="a", rows=[{"text": 1}]), "public_report")
    assert twice.reasons == ("note_text_forbidden", "row_membership_forbidden", "artifact_structure_invalid") and twice.finding_count == 4


def test_artifact_table(spark):
    rows = [("a", json.dumps(artifact()), "public_report"), ("b", "not json", "public_report"), ("c", None, None)]
    got = {r.artifact_id: r.reasons for r in P.artifact_audits(spark.createDataFrame(rows, "artifact_id string, artifact string, destination string")).collect()}
    assert got["a"] == [] and "artifact_root_invalid" in got["b"] and got["c"][0] == "destination_not_public"


PROVENANCE = {
    "schema_version": 1, "fixture_only": True, "command": ["python", "-m", "unittest", "discover"], "versions": {"python": "3.12"}, "seeds": {"split": 8408},
    "hashes": {"config": "sha256:" + "a" * 64}, "device": {"kind": "cpu", "environment": "local-offline-synthetic"}, "artifact_paths": ["artifacts/synthetic/b.json", "artifacts/synthetic/a.json"],
}


def test_provenance():
    one = RunProvenance.from_mapping(PROVENANCE)
    other = RunProvenance.from_mapping({k: list(v.items())[::-1] if isinstance(v, dict) else v for k, v in PROVENANCE.items()} | {"artifact_paths": PROVENANCE["artifact_paths"][::-1]})
    assert one.digest() == other.digest() and one.digest().startswith("sha256:") and one.artifact_paths[0].endswith("a.json")
    for change, code in (
        ({"schema_version": 2}, "unsupported_provenance_schema"), ({"fixture_only": 1}, "fixture_only_required"), ({"command": []}, "command_invalid"), ({"command": ["bash"]}, "command_not_allowed"),
        ({"command": ["python", "-m", "unittest", "data/x"]}, "command_not_allowed"), ({"command": ["rg", "--pre=x"]}, "command_not_allowed"), ({"command": ["rg", "subject_ids"]}, "sensitive_provenance_content"),
        ({"versions": {}}, "versions_invalid"), ({"seeds": {"a": -1}}, "seeds_invalid"), ({"seeds": {"a": True}}, "seeds_invalid"), ({"hashes": {"a": "x"}}, "hashes_invalid"), ({"device": {"kind": "gpu"}}, "device_scope_invalid"),
        ({"artifact_paths": ["artifacts/synthetic/../x"]}, "artifact_paths_invalid"), ({"artifact_paths": ["artifacts/synthetic/m.pt"]}, "artifact_paths_invalid"), ({"versions": {"note": "hf_abcdefgh1"}}, "sensitive"), ({"x": 1}, "unexpected_provenance_fields"),
    ):
        with pytest.raises(ValueError, match=code):
            RunProvenance.from_mapping(PROVENANCE | change)


def spec(name, **more):
    family, kind = M.SYSTEMS[name]
    tokenizer = (None, None) if name == "rule" else (f"{family}-tok", "commit:" + "b" * 40)
    base = M.ModelSpec(name, family, kind, f"{family}-model", "commit:" + "a" * 40, *tokenizer, "sha256:l", "scores_v1")
    return M.ModelSpec(**(base.as_mapping() | more))


def test_registry():
    every = [spec(x) for x in M.SYSTEMS]
    assert M.validate_five_system_registry(every) == M.RegistryAudit(True, (), 5, tuple(sorted(M.SYSTEMS)))
    for specs, reasons in (
        (every[1:], ("exact_system_set_required",)), ([*every, every[0]], ("duplicate_logical_system",)), ([spec("rule", tokenizer_reference="t"), *every[1:]], ("rule_tokenizer_forbidden",)),
        ([*every[:4], spec("general_full", model_revision="main")], ("neural_revision_not_immutable", "family_revision_mismatch")), ([*every[:4], spec("general_full", output_contract="v2")], ("output_contract_mismatch",)),
        (None, ("registry_invalid", "exact_system_set_required")), ([*every, 3], ("registry_invalid",)), ([spec("rule", family="domain"), *every[1:]], ("logical_system_definition_invalid",)),
    ):
        assert M.validate_five_system_registry(specs).reasons == reasons


PARAMETERS = [
    ("encoder.0.query.weight", False, 64), ("encoder.0.query.lora_A.weight", True, 8), ("encoder.0.query.lora_B.weight", True, 8), ("encoder.0.value.weight", False, 64), ("encoder.0.value.lora_A.weight", True, 8),
    ("encoder.0.value.lora_B.weight", True, 8), ("encoder.0.dense.weight", False, 64), ("classifier.weight", True, 24), ("classifier.bias", True, 3),
]


def test_trainability(spark):
    table = lambda rows: spark.createDataFrame(rows, "name string, trainable boolean, count long")
    audit = lambda rows, targets=("query", "value"), head="classifier": M.audit_lora_trainability(table(rows), targets, head)
    good = audit(PARAMETERS)
    assert good.allowed and (good.adapter_parameter_count, good.classifier_parameter_count) == (32, 27) and good.matched_target_modules == ("encoder.0.query", "encoder.0.value")
    for rows, reason in (
        ([r for r in PARAMETERS if ".lora_" not in r[0]], "target_adapters_missing"), ([(n, t and "value" not in n, c) for n, t, c in PARAMETERS], "adapter_not_fully_trainable"), ([*PARAMETERS, ("encoder.0.dense.lora_A", True, 2)], "unexpected_adapter_target"),
        ([r for r in PARAMETERS if "classifier" not in r[0]], "classifier_missing"), ([(n, t and n != "classifier.bias", c) for n, t, c in PARAMETERS], "classifier_not_fully_trainable"), ([*PARAMETERS, ("embeddings", True, 1)], "unexpected_trainable_base"),
        ([*PARAMETERS, PARAMETERS[0]], "parameter_records_invalid"), ([*PARAMETERS, ("x", False, 0)], "parameter_records_invalid"), ([r for r in PARAMETERS if r[1]], "lora_scope_not_bounded"), ([], "parameter_records_invalid"),
    ):
        assert reason in audit(rows).reasons, reason
    assert audit(PARAMETERS, ("query", "key")).reasons == ("target_suffix_unmatched", "unexpected_adapter_target") and "trainability_config_invalid" in audit(PARAMETERS, ()).reasons
    full = M.audit_full_trainability(table(PARAMETERS), "classifier")
    assert full.reasons == ("full_parameters_not_trainable",) and M.audit_full_trainability(table([(n, True, c) for n, _, c in PARAMETERS]), "classifier").allowed
