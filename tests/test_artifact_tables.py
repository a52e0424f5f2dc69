"""Tables of artifacts against the audit of each parsed value."""

import json
import random

import pytest

from tessera.operators import privacy

FLAGS = {x: False for x in privacy.REQUIRED_FALSE_FLAGS}
KEYS = ["Patient-ID", "raw notes", "weights", "note_texts", "rows", "x", "", "metrics", "api\\key", 'hadm"id', "SubŁject_id", "subject\tid", "title"]
VALUES = ["", "plain", "sk-abcdefgh12", "a synthetic_note_text_canary", "model.PT", 'say "x.bin', "back\\slash", "{not: a, key}", "hf_short", "-----BEGIN RSA PRIVATE KEY-----.ckpt", "tab\tand\nline", "é🙂", 0, -3, 2.5, 1e300, True, False, None, 10**30]


def artifact(r, depth=0):
    pick = r.random()
    if depth > 4 or pick < 0.4:
        return r.choice(VALUES)
    if pick < 0.7:
        return [artifact(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {r.choice(KEYS): artifact(r, depth + 1) for _ in range(r.randint(0, 4))}


def root(r):
    kind = r.choice([*privacy.ARTIFACT_KEYS, *privacy.ARTIFACT_KEYS, "other", 3])
    out = {"artifact_type": kind} | {k: r.choice([False] * 6 + [True, None, "no"]) for k in FLAGS if r.random() < 0.95}
    for k in privacy.ARTIFACT_KEYS.get(kind, ("metrics",)):
        if r.random() < 0.8:
            out[k] = r.choice([artifact(r), "text", {r.choice([*privacy.METRIC_FIELDS, *privacy.PROVENANCE_FIELDS, "odd"]): r.choice([*VALUES, [1]]) for _ in range(3)}])
    if r.random() < 0.3:
        out[r.choice(KEYS)] = artifact(r)
    items = list(out.items())
    r.shuffle(items)
    return dict(items)


@pytest.fixture(scope="module")
def given():
    r = random.Random(11)
    good = {"artifact_type": "aggregate_metrics", "metrics": {"record_count": 2, "micro_f1": 0.5}, "limitations": "few"} | FLAGS
    deep = "x"
    for _ in range(300):
        deep = [deep] if r.random() < 0.5 else {"level": deep}
    rows = [good, good | {"metrics": {"uncertainty": deep}}, good | {"metrics": {}}, [], [good], "text", 3, None, {}]
    rows += [root(r) for _ in range(250)] + [artifact(r) for _ in range(80)]
    return rows


def test_tables_equal_parsed_values(spark, given):
    r = random.Random(12)
    places = ["public_report", " Public_Model_Card\t", "private", None]
    rows = []
    for i, x in enumerate(given):
        text = json.dumps(x, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))
        rows.append((i, text, r.choice(places)))
    got = {x.artifact_id: (x.allowed, tuple(x.reasons), x.finding_count) for x in privacy.artifact_audits(spark.createDataFrame(rows, "artifact_id long, artifact string, destination string")).collect()}
    for i, text, place in rows:
        a = privacy.validate_public_artifact(json.loads(text), place)
        assert got[i] == (a.allowed, a.reasons, a.finding_count), text
    assert any(x[0] for x in got.values())


def test_what_is_no_artifact(spark):
    texts = [None, "", "{", '{"a":1,"a":2}', '{"a": NaN}', "[1] x", '{"a":1} {"b":2}', "not json", '{"a":1e999}']
    rows = [(i, t, "public_report") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "artifact_id long, artifact string, destination string")
    audits = {x.artifact_id: x.reasons for x in privacy.artifact_audits(df).collect()}
    assert all(audits[i] == ["unsupported_artifact_value", "artifact_root_invalid"] for i in range(8))
    assert audits[8][0] == "unsupported_artifact_value" and "artifact_root_invalid" not in audits[8]
    assert "Python" not in privacy.artifact_audits(df)._jdf.queryExecution().toString()


def test_long_texts(spark):
    """A long string, many escapes, many tokens."""
    big = {"artifact_type": "documentation", "title": "a" * 200_000, "summary": '"\\' * 20_000, "limitations": "x.pt"} | FLAGS
    many = {"artifact_type": "documentation", "title": "t", "list": [{"k": str(i)} for i in range(5000)] + [{"rows": 1}]} | FLAGS
    rows = [(i, json.dumps(x), "public_report") for i, x in enumerate((big, many))]
    got = {x.artifact_id: (x.reasons, x.finding_count) for x in privacy.artifact_audits(spark.createDataFrame(rows, "artifact_id long, artifact string, destination string")).collect()}
    assert got == {0: (["checkpoint_forbidden"], 1), 1: (["row_membership_forbidden", "artifact_structure_invalid"], 2)}
