"""Audit of artifacts before they leave: only aggregate, documented, non-sensitive content.

An artifact is walked once, depth first in its own order; every key and value may add findings.
Then its root is held against the contract of its type. Results name reasons, never content.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import stripped

# What may be published, and names and patterns that may not appear.
PUBLIC_DESTINATIONS = ("public_model_card", "public_report", "public_repository")
REQUIRED_FALSE_FLAGS = ("contains_checkpoints", "contains_identifiers", "contains_raw_data", "contains_row_level_data")
ARTIFACT_KEYS = {
    "aggregate_metrics": ("limitations", "metrics"),
    "documentation": ("limitations", "summary", "title"),
    "non_sensitive_provenance": ("provenance",),
}
METRIC_FIELDS = ("macro_f1", "micro_f1", "parameter_count", "precision_at_10", "precision_at_5", "record_count", "runtime_seconds", "uncertainty")
PROVENANCE_FIELDS = ("artifact_digest", "command_digest", "config_digest", "created_on", "manifest_digest", "model_revision", "runtime", "seed", "tokenizer_revision")
FORBIDDEN_KEYS = {
    "note_text_forbidden": ("clinical_note", "clinical_text", "discharge_summary", "note", "note_content", "note_text", "notes", "raw_note", "raw_notes", "text"),
    "identifier_forbidden": ("admission_id", "admission_ids", "hadm_id", "hadm_ids", "mrn", "patient_id", "patient_ids", "record_id", "record_ids", "subject_id", "subject_ids"),
    "secret_forbidden": ("access_token", "api_key", "apikey", "auth_token", "client_secret", "credentials", "hf_token", "password", "private_key", "secret", "wandb_api_key"),
    "row_membership_forbidden": ("content", "membership", "partition_membership", "row_ids", "row_membership", "rows", "split_membership"),
    "checkpoint_forbidden": ("checkpoint", "checkpoint_path", "checkpoints", "model_state", "optimizer_state", "state_dict", "weight_path", "weights"),
}
CHECKPOINT_SUFFIXES = (".bin", ".ckpt", ".h5", ".hdf5", ".onnx", ".pt", ".pth", ".safetensors")
NOTE_PATTERN = r"(?i)SYNTHETIC_NOTE_TEXT_CANARY"
SECRET_PATTERNS = {
    "canary": r"(?i)SYNTHETIC_SECRET_CANARY",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "service_token": r"\b(?:sk-[A-Za-z0-9_-]{8,}|hf_[A-Za-z0-9_-]{8,})\b",
    "access_key": r"\bAKIA[A-Z0-9]{16}\b",
}

_KEY_REASON = {key: reason for reason, keys in FORBIDDEN_KEYS.items() for key in keys}
_NOTE = re.compile(NOTE_PATTERN)
_SECRETS = [re.compile(x) for x in SECRET_PATTERNS.values()]


@dataclass(frozen=True)
class PrivacyAudit:
    """finding_count counts repeated findings; reasons has each once, in order of appearance."""

    allowed: bool
    reasons: tuple[str, ...]
    finding_count: int


def _number(x: object) -> bool:
    return type(x) is int or type(x) is float and math.isfinite(x)


def _scalar(x: object) -> bool:
    return x is None or isinstance(x, (str, bool)) or _number(x)


def _of_value(x: object) -> Iterator[str]:
    if isinstance(x, str):
        if _NOTE.search(x):
            yield "note_text_forbidden"
        if any(p.search(x) for p in _SECRETS):
            yield "secret_forbidden"
        if x.casefold().endswith(CHECKPOINT_SUFFIXES):
            yield "checkpoint_forbidden"
    elif not _scalar(x):
        yield "unsupported_artifact_value"


def _walk(root: object) -> Iterator[str]:
    """Findings in depth-first order, without recursion. The stack holds iterators over the
    containers that are open, so one that is met again while open is a cycle."""
    stack: list[tuple[int, Iterator]] = [(0, iter([(None, root)]))]
    open_ids: set[int] = set()
    while stack:
        own, items = stack[-1]
        try:
            key, value = next(items)
        except StopIteration:
            stack.pop()
            open_ids.discard(own)
            continue
        if key is not None:
            name = re.sub(r"[^a-z0-9]+", "_", key[0].casefold()).strip("_") if isinstance(key[0], str) else ""
            if name in _KEY_REASON:
                yield _KEY_REASON[name]
        if not isinstance(value, (Mapping, list)):
            yield from _of_value(value)
        elif id(value) in open_ids:
            yield "cyclic_artifact_structure"
        else:
            open_ids.add(id(value))
            children = (((k,), v) for k, v in value.items()) if isinstance(value, Mapping) else ((None, v) for v in value)
            stack.append((id(value), children))


def _root(value: Mapping) -> Iterator[str]:
    kind = value.get("artifact_type")
    own = ARTIFACT_KEYS.get(kind) if isinstance(kind, str) else None
    if own is None:
        yield "artifact_type_not_allowed"
    for flag in REQUIRED_FALSE_FLAGS:
        if type(value.get(flag)) is not bool:
            yield "artifact_flags_invalid"
        elif value[flag]:
            yield flag.removeprefix("contains_") + "_flag_forbidden"
    bad = "artifact_structure_invalid"
    if not set(value) <= {"artifact_type", *REQUIRED_FALSE_FLAGS, *(own or ())}:
        yield bad
    if own is None:
        return
    if kind == "aggregate_metrics":
        metrics = value.get("metrics")
        if not isinstance(metrics, Mapping):
            yield bad
        else:
            yield from [bad] * sum((k not in METRIC_FIELDS) + (not _number(v)) for k, v in metrics.items())
        if not isinstance(value.get("limitations", ""), str):
            yield bad
    if kind == "documentation":
        if not set(own) & set(value):
            yield bad
        if any(not isinstance(value[k], str) for k in own if k in value):
            yield bad
    if kind == "non_sensitive_provenance":
        given = value.get("provenance")
        if not isinstance(given, Mapping):
            yield bad
        else:
            if not set(given) <= set(PROVENANCE_FIELDS):
                yield bad
            if not all(map(_scalar, given.values())):
                yield bad


def validate_public_artifact(value: object, destination: str) -> PrivacyAudit:
    """Audit one artifact of mappings, lists and JSON scalars; denies by default."""
    findings = []
    if not isinstance(destination, str) or destination.strip().casefold() not in PUBLIC_DESTINATIONS:
        findings.append("destination_not_public")
    findings += _walk(value)
    findings += _root(value) if isinstance(value, Mapping) else ["artifact_root_invalid"]
    return PrivacyAudit(not findings, tuple(dict.fromkeys(findings)), len(findings))


# -- tables of artifacts, by expressions ---------------------------------------------------------

#: Stand for an escaped backslash and an escaped quote; JSON has no such characters as they are.
_BACKSLASH, _QUOTE = "\x01", "\x02"
_TOKEN = r'"[^"]*"|[{}\[\]:,]|[^\s{}\[\]:,"]+'
_BAD = "artifact_structure_invalid"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tokens(text: Column) -> Column:
    """A JSON text's strings, marks and literals in order. Without escaped quotes a string ends at
    the next quote, so one pattern finds all."""
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    return F.regexp_extract_all(plain, F.lit(_TOKEN), F.lit(0))


def _content(token: Column) -> Column:
    """What a string token says."""
    written = F.replace(F.replace(token, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
    return F.when(F.contains(written, F.lit("\\")), F.get(F.from_json(F.concat(F.lit("["), written, F.lit("]")), "array<string>"), F.lit(0))).otherwise(F.substr(token, F.lit(2), F.length(token) - 2))


def _some(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def _key_reason(key: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(F.lower(key), "[^a-z0-9]+", "_"), "^_|_$", "")
    out = F.lit(None).cast("string")
    for reason, keys in FORBIDDEN_KEYS.items():
        out = F.when(name.isin(*keys), F.lit(reason)).otherwise(out)
    return out


def _value_reasons(value: Column) -> list[Column]:
    secret, lower = F.lit(False), F.lower(value)
    for p in SECRET_PATTERNS.values():
        secret = secret | F.regexp_like(value, F.lit(p))
    weights = F.lit(False)
    for x in CHECKPOINT_SUFFIXES:
        weights = weights | F.endswith(lower, F.lit(x))
    return [F.when(F.regexp_like(value, F.lit(NOTE_PATTERN)), F.lit("note_text_forbidden")), F.when(secret, F.lit("secret_forbidden")), F.when(weights, F.lit("checkpoint_forbidden"))]


def _infinite(number: Column) -> Column:
    """Whether a literal is a number that floating point can't hold; whole numbers have no bound."""
    return ~F.regexp_like(number, F.lit("^-?[0-9]+$")) & F.coalesce(F.abs(number.try_cast("double")) == float("inf"), F.lit(False))


def walk_findings(tokens: Column) -> Column:
    """The reasons that keys and values give, in the order of the text, which is that of a walk depth
    first: a string before a colon is a key, any other a value, at whatever depth they stand."""

    def of(all_: Column) -> Column:
        def one(token: Column, i: Column) -> Column:
            is_key = F.get(all_, i + 1).eqNullSafe(F.lit(":"))
            named = _let(_content(token), lambda x: F.when(is_key, _some(_key_reason(x))).otherwise(_some(*_value_reasons(x))))
            literal = F.when(_infinite(token), F.array(F.lit("unsupported_artifact_value"))).otherwise(F.array().cast("array<string>"))
            return F.when(F.startswith(token, F.lit('"')), named).otherwise(literal)

        return F.flatten(F.transform(all_, one))

    return _let(tokens, of)


def _one_value(tokens: Column) -> Column:
    """Whether brackets close just at the last token, so that nothing follows the value."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("ends"))
    open_, shut = (lambda t: t.isin("{", "[")), (lambda t: t.isin("}", "]"))

    def step(x: Column, t: Column) -> Column:
        depth = x["depth"] + F.when(open_(t), 1).when(shut(t), -1).otherwise(0)
        return F.struct(depth.alias("depth"), (x["ends"] + (depth == 0).cast("int")).alias("ends"))

    return F.aggregate(tokens, start, step)["ends"] == 1


def _is(kind: str, value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == kind, F.lit(False))


def _is_number(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    finite = F.coalesce(F.abs(F.try_variant_get(value, "$", "double")) < float("inf"), F.lit(True))
    return F.coalesce(kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), F.lit(False)) & finite


def _is_scalar(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return ~(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))) & (~kind.isin("DOUBLE", "FLOAT") | _is_number(value))


def _fields(value: Column) -> Column:
    """An object's fields; null of anything else."""
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.try_variant_get(value, "$", "map<string,variant>"))


def root_findings(root: Column) -> Column:
    """What the contract of its type finds in an artifact's fields (a map of variants)."""

    def of(fields: Column) -> Column:
        value = lambda name: F.try_element_at(fields, F.lit(name))
        kind = F.when(_is("STRING", value("artifact_type")), F.try_variant_get(value("artifact_type"), "$", "string"))
        known = F.coalesce(kind.isin(*ARTIFACT_KEYS), F.lit(False))
        found = [F.when(~known, F.lit("artifact_type_not_allowed"))]
        for flag in REQUIRED_FALSE_FLAGS:
            x = value(flag)
            found.append(F.when(~_is("BOOLEAN", x), F.lit("artifact_flags_invalid")).when(F.try_variant_get(x, "$", "boolean"), F.lit(flag.removeprefix("contains_") + "_flag_forbidden")))
        own = F.array().cast("array<string>")
        for name, keys in ARTIFACT_KEYS.items():
            own = F.when(kind == name, F.lit(list(keys))).otherwise(own)
        bad = F.lit(_BAD)
        extra = F.array_except(F.map_keys(fields), F.concat(F.lit(["artifact_type", *REQUIRED_FALSE_FLAGS]), own))
        found.append(F.when(F.size(extra) > 0, bad))

        def metrics() -> Column:
            odd = lambda m: F.aggregate(F.map_entries(m), F.lit(0), lambda n, e: n + (~e["key"].isin(*METRIC_FIELDS)).cast("int") + (~_is_number(e["value"])).cast("int"))
            counted = _let(_fields(value("metrics")), lambda m: F.when(m.isNull(), F.array(bad)).otherwise(F.array_repeat(bad, odd(m))))
            return F.concat(counted, _some(F.when(value("limitations").isNotNull() & ~_is("STRING", value("limitations")), bad)))

        def documentation() -> Column:
            keys = ARTIFACT_KEYS["documentation"]
            none, odd = F.lit(True), F.lit(False)
            for k in keys:
                none, odd = none & value(k).isNull(), odd | (value(k).isNotNull() & ~_is("STRING", value(k)))
            return _some(F.when(none, bad), F.when(odd, bad))

        def provenance() -> Column:
            given = lambda m: F.when(m.isNull(), F.array(bad)).otherwise(_some(
                F.when(F.size(F.array_except(F.map_keys(m), F.lit(list(PROVENANCE_FIELDS)))) > 0, bad), F.when(F.exists(F.map_values(m), lambda x: ~_is_scalar(x)), bad),
            ))
            return _let(_fields(value("provenance")), given)

        none = F.array().cast("array<string>")
        by_kind = F.when(kind == "aggregate_metrics", metrics()).when(kind == "documentation", documentation()).when(kind == "non_sensitive_provenance", provenance()).otherwise(none)
        return F.concat(_some(*found), by_kind)

    return _let(root, of)


def artifact_audits(artifacts: DataFrame) -> DataFrame:
    """artifact_id, allowed, reasons and finding_count for rows of artifact_id, artifact (JSON
    text) and destination, as validate_public_artifact has them for the parsed value; in the JVM.

    A text that is no JSON value, names a key twice, holds NaN or Infinity, or is nested beyond what
    the JVM's parser takes (1,000 levels) is no artifact: it is refused with an unsupported value and
    an invalid root. Keys are compared in lower case, where Python folds some letters further."""
    text = F.col("artifact").cast("string")
    public = F.lower(stripped(F.col("destination"))).isin(*PUBLIC_DESTINATIONS)
    target = _some(F.when(~F.coalesce(public, F.lit(False)), F.lit("destination_not_public")))
    parsed = artifacts.select("artifact_id", target.alias("_target"), _tokens(text).alias("_tokens"), F.try_parse_json(text).alias("_value"))
    sound = F.col("_value").isNotNull() & _one_value(F.col("_tokens"))
    root = _let(_fields(F.col("_value")), lambda m: F.when(m.isNull(), F.array(F.lit("artifact_root_invalid"))).otherwise(root_findings(m)))
    found = F.when(F.coalesce(sound, F.lit(False)), F.concat(walk_findings(F.col("_tokens")), root)).otherwise(F.array(F.lit("unsupported_artifact_value"), F.lit("artifact_root_invalid")))
    # The findings are an array of their own before they are counted, so that they are found once.
    out = parsed.select("artifact_id", F.explode(F.array(F.concat("_target", found))).alias("_found"))
    return out.select("artifact_id", (F.size("_found") == 0).alias("allowed"), F.array_distinct("_found").alias("reasons"), F.size("_found").cast("long").alias("finding_count"))


def pattern_counts(text: Column) -> list[Column]:
    """How many texts match each secret pattern, as aggregates."""
    return [F.count_if(F.regexp_like(text, F.lit(p))).alias(name) for name, p in SECRET_PATTERNS.items()]


def forbidden_keys(json_text: Column) -> Column:
    """The reasons that a JSON object's top-level keys give, by expressions."""
    names = F.transform(F.json_object_keys(json_text), lambda k: F.regexp_replace(F.regexp_replace(F.lower(k), "[^a-z0-9]+", "_"), "^_|_$", ""))
    reasons = [F.when(F.exists(names, lambda k: k.isin(*keys)), F.lit(reason)) for reason, keys in FORBIDDEN_KEYS.items()]
    return F.array_compact(F.array(*reasons))


def write_public(df: DataFrame, path: str, artifact: Mapping, destination: str) -> PrivacyAudit:
    """Write df as Parquet only if the artifact that describes it passes the audit."""
    audit = validate_public_artifact(artifact, destination)
    if not audit.allowed:
        raise PermissionError(", ".join(audit.reasons))
    df.write.parquet(path)
    return audit
