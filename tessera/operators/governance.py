"""Rights manifests, data-access and training gates: ordered rules, each with a reason.

Gates deny unless no rule objects, and list the reasons of all that do, in a fixed order. The
same rules judge one request on the driver or a table of requests as expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import require
from ..functions.identifiers import stripped

# Fixed values
RIGHTS_STATUSES = ("approved", "pending", "denied", "revoked", "expired")
RUNTIME_FLAGS = ("network_enabled", "external_logging", "raw_transfer_requested", "synthetic_only", "gpu_job", "restricted_runtime_authorized")
FIXTURE_LOCATION = "synthetic-secure-local"


@dataclass(frozen=True)
class GateDecision:
    allowed: bool
    reasons: tuple[str, ...]


def decision(*rules: tuple[object, str]) -> GateDecision:
    """Denied for the reason of each (objects, reason) that objects."""
    reasons = tuple(reason for objects, reason in rules if objects)
    return GateDecision(not reasons, reasons)


def _text(value: object) -> str:
    require((isinstance(value, str) and bool(value.strip()), "required_string_invalid"))
    return value.strip()


def _date(value: object) -> date:
    try:
        return date.fromisoformat(value)
    except (TypeError, ValueError):
        raise ValueError("rights_expiry_invalid") from None


def _places(value: object, needed: bool) -> frozenset[str]:
    require((isinstance(value, Sequence) and not isinstance(value, (str, bytes)), "locations_must_be_sequence"))
    names = [_text(x).casefold() for x in value]
    require((len(set(names)) == len(names), "duplicate_locations"), (bool(names) or not needed, "approved_locations_empty"))
    return frozenset(names)


def _plain_places(value: object, needed: bool) -> None:
    require(
        (type(value) is frozenset, "locations_must_be_frozenset"),
        (bool(value) or not needed, "approved_locations_empty"),
        (all(type(x) is str and x and x == x.strip().casefold() for x in value), "location_value_invalid"),
    )


@dataclass(frozen=True)
class RightsEnvironmentManifest:
    schema_version: int
    fixture_only: bool
    dataset_reference: str
    source_revision: str
    data_use_terms_reference: str
    rights_status: str
    rights_expires_on: date
    decision_reference: str
    approved_locations: frozenset[str]
    kaggle_allowed: bool
    raw_transfer_allowed_locations: frozenset[str]
    retention_policy_reference: str
    artifact_policy_reference: str

    def _scalars(self) -> None:
        require(
            (type(self.schema_version) is int and self.schema_version == 1, "unsupported_schema_version"),
            (type(self.fixture_only) is bool, "fixture_only_must_be_boolean"),
            (type(self.rights_status) is str and self.rights_status in RIGHTS_STATUSES, "invalid_rights_status"),
        )

    def __post_init__(self) -> None:
        self._scalars()
        texts = [getattr(self, f.name) for f in fields(self) if f.name.endswith(("_reference", "_revision"))]
        require(
            (type(self.rights_expires_on) is date, "rights_expiry_date_invalid"),
            (type(self.kaggle_allowed) is bool, "kaggle_allowed_must_be_boolean"),
            (all(type(x) is str and x and x == x.strip() for x in texts), "required_string_invalid"),
        )
        _plain_places(self.approved_locations, True)
        _plain_places(self.raw_transfer_allowed_locations, False)
        require((self.raw_transfer_allowed_locations <= self.approved_locations, "raw_transfer_location_not_approved"))

    @classmethod
    def from_mapping(cls, value: Mapping[str, object]) -> RightsEnvironmentManifest:
        require((isinstance(value, Mapping), "manifest_must_be_mapping"))
        names = {f.name for f in fields(cls)}
        require((names <= set(value), "missing_required_fields"), (set(value) <= names, "unexpected_manifest_fields"))
        read = dict(value)
        read["rights_status"] = _text(value["rights_status"])
        read["rights_expires_on"] = _date(value["rights_expires_on"])
        read["approved_locations"] = _places(value["approved_locations"], True)
        read["raw_transfer_allowed_locations"] = _places(value["raw_transfer_allowed_locations"], False)
        require(
            (type(read["schema_version"]) is int and read["schema_version"] == 1, "unsupported_schema_version"),
            (type(read["fixture_only"]) is bool, "fixture_only_must_be_boolean"),
            (read["rights_status"] in RIGHTS_STATUSES, "invalid_rights_status"),
            (type(read["kaggle_allowed"]) is bool, "kaggle_allowed_must_be_boolean"),
            (read["raw_transfer_allowed_locations"] <= read["approved_locations"], "raw_transfer_location_not_approved"),
        )
        return cls(**{k: _text(v) if k.endswith(("_reference", "_revision")) else v for k, v in read.items()})


def evaluate_data_access(manifest: RightsEnvironmentManifest, requested_location: str, raw_transfer_requested: bool = False, *, as_of_date: date) -> GateDecision:
    """Rights end at the start of the day they expire on."""
    if type(manifest) is not RightsEnvironmentManifest:
        return decision((True, "manifest_invalid"))
    m = manifest
    place = requested_location.strip().casefold() if isinstance(requested_location, str) else ""
    day = type(as_of_date) is date
    asked = type(raw_transfer_requested) is bool
    return decision(
        (m.fixture_only, "fixture_data_access_forbidden"),
        (m.rights_status != "approved", "rights_not_approved"),
        (not day, "as_of_date_invalid"),
        (day and m.rights_expires_on <= as_of_date, "rights_expired"),
        (not place, "requested_location_invalid"),
        (place and place not in m.approved_locations, "location_not_approved"),
        ((place == "kaggle" or place.startswith("kaggle:")) and not m.kaggle_allowed, "kaggle_not_allowed"),
        (not asked, "raw_transfer_request_invalid"),
        (asked and raw_transfer_requested and place and place not in m.raw_transfer_allowed_locations, "raw_transfer_not_allowed"),
    )


def authorize_training(manifest: object, runtime: object, *, as_of_date: date) -> GateDecision:
    """Only an approved, offline, synthetic run at the fixture location, without logging outside."""
    if not isinstance(manifest, RightsEnvironmentManifest):
        return decision((True, "manifest_invalid"))
    known = isinstance(runtime, Mapping) and set(runtime) == {"location", *RUNTIME_FLAGS}
    if not known or not isinstance(runtime["location"], str) or any(type(runtime[x]) is not bool for x in RUNTIME_FLAGS):
        return decision((True, "runtime_invalid"))
    access = evaluate_data_access(manifest, runtime["location"], as_of_date=as_of_date)
    return decision(
        *((True, x) for x in access.reasons if x != "fixture_data_access_forbidden"),
        (not manifest.fixture_only, "live_manifest_training_forbidden"),
        (runtime["location"].strip().casefold() != FIXTURE_LOCATION, "fixture_location_forbidden"),
        (runtime["network_enabled"], "network_must_be_disabled"),
        (runtime["external_logging"], "external_logging_forbidden"),
        (runtime["raw_transfer_requested"], "training_raw_transfer_forbidden"),
        (not runtime["synthetic_only"], "synthetic_only_required"),
        (runtime["gpu_job"], "gpu_job_forbidden"),
        (runtime["restricted_runtime_authorized"], "restricted_runtime_forbidden"),
    )


def _access_rules(raw: Column) -> list[tuple[Column, str]]:
    """evaluate_data_access as expressions over a request's columns; raw: whether raw data is asked for."""
    place = F.lower(stripped(F.coalesce("requested_location", F.lit(""))))
    given = place != ""
    return [
        (F.col("fixture_only"), "fixture_data_access_forbidden"),
        (~F.col("rights_status").eqNullSafe("approved"), "rights_not_approved"),
        (F.col("as_of_date").isNull(), "as_of_date_invalid"),
        (F.col("rights_expires_on") <= F.col("as_of_date"), "rights_expired"),
        (~given, "requested_location_invalid"),
        (given & ~F.array_contains("approved_locations", place), "location_not_approved"),
        (((place == "kaggle") | place.startswith("kaggle:")) & ~F.col("kaggle_allowed"), "kaggle_not_allowed"),
        (raw.isNull(), "raw_transfer_request_invalid"),
        (raw & given & ~F.array_contains("raw_transfer_allowed_locations", place), "raw_transfer_not_allowed"),
    ]


def _reasons(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(objects, F.lit(reason)) for objects, reason in rules)))


def data_access_decisions(requests: DataFrame) -> DataFrame:
    """requests with allowed and reasons. A request has fixture_only, rights_status,
    rights_expires_on (date), approved_locations and raw_transfer_allowed_locations (arrays of
    lower-case names), kaggle_allowed, requested_location, raw_transfer_requested, as_of_date."""
    return requests.withColumn("reasons", _reasons(_access_rules(F.col("raw_transfer_requested")))).withColumn("allowed", F.size("reasons") == 0)


def training_decisions(requests: DataFrame) -> DataFrame:
    """authorize_training for each row: a request as above whose runtime is requested_location and
    the booleans RUNTIME_FLAGS; a null among these makes the runtime invalid."""
    place = F.lower(stripped(F.col("requested_location")))
    rules = [x for x in _access_rules(F.lit(False)) if x[1] != "fixture_data_access_forbidden"] + [
        (~F.coalesce("fixture_only", F.lit(False)), "live_manifest_training_forbidden"),
        (place != FIXTURE_LOCATION, "fixture_location_forbidden"),
        (F.col("network_enabled"), "network_must_be_disabled"),
        (F.col("external_logging"), "external_logging_forbidden"),
        (F.col("raw_transfer_requested"), "training_raw_transfer_forbidden"),
        (~F.col("synthetic_only"), "synthetic_only_required"),
        (F.col("gpu_job"), "gpu_job_forbidden"),
        (F.col("restricted_runtime_authorized"), "restricted_runtime_forbidden"),
    ]
    whole = F.lit(True)
    for name in ("requested_location", *RUNTIME_FLAGS):
        whole = whole & F.col(name).isNotNull()
    reasons = F.when(whole, _reasons(rules)).otherwise(F.array(F.lit("runtime_invalid")))
    return requests.withColumn("reasons", reasons).withColumn("allowed", F.size("reasons") == 0)
