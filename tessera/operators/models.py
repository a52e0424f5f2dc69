"""Audits of the five-system registry and of which parameters train.

Parameters are a table (name, trainable, count); one aggregate gives all sums and flags, with the
few names that a report lists. Rules over it then name reasons in a fixed order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import stripped

# Each system's family and adaptation.
SYSTEMS = {
    "rule": ("rule", "rule"),
    "domain_lora": ("domain", "lora"),
    "domain_full": ("domain", "full"),
    "general_lora": ("general", "lora"),
    "general_full": ("general", "full"),
}
PINNED = re.compile(r"commit:[0-9a-f]{40,64}|sha256:[0-9a-f]{64}")
ADAPTER_MARK = ".lora_"


@dataclass(frozen=True)
class ModelSpec:
    logical_system: str
    family: str
    adaptation: str
    model_reference: str | None
    model_revision: str | None
    tokenizer_reference: str | None
    tokenizer_revision: str | None
    label_contract_digest: str
    output_contract: str

    def as_mapping(self) -> dict[str, object]:
        return asdict(self)

    @property
    def revisions(self) -> tuple:
        return self.model_reference, self.model_revision, self.tokenizer_reference, self.tokenizer_revision


@dataclass(frozen=True)
class RegistryAudit:
    allowed: bool
    reasons: tuple[str, ...]
    system_count: int
    logical_systems: tuple[str, ...]


def _filled(x: object) -> bool:
    return isinstance(x, str) and bool(x.strip())


def _pinned(x: object) -> bool:
    return _filled(x) and bool(PINNED.fullmatch(x.strip().casefold()))


def _spec_reasons(s: ModelSpec) -> Iterable[str]:
    if SYSTEMS.get(s.logical_system) != (s.family, s.adaptation):
        yield "logical_system_definition_invalid"
    if s.logical_system == "rule" and (s.tokenizer_reference, s.tokenizer_revision) != (None, None):
        yield "rule_tokenizer_forbidden"
    if s.logical_system in SYSTEMS and s.logical_system != "rule":
        if not (_filled(s.tokenizer_reference) and _pinned(s.model_revision) and _pinned(s.tokenizer_revision)):
            yield "neural_revision_not_immutable"


def validate_five_system_registry(specs: Iterable[ModelSpec]) -> RegistryAudit:
    """The registry holds just the five systems, pinned, with shared contracts and, within a
    family, the same revisions."""
    try:
        items, reasons = tuple(specs), []
    except TypeError:
        items, reasons = (), ["registry_invalid"]
    needed = [k for k in ModelSpec.__dataclass_fields__ if not k.startswith("tokenizer_")]
    valid = [s for s in items if isinstance(s, ModelSpec) and all(_filled(getattr(s, k)) for k in needed)]
    names = [s.logical_system for s in valid]
    by_name = dict(zip(names, valid))
    reasons += ["registry_invalid"] * (len(valid) < len(items))
    reasons += ["duplicate_logical_system"] * (len(by_name) < len(names))
    reasons += ["exact_system_set_required"] * (set(by_name) != set(SYSTEMS))
    for s in valid:
        reasons += _spec_reasons(s)
    reasons += ["label_contract_mismatch"] * (len({s.label_contract_digest for s in valid}) > 1)
    reasons += ["output_contract_mismatch"] * (len({s.output_contract for s in valid}) > 1)
    neural = [s for k, s in by_name.items() if k in SYSTEMS and k != "rule"]
    for a, b in combinations(neural, 2):
        if SYSTEMS[a.logical_system][0] == SYSTEMS[b.logical_system][0] and a.revisions != b.revisions:
            reasons.append("family_revision_mismatch")
    unique = tuple(dict.fromkeys(reasons))
    return RegistryAudit(not unique, unique, len(items), tuple(sorted(names)))


def registry_audits(specs: DataFrame) -> DataFrame:
    """validate_five_system_registry for each registry_id of a table of specs, by one combined
    aggregate: registry_id, allowed, reasons (in a fixed order) and system_count. Where a system is
    there twice, all its revisions count in its family."""
    text = lambda c: F.length(stripped(F.col(c))) > 0
    system, fields = F.col("logical_system"), list(ModelSpec.__dataclass_fields__)
    valid = F.lit(True)
    for name in fields:
        if not name.startswith("tokenizer_"):
            valid = valid & F.coalesce(text(name), F.lit(False))
    pinned = lambda c: F.coalesce(F.regexp_like(F.lower(stripped(F.col(c))), F.lit(rf"^(?:{PINNED.pattern})\z")), F.lit(False))
    defined, neural = F.lit(False), system.isin(*(x for x in SYSTEMS if x != "rule"))
    for name, (family, kind) in SYSTEMS.items():
        defined = defined | ((system == name) & (F.col("family") == family) & (F.col("adaptation") == kind))
    ready = F.coalesce(text("tokenizer_reference"), F.lit(False)) & pinned("model_revision") & pinned("tokenizer_revision")
    revisions = F.struct("model_reference", "model_revision", "tokenizer_reference", "tokenizer_revision")
    families = sorted({f for f, _ in SYSTEMS.values() if f != "rule"})
    of = lambda f: F.when(valid & system.isin(*(k for k, x in SYSTEMS.items() if x[0] == f)), revisions)
    apart = lambda name, x: [F.min(x).alias(f"{name}_a"), F.max(x).alias(f"{name}_z")]
    got = specs.groupBy("registry_id").agg(
        F.count("*").alias("n"), F.count_if(valid).alias("valid"), F.count_distinct(F.when(valid, system)).alias("names"), F.count_distinct(F.when(valid & system.isin(*SYSTEMS), system)).alias("known"),
        F.count_if(valid & ~defined).alias("odd"), F.count_if(valid & (system == "rule") & (F.col("tokenizer_reference").isNotNull() | F.col("tokenizer_revision").isNotNull())).alias("ruled"),
        F.count_if(valid & neural & ~ready).alias("loose"), *apart("label", F.when(valid, F.col("label_contract_digest"))), *apart("output", F.when(valid, F.col("output_contract"))),
        *(c for f in families for c in apart(f, of(f))),
    )
    differ = lambda name: ~F.col(f"{name}_a").eqNullSafe(F.col(f"{name}_z"))
    mixed = F.lit(False)
    for f in families:
        mixed = mixed | differ(f)
    rules = [
        (F.col("valid") < F.col("n"), "registry_invalid"), (F.col("names") < F.col("valid"), "duplicate_logical_system"),
        ((F.col("known") < len(SYSTEMS)) | (F.col("names") > F.col("known")), "exact_system_set_required"), (F.col("odd") > 0, "logical_system_definition_invalid"),
        (F.col("ruled") > 0, "rule_tokenizer_forbidden"), (F.col("loose") > 0, "neural_revision_not_immutable"), (differ("label"), "label_contract_mismatch"), (differ("output"), "output_contract_mismatch"), (mixed, "family_revision_mismatch"),
    ]
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(reason)) for c, reason in rules)))
    return got.select("registry_id", reasons.alias("reasons"), F.col("n").alias("system_count")).withColumn("allowed", F.size("reasons") == 0)




@dataclass(frozen=True)
class TrainabilityAudit:
    allowed: bool
    reasons: tuple[str, ...]
    total_parameter_count: int
    trainable_parameter_count: int
    adapter_parameter_count: int
    classifier_parameter_count: int
    matched_target_modules: tuple[str, ...]
    unexpected_trainable_parameters: tuple[str, ...]


def _under(name: Column, path: str) -> Column:
    return (name == path) | F.startswith(name, F.lit(path + "."))


def _is_module(module: Column, suffixes: Iterable[str]) -> Column:
    found = F.lit(False)
    for s in suffixes:
        found = found | (module == s) | F.endswith(module, F.lit("." + s))
    return found


def _parameters(parameters: DataFrame) -> DataFrame:
    valid = F.coalesce((F.length(stripped(F.col("name"))) > 0) & F.col("trainable").isNotNull() & (F.col("count") > 0), F.lit(False))
    return parameters.select("name", "trainable", "count", valid.alias("valid"))


def _records_valid(p: DataFrame) -> bool:
    n, good, names = p.agg(F.count("*"), F.count_if("valid"), F.count_distinct(F.when(F.col("valid"), F.col("name")))).first()
    return n > 0 and n == good == names


def _sum(when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, F.col("count"))), F.lit(0))


def _path(classifier_path: object) -> str:
    return classifier_path.strip() if isinstance(classifier_path, str) else ""


def _head(path: str) -> Column:
    return _under(F.col("name"), path) if path else F.lit(False)


def _head_reason(members: int, frozen: int) -> list[str]:
    return ["classifier_missing"] if not members else ["classifier_not_fully_trainable"] if frozen else []


def audit_lora_trainability(parameters: DataFrame, target_suffixes: Iterable[str], classifier_path: str) -> TrainabilityAudit:
    """Adapters on all targets and nowhere else train, the classifier trains, the rest is frozen.
    Of parameters that train and should not, all are named, so the audit is as long as these are."""
    raw = list(target_suffixes) if isinstance(target_suffixes, Iterable) and not isinstance(target_suffixes, str) else list(target_suffixes or "")
    suffixes = [x.strip() for x in raw if _filled(x)]
    path = _path(classifier_path)
    p = _parameters(parameters)
    name, on = F.col("name"), F.col("trainable")
    module = F.when(F.contains(name, F.lit(ADAPTER_MARK)), F.substring_index(name, ADAPTER_MARK, 1))
    adapter, head = module.isNotNull(), _head(path)
    target = F.coalesce(_is_module(module, suffixes), F.lit(False))
    g = p.where("valid").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("total"), _sum(on).alias("on"), _sum(on & adapter).alias("adapters"), _sum(on & head).alias("head"),
        F.count_if(on & adapter).alias("n_adapters"), F.count_if(~on & adapter & target).alias("frozen_targets"), F.count_if(on & adapter & ~target).alias("elsewhere"),
        F.count_if(head).alias("members"), F.count_if(head & ~on).alias("frozen_head"),
        F.array_sort(F.collect_set(F.when(on & adapter & target, module))).alias("matched"),
        F.count_if(on & ~adapter & ~head).alias("unexpected"),
    ).first()
    named = p.where(F.col("valid") & on & ~adapter & ~head).select("name").orderBy("name").collect() if g["unexpected"] else []
    missed = any(not any(m == s or m.endswith("." + s) for m in g["matched"]) for s in suffixes)
    config = bool(suffixes) and len(set(suffixes)) == len(raw) and bool(path)
    reasons = [
        *(["parameter_records_invalid"] if not _records_valid(p) else []),
        *(["trainability_config_invalid"] if not config else []),
        *(["target_adapters_missing"] if not g["n_adapters"] else []),
        *(["adapter_not_fully_trainable"] if g["frozen_targets"] else []),
        *(["target_suffix_unmatched"] if missed else []),
        *(["unexpected_adapter_target"] if g["elsewhere"] else []),
        *_head_reason(g["members"], g["frozen_head"]),
        *(["unexpected_trainable_base"] if g["unexpected"] else []),
        *(["lora_scope_not_bounded"] if g["n"] and g["on"] >= g["total"] else []),
    ]
    return TrainabilityAudit(not reasons, tuple(reasons), g["total"], g["on"], g["adapters"], g["head"], tuple(g["matched"]), tuple(r[0] for r in named))


def audit_full_trainability(parameters: DataFrame, classifier_path: str) -> TrainabilityAudit:
    """Everything trains, the classifier included."""
    path, p, on = _path(classifier_path), _parameters(parameters), F.col("trainable")
    head = _head(path)
    total, trained, own, members, frozen_head, frozen = p.where("valid").agg(
        F.coalesce(F.sum("count"), F.lit(0)), _sum(on), _sum(on & head), F.count_if(head), F.count_if(head & ~on), F.count_if(~on),
    ).first()
    reasons = [
        *(["parameter_records_invalid"] if not _records_valid(p) else []),
        *(["trainability_config_invalid"] if not path else []),
        *_head_reason(members, frozen_head),
        *(["full_parameters_not_trainable"] if frozen else []),
    ]
    return TrainabilityAudit(not reasons, tuple(reasons), total, trained, 0, own, (), ())
