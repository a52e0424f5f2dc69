"""From notes and code rows to labelled admissions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import DedupAudit, DedupPolicy, DedupResult, one_of, require
from ..functions.identifiers import is_canonical, is_native_code, require_id_type, stripped
from ..sources.staging import audited


def _require_columns(df: DataFrame, *names: str) -> None:
    missing = [x for x in names if x not in df.columns]
    require((not missing, f"records miss the required field {', '.join(map(repr, missing))}"))


def eligible_notes(records: DataFrame, policy: DedupPolicy) -> DataFrame:
    """The rows of the policy's category, with _subject and _hadm."""
    rows = records.where(F.col(policy.category_field) == F.lit(policy.category_value))
    return rows.withColumns({"_subject": stripped(F.col("SUBJECT_ID")), "_hadm": F.col("HADM_ID").cast("string")})


def winners(rows: DataFrame, policy: DedupPolicy) -> DataFrame:
    """Of each _hadm the rows with the winning keys; rank keeps ties, so ambiguity shows.
    The rank filter is applied before rows are exchanged as well as after."""
    keys = [F.col(x) for x in (policy.order_field, *policy.tie_break_fields)]
    order = [k.desc() if policy.keep == "latest" else k.asc() for k in keys]
    return rows.withColumn("_rank", F.rank().over(Window.partitionBy("_hadm").orderBy(*order))).where(F.col("_rank") == 1).drop("_rank")


def admission_counts(rows: DataFrame) -> DataFrame:
    """Rows and subjects of each _hadm, combined map-side."""
    return rows.groupBy("_hadm").agg(F.count("*").alias("n"), (~F.min("_subject").eqNullSafe(F.max("_subject"))).alias("conflict"))


def _checked_columns(records: DataFrame, policy: DedupPolicy) -> None:
    _require_columns(records, policy.category_field, policy.order_field, *policy.tie_break_fields, "TEXT", "SUBJECT_ID", "HADM_ID")
    require_id_type(records, "SUBJECT_ID")
    require_id_type(records, "HADM_ID")
    for name in policy.tie_break_fields:
        kind = records.schema[name].dataType
        require((not isinstance(kind, (T.BooleanType, T.ArrayType, T.MapType, T.StructType)), f"tie-break field {name!r}: type {kind.simpleString()} is not accepted"))


def _observed_winners(records: DataFrame, policy: DedupPolicy, seen: Observation) -> DataFrame:
    """The winners, and in `seen` all that the audit needs. One exchange by admission and one sort
    serve rank, tie, count and owners."""
    keys = F.struct(policy.order_field, *policy.tie_break_fields)
    order = [F.col(x).desc() if policy.keep == "latest" else F.col(x).asc() for x in (policy.order_field, *policy.tie_break_fields)]
    best = Window.partitionBy("_hadm").orderBy(*order)
    rows = eligible_notes(records, policy).select("_subject", "_hadm", F.col("TEXT").cast("string").alias("_text"), policy.category_field, policy.order_field, *policy.tie_break_fields)
    # An admission's rows stand one after the other, so neighbours tell of a tie, of more rows and of another owner.
    rows = rows.withColumns({
        "_place": F.row_number().over(best), "_next": F.lead(keys).over(best), "_more": F.lead(F.lit(1)).over(best), "_before": F.lag(F.struct("_subject")).over(best),
    })
    floats = [x for x in policy.tie_break_fields if isinstance(records.schema[x].dataType, (T.FloatType, T.DoubleType))]
    bad = {"SUBJECT_ID": ~is_canonical(F.col("_subject")), "HADM_ID": ~is_canonical(F.col("_hadm"))} | {x: F.isnan(x) | (F.abs(x) == float("inf")) for x in floats}
    first = F.col("_place") == 1
    marks = {
        "admissions": first, "repeated": first & F.col("_more").isNotNull(), "tied": first & F.col("_next").eqNullSafe(keys) & F.col("_more").isNotNull(),
        "conflicts": ~first & ~F.col("_before._subject").eqNullSafe(F.col("_subject")),
    } | {f"bad:{k}": F.coalesce(v, F.lit(False)) for k, v in bad.items()}
    # Marks are set by generated code; what is observed only adds them up.
    rows = rows.withColumns({f"_mark_{i}": v.cast("int") for i, v in enumerate(marks.values())})
    rows = rows.observe(seen, F.count(F.lit(1)).alias("eligible"), *(F.coalesce(F.sum(f"_mark_{i}"), F.lit(0)).alias(k) for i, k in enumerate(marks)))
    return rows.where(first).select(
        F.col("_subject").alias("subject_id"), F.col("_hadm").alias("hadm_id"), F.col("_text").alias("text"), F.col(policy.category_field).cast("string").alias("category"),
        F.col(policy.order_field).alias("order_value"), (F.struct(*policy.tie_break_fields) if policy.tie_break_fields else F.struct()).alias("tie_break_values"),
    )


def _accepted_winners(got: dict, total: int) -> DedupAudit:
    require(
        (total > 0, "records must not be empty"), *((n == 0, f"{k[4:]}: {n} records have no canonical value") for k, n in got.items() if k.startswith("bad:")),
        (got["conflicts"] == 0, f"ownership conflict: {got['conflicts']} records name another subject than their admission's record before"),
        (got["tied"] == 0, f"ambiguous tie: {got['tied']} admissions have several rows with the winning order and tie-break values"),
        (got["admissions"] > 0, "records: empty"),
    )
    return DedupAudit(total, got["eligible"], got["admissions"], got["eligible"] - got["admissions"], got["repeated"])


def deduplicate_admissions(records: DataFrame, policy: DedupPolicy, ordered: bool = False, path: str | None = None) -> DedupResult:
    """One note for each admission: the latest or earliest by the policy's keys.

    Raises ValueError on an empty input, a missing field, an identifier that is not canonical
    (SUBJECT_ID may be padded, HADM_ID may not), an admission of several subjects, or a tie
    at the winning keys. Rows of other categories are not checked. Null keys sort as Spark
    sorts them, first in ascending order. The winners are written by one job that observes what is
    checked, at path if one is given; where a check fails nothing stays written."""
    _checked_columns(records, policy)
    seen, audit = Observation(), []
    out = _observed_winners(records, policy, seen)
    total = records.count()
    kept = audited(out, [seen], lambda got: audit.append(_accepted_winners(got, total)), path)
    return DedupResult(kept.orderBy("hadm_id") if ordered else kept, audit[0], checked=True)


def _notes(notes: DataFrame) -> DataFrame:
    if "hadm_id" in notes.columns:
        return notes.select("subject_id", "hadm_id", "text")
    _require_columns(notes, "HADM_ID")
    has = lambda name: stripped(F.col(name)) if name in notes.columns else F.lit("")
    return notes.select(has("SUBJECT_ID").alias("subject_id"), stripped(F.col("HADM_ID")).alias("hadm_id"), (F.col("TEXT").cast("string") if "TEXT" in notes.columns else F.lit("")).alias("text"))


def _codes(diagnoses: DataFrame) -> DataFrame:
    _require_columns(diagnoses, "HADM_ID", "ICD9_CODE")
    own = [stripped(F.col("SUBJECT_ID")).alias("owner")] if "SUBJECT_ID" in diagnoses.columns else []
    return diagnoses.select(stripped(F.col("HADM_ID")).alias("hadm_id"), stripped(F.col("ICD9_CODE")).alias("code"), *own)


def admission_labels(diagnoses: DataFrame) -> DataFrame:
    """hadm_id and its sorted distinct valid codes; invalid codes are left out silently."""
    valid = _codes(diagnoses).where(is_native_code(F.col("code")))
    return valid.groupBy("hadm_id").agg(F.array_sort(F.collect_set("code")).alias("labels"))


def ownership_conflicts(notes: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Code rows whose subject is not that of their admission's note."""
    owners = _notes(notes).select("hadm_id", "subject_id")
    return _codes(diagnoses).join(owners, "hadm_id").where(~F.col("owner").eqNullSafe(F.col("subject_id")))


UNLABELLED = ("refuse", "drop")


def _observed_examples(left: DataFrame, diagnoses: DataFrame, unlabelled: str, seen: Observation) -> DataFrame:
    """Notes (subject_id, hadm_id, text, _times) with their labels, and in `seen` what is checked.
    Codes are grouped once, for labels, owners and counts alike."""
    codes = _codes(diagnoses)
    known = "owner" in codes.columns
    owner = F.col("owner") if known else F.lit(None).cast("string")
    grouped = codes.groupBy("hadm_id").agg(
        F.min(owner).alias("_a"), F.max(owner).alias("_z"), F.count_if(owner.isNull()).alias("_none"), F.array_sort(F.collect_set(F.when(is_native_code(F.col("code")), F.col("code")))).alias("labels"),
    )
    both = left.join(grouped, "hadm_id", "left")
    subject, hadm = F.col("subject_id"), F.col("hadm_id")
    wrong = F.lit(known) & F.col("labels").isNotNull() & (~F.col("_a").eqNullSafe(subject) | ~F.col("_z").eqNullSafe(subject) | ((F.col("_none") > 0) & subject.isNotNull()))
    bare = F.coalesce(F.size("labels"), F.lit(0)) < 1
    marks = {"many": F.col("_times") > 1, "bare": bare, "odd_subject": ~is_canonical(subject), "odd_hadm": ~is_canonical(hadm)}
    both = both.withColumns({f"_mark_{i}": v.cast("int") for i, v in enumerate(marks.values())} | {"_clash": F.when(wrong, hadm), "_without": F.when(bare, hadm)})
    both = both.observe(
        seen, F.count(F.lit(1)).alias("notes"), F.min("_clash").alias("clash"), F.min("_without").alias("without"), *(F.coalesce(F.sum(f"_mark_{i}"), F.lit(0)).alias(k) for i, k in enumerate(marks)),
    )
    rows = both.where("_without IS NULL") if unlabelled == "drop" else both
    return rows.select("subject_id", "hadm_id", "text", "labels", F.lit(None).cast("string").alias("partition"))


def _accepted_examples(got: dict, diagnoses: DataFrame, unlabelled: str) -> None:
    refused = unlabelled == "refuse" and got["bare"] > 0
    require((got["notes"] > 0, "notes must not be empty"), (not refused or not diagnoses.isEmpty(), "diagnosis list must not be empty"))
    require(
        (got["many"] == 0, "duplicate admission found in notes: deduplicate them first"),
        (got.get("clash") is None, f"ownership conflict: a diagnosis of admission {got.get('clash')!r} names another subject"),
        (not refused, f"no diagnosis rows with a valid code for admission {got.get('without')!r}"),
        (got["odd_subject"] == 0, "subject_id: must be non-empty with no surrounding whitespace"), (got["odd_hadm"] == 0, "hadm_id: must be non-empty with no surrounding whitespace"),
    )


def build_admission_examples(notes: DataFrame, diagnoses: DataFrame, ordered: bool = False, unlabelled: str = "refuse", path: str | None = None) -> DataFrame:
    """subject_id, hadm_id, text, labels and a null partition for each note.

    notes are raw (SUBJECT_ID, HADM_ID, TEXT) or what deduplicate_admissions returns. Raises
    ValueError on empty inputs, a repeated admission, a code row of another subject, or, unless
    unlabelled is "drop", a note without a valid code. Codes of unknown admissions are ignored. The
    examples are written by one job that observes what is checked, at path if one is given."""
    require(one_of(unlabelled, UNLABELLED, "unlabelled"))
    seen = Observation()
    left = _notes(notes).withColumn("_times", F.count("*").over(Window.partitionBy("hadm_id")))
    out = audited(_observed_examples(left, diagnoses, unlabelled, seen), [seen], lambda got: _accepted_examples(got, diagnoses, unlabelled), path)
    return out.orderBy("hadm_id") if ordered else out


@dataclass(frozen=True)
class PreparedExamples:
    """Labelled admissions straight from notes and codes; unlabelled_count of the winners had no
    valid code and were dropped."""

    examples: DataFrame
    audit: DedupAudit
    unlabelled_count: int


def prepare_examples(records: DataFrame, policy: DedupPolicy, diagnoses: DataFrame, unlabelled: str = "refuse", path: str | None = None) -> PreparedExamples:
    """deduplicate_admissions and build_admission_examples as one job, with all checks of both: notes
    are exchanged by admission once, for winners, label join and ownership; so are codes."""
    _checked_columns(records, policy)
    require(one_of(unlabelled, UNLABELLED, "unlabelled"))
    winners_seen, examples_seen, audit = Observation(), Observation(), []
    left = _observed_winners(records, policy, winners_seen).select("subject_id", "hadm_id", "text", F.lit(1).alias("_times"))
    total = records.count()

    def accept(got: dict) -> None:
        audit.extend((_accepted_winners(got, total), got["bare"]))
        _accepted_examples(got, diagnoses, unlabelled)

    out = audited(_observed_examples(left, diagnoses, unlabelled, examples_seen), [winners_seen, examples_seen], accept, path)
    return PreparedExamples(out, *audit)


# -- notes without column types -------------------------------------------------------------------

_KINDS = {"BIGINT": "int", "DOUBLE": "float", "FLOAT": "float", "STRING": "str", "BOOLEAN": "bool", "VOID": "null"}


def value_kind(value: Column) -> Column:
    """int, float, str, bool, null, list or dict: what a variant's value is, whatever its width."""
    schema = F.schema_of_variant(value)
    out = F.when(F.startswith(schema, F.lit("OBJECT")), "dict").when(F.startswith(schema, F.lit("ARRAY")), "list").when(F.startswith(schema, F.lit("DECIMAL")), F.when(F.endswith(schema, F.lit(",0)")), "int").otherwise("float"))
    for name, kind in _KINDS.items():
        out = out.when(schema == name, kind)
    return out


def type_conflicts(records: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """key, field, kinds and schema of each group whose variant field holds values of several kinds.
    Kinds are seven, so what is collected a group is bounded; schemas merge map-side."""
    aggregates = [x for f in fields for x in (F.array_sort(F.collect_set(value_kind(F.col(f)))).alias(f"_kinds_{f}"), F.schema_of_variant_agg(f).alias(f"_schema_{f}"))]
    each = records.groupBy(key).agg(*aggregates)
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_kinds_{f}").alias("kinds"), F.col(f"_schema_{f}").alias("schema")) for f in fields))
    return each.select(key, F.explode(rows).alias("x")).select(key, "x.*").where(F.size("kinds") > 1)


def notes_from_variants(records: DataFrame, value: str, policy: DedupPolicy) -> tuple[DataFrame, DedupPolicy]:
    """Notes of the policy's category from a column of variant objects, and the policy to deduplicate
    them by. Raises ValueError where a field is missing, or where an admission's order or tie-break
    values are of several kinds; admissions may differ. Each such field becomes two columns, _number
    and _text, one of them null, which order as the values do within a kind."""
    keys = (policy.order_field, *policy.tie_break_fields)
    needed = ("SUBJECT_ID", "HADM_ID", "TEXT", *keys)
    at = lambda name, kind: F.try_variant_get(value, f"$['{name}']", kind)
    chosen = records.where(at(policy.category_field, "string") == F.lit(policy.category_value)).select(*(at(x, "variant").alias(x) for x in needed))
    hadm = F.try_variant_get("HADM_ID", "$", "string").alias("HADM_ID")
    missing = chosen.agg(*(F.count_if(F.col(x).isNull()).alias(x) for x in needed)).first()
    require(*((missing[x] == 0, f"records miss the required field {x!r}") for x in needed))
    mixed = type_conflicts(chosen.select(hadm, *keys), "HADM_ID", keys).limit(1).collect()
    require((not mixed, f"type inconsistency for field {mixed[0].field!r}: {', '.join(mixed[0].kinds)} in admission {mixed[0].HADM_ID!r}" if mixed else ""))
    text = lambda x: F.try_variant_get(x, "$", "string")
    number = lambda x: F.coalesce(F.try_variant_get(x, "$", "decimal(38,10)"), F.try_variant_get(x, "$", "boolean").cast("int").cast("decimal(38,10)"))
    columns = [c for x in keys for c in (F.when(value_kind(F.col(x)) != "str", number(x)).alias(f"{x}_number"), F.when(value_kind(F.col(x)) == "str", text(x)).alias(f"{x}_text"))]
    rows = chosen.select(text("SUBJECT_ID").alias("SUBJECT_ID"), hadm, text("TEXT").alias("TEXT"), F.lit(policy.category_value).alias(policy.category_field), *columns)
    names = [f"{x}_{part}" for x in keys for part in ("number", "text")]
    return rows, DedupPolicy(policy.category_field, policy.category_value, names[0], policy.keep, tuple(names[1:]))
