"""Registered queries of the rule operators, over cases that are made from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import native_code
from ..operators import governance, models, privacy, provenance
from ..sources.tables import read_table
from .registry import _VALID, query

# -- codes --------------------------------------------------------------------------------------


@query("parse_codes", rf"""WITH given AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' 4' || p_size WHEN 1 THEN 'V1' || p_size || '.1' || chr(9) WHEN 2 THEN 'E8' || p_size WHEN 3 THEN p_brand ELSE '25.' || p_size END AS raw FROM part),
parsed AS (SELECT p_partkey, raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS code FROM given)
SELECT p_partkey, raw, CASE WHEN {_VALID} THEN code END AS code FROM parsed""")
def parse_codes(spark: SparkSession, folder: str) -> DataFrame:
    key, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    raw = (
        F.when(key == 0, F.concat(F.lit(" 4"), size)).when(key == 1, F.concat(F.lit("V1"), size, F.lit(".1\t"))).when(key == 2, F.concat(F.lit("E8"), size))
        .when(key == 3, F.col("p_brand")).otherwise(F.concat(F.lit("25."), size))
    )
    return read_table(spark, folder, "part").select("p_partkey", raw.alias("raw")).withColumn("code", native_code(F.col("raw")))


# -- the training gate --------------------------------------------------------------------------

_PLACE, _FLAGS = governance.FIXTURE_LOCATION, governance.RUNTIME_FLAGS
#: The key's remainder by each of these sets a flag against the rules.
_FLAG_STEPS = dict(zip(_FLAGS, (3, 5, 7, 11, 13, 17)))


@query("training_gate", f"""WITH r AS (SELECT s_suppkey AS k, s_suppkey % 19 <> 0 AS fixture, CASE s_suppkey % 4 WHEN 3 THEN ' Kaggle ' ELSE '{_PLACE}' END AS place, s_suppkey % 23 = 0 AS nulled, s_suppkey % 6 = 5 AS expired,
  {', '.join(f"(s_suppkey % {n} = 0) <> {x == 'synthetic_only'} AS {x}" for x, n in _FLAG_STEPS.items())} FROM supplier),
d AS (SELECT k, CASE WHEN nulled THEN ['runtime_invalid'] ELSE list_filter([
  CASE WHEN expired THEN 'rights_expired' END, CASE WHEN place = ' Kaggle ' THEN 'location_not_approved' END, CASE WHEN place = ' Kaggle ' THEN 'kaggle_not_allowed' END,
  CASE WHEN NOT fixture THEN 'live_manifest_training_forbidden' END, CASE WHEN place = ' Kaggle ' THEN 'fixture_location_forbidden' END,
  CASE WHEN network_enabled THEN 'network_must_be_disabled' END, CASE WHEN external_logging THEN 'external_logging_forbidden' END, CASE WHEN raw_transfer_requested THEN 'training_raw_transfer_forbidden' END,
  CASE WHEN NOT synthetic_only THEN 'synthetic_only_required' END, CASE WHEN gpu_job THEN 'gpu_job_forbidden' END, CASE WHEN restricted_runtime_authorized THEN 'restricted_runtime_forbidden' END], lambda x: x IS NOT NULL) END AS reasons FROM r)
SELECT k AS s_suppkey, len(reasons) = 0 AS allowed, array_to_string(reasons, ',') AS reasons FROM d""")
def training_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Each supplier asks for a run of its own location, day and flags; a null flag now and then."""
    key = F.col("s_suppkey")
    flags = {x: (key % n == 0) != F.lit(x == "synthetic_only") for x, n in _FLAG_STEPS.items()}
    flags["gpu_job"] = F.when(key % 23 != 0, flags["gpu_job"])
    asked = read_table(spark, folder, "supplier").select(
        key, (key % 19 != 0).alias("fixture_only"), F.lit("approved").alias("rights_status"), F.lit("2030-01-01").cast("date").alias("rights_expires_on"), F.array(F.lit(_PLACE)).alias("approved_locations"),
        F.array().cast("array<string>").alias("raw_transfer_allowed_locations"), F.lit(False).alias("kaggle_allowed"), F.when(key % 4 == 3, " Kaggle ").otherwise(_PLACE).alias("requested_location"),
        F.when(key % 6 == 5, F.lit("2030-01-01")).otherwise("2029-12-31").cast("date").alias("as_of_date"), *(c.alias(x) for x, c in flags.items()),
    )
    return governance.training_decisions(asked).select("s_suppkey", "allowed", F.array_join("reasons", ",").alias("reasons"))


# -- provenance --------------------------------------------------------------------------------

_RUN_TEXT = (
    '{{"artifact_paths":["artifacts/synthetic/{key}.json"],"command":["{program}","-m","unittest"],"device":{{"environment":"local-offline-synthetic","kind":"{kind}"}},"fixture_only":{fixture},'
    '"hashes":{{"config":"sha256:{zeros}"}},"schema_version":1,"seeds":{{"split":{seed}}},"versions":{{"spark":"4"}}}}'
)
#: By the key's remainder by 6: what is odd about a run, and why it is refused.
_ODD = {1: ("program", "bash", "command_not_allowed"), 2: ("kind", "gpu", "device_scope_invalid"), 3: ("seed", "-1", "seeds_invalid"), 4: ("fixture", "false", "fixture_only_required")}


def _run_parts() -> list[tuple[str, str]]:
    """The text's literal pieces, and the name of the value behind each."""
    text = _RUN_TEXT.replace("{zeros}", "0" * 64)
    out, names = [], ("key", "program", "kind", "fixture", "seed")
    while text:
        name = min((n for n in names if "{" + n + "}" in text), key=lambda n: text.index("{" + n + "}"), default="")
        head, _, text = text.partition("{" + name + "}") if name else (text, "", "")
        out.append((head.replace("{{", "{").replace("}}", "}"), name))
    return out


_USUAL = {"program": "python", "kind": "cpu", "fixture": "true"}


def _run_sql() -> str:
    def value(name: str) -> str:
        odd = [f"WHEN {k} THEN '{v}'" for k, (n, v, _) in _ODD.items() if n == name]
        usual = "CAST(c_custkey AS VARCHAR)" if name in ("key", "seed") else f"'{_USUAL[name]}'"
        return f"CASE c_custkey % 6 {' '.join(odd)} ELSE {usual} END" if odd else usual

    return " || ".join(x for head, name in _run_parts() for x in (f"'{head}'", *([value(name)] if name else [])))


@query("provenance_digest", f"""WITH runs AS (SELECT c_custkey, {_run_sql()} AS text FROM customer)
SELECT c_custkey AS run_id, CASE WHEN c_custkey % 6 IN (0, 5) THEN 'sha256:' || sha256(text) END AS digest,
       CASE c_custkey % 6 {' '.join(f"WHEN {k} THEN '{reason}'" for k, (_, _, reason) in _ODD.items())} END AS reason FROM runs""")
def provenance_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's run, its JSON with keys in another order than the canonical one."""
    key = F.col("c_custkey")

    def value(name: str) -> Column:
        out = key.cast("string") if name in ("key", "seed") else F.lit(_USUAL[name])
        for k, (n, v, _) in _ODD.items():
            out = F.when(key % 6 == k, F.lit(v)).otherwise(out) if n == name else out
        return out

    text = F.concat(*(x for head, name in _run_parts() for x in (F.lit(head), *([value(name)] if name else []))))
    turned = F.concat(F.lit('{ "versions": {"spark":"4"}, '), F.replace(F.substr(text, F.lit(2)), F.lit(',"versions":{"spark":"4"}'), F.lit(" ")))
    return provenance.provenance_audits(read_table(spark, folder, "customer").select(key.alias("run_id"), turned.alias("provenance")))


# -- model registries -----------------------------------------------------------------------------

_SPECS = ", ".join(f"('{name}', '{family}', '{kind}')" for name, (family, kind) in models.SYSTEMS.items())


@query("registry_audit", f"""WITH systems AS (SELECT * FROM (VALUES {_SPECS}) s(name, family, kind)),
specs AS (SELECT c_custkey AS id, name, CASE WHEN c_custkey % 9 = 8 AND name = 'rule' THEN 'other' ELSE family END AS family, kind,
  family || CASE WHEN c_custkey % 9 = 4 AND name = 'domain_full' THEN '-other' ELSE '-model' END AS model,
  CASE WHEN c_custkey % 9 = 3 AND name = 'general_full' THEN 'main' ELSE 'commit:' || repeat('a', 40) END AS revision,
  CASE WHEN name <> 'rule' OR c_custkey % 9 = 6 THEN family || '-tokenizer' END AS tokenizer,
  CASE WHEN c_custkey % 9 = 5 AND name = 'general_lora' THEN 'sha256:others' WHEN c_custkey % 9 = 7 AND name = 'rule' THEN ' ' ELSE 'sha256:labels' END AS labels
  FROM customer, systems WHERE NOT (c_custkey % 9 = 1 AND name = 'rule')
  UNION ALL SELECT c_custkey, name, family, kind, family || '-model', 'commit:' || repeat('a', 40), family || '-tokenizer', 'sha256:labels' FROM customer, systems WHERE c_custkey % 9 = 2 AND name = 'general_full'),
marked AS (SELECT *, trim(labels) <> '' AS valid FROM specs),
got AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE valid) AS ok, count(DISTINCT name) FILTER (WHERE valid) AS names,
  count(*) FILTER (WHERE valid AND (name, family, kind) NOT IN (SELECT (name, family, kind) FROM systems)) AS odd, count(*) FILTER (WHERE valid AND name = 'rule' AND tokenizer IS NOT NULL) AS ruled,
  count(*) FILTER (WHERE valid AND name <> 'rule' AND (tokenizer IS NULL OR NOT regexp_full_match(revision, 'commit:[0-9a-f]{{40,64}}|sha256:[0-9a-f]{{64}}'))) AS loose,
  count(DISTINCT labels) FILTER (WHERE valid) AS contracts, count(DISTINCT model || revision) FILTER (WHERE valid AND name LIKE 'domain%') AS domains, count(DISTINCT model || revision) FILTER (WHERE valid AND name LIKE 'general%') AS generals
  FROM marked GROUP BY id),
d AS (SELECT id, n, list_filter([CASE WHEN ok < n THEN 'registry_invalid' END, CASE WHEN names < ok THEN 'duplicate_logical_system' END, CASE WHEN names <> 5 THEN 'exact_system_set_required' END,
  CASE WHEN odd > 0 THEN 'logical_system_definition_invalid' END, CASE WHEN ruled > 0 THEN 'rule_tokenizer_forbidden' END, CASE WHEN loose > 0 THEN 'neural_revision_not_immutable' END,
  CASE WHEN contracts > 1 THEN 'label_contract_mismatch' END, CASE WHEN domains > 1 OR generals > 1 THEN 'family_revision_mismatch' END], lambda x: x IS NOT NULL) AS reasons FROM got)
SELECT id AS registry_id, len(reasons) = 0 AS allowed, array_to_string(reasons, ',') AS reasons, n AS system_count FROM d""")
def registry_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's registry; eight of nine are odd in one way each."""
    systems = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(family).alias("family"), F.lit(kind).alias("kind")) for name, (family, kind) in models.SYSTEMS.items()))
    case = F.col("c_custkey") % 9
    every = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("registry_id"), case.alias("case"), F.explode(F.concat(systems, F.when(case == 2, F.slice(systems, 5, 1)).otherwise(F.slice(systems, 1, 0)))).alias("s"))
    name = F.col("s.name")
    at = lambda k, system: (F.col("case") == k) & (name == system)
    specs = every.where(~at(1, "rule")).select(
        "registry_id", name.alias("logical_system"), F.when(at(8, "rule"), "other").otherwise(F.col("s.family")).alias("family"), F.col("s.kind").alias("adaptation"),
        F.concat("s.family", F.when(at(4, "domain_full"), "-other").otherwise("-model")).alias("model_reference"), F.when(at(3, "general_full"), "main").otherwise("commit:" + "a" * 40).alias("model_revision"),
        F.when((name != "rule") | (F.col("case") == 6), F.concat("s.family", F.lit("-tokenizer"))).alias("tokenizer_reference"), F.when((name != "rule") | (F.col("case") == 6), F.lit("commit:" + "b" * 40)).alias("tokenizer_revision"),
        F.when(at(5, "general_lora"), "sha256:others").when(at(7, "rule"), " ").otherwise("sha256:labels").alias("label_contract_digest"), F.lit("scores_v1").alias("output_contract"),
    )
    return models.registry_audits(specs).select("registry_id", "allowed", F.array_join("reasons", ",").alias("reasons"), "system_count")


# -- artifacts -----------------------------------------------------------------------------------

#: What an event's artifact holds beside its own properties, by the event's remainder by 7.
_NESTED = {
    0: "{}", 1: '{"uncertainty": [1, {"Patient-ID": 3}, []]}', 2: '{"uncertainty": {"a": [{"b": {"raw notes": [[{"c": "see sk-abcdefgh12"}]]}}]}}',
    3: '{"micro_f1": "a SYNTHETIC_note_text_canary in MODEL.PT"}', 4: '{"macro_f1": {"Pati\\\\u0065nt \\\\"IDS": ["say \\\\"x.bin"], "weights": {"weights": 1}}}', 5: '{"record_count": 2.5, "precision_at_5": true}', 6: '{"runtime_seconds": [[[["hf_12345678"]]]], "rows": 1}',
}
_HEAD = '{"artifact_type": "aggregate_metrics", ' + ", ".join(f'"{x}": false' for x in privacy.REQUIRED_FALSE_FLAGS)
_KEY_CASE = " ".join(f"WHEN name IN ({', '.join(map(repr, keys))}) THEN '{reason}'" for reason, keys in privacy.FORBIDDEN_KEYS.items())
_SECRET_SQL = " OR ".join(f"regexp_matches(said, '{p}')" for p in privacy.SECRET_PATTERNS.values())


def _nested(text: str) -> str:
    return text.replace("\\\\", "\\")


@query("event_artifact_audit", f"""WITH given AS (SELECT event_id, '{_HEAD}, "metrics": ' || CASE event_id % 7 {' '.join(f"WHEN {k} THEN '{_nested(x)}'" for k, x in _NESTED.items())} END || ', "limitations": ' || to_json(props) || '}}' AS artifact FROM events),
nodes AS (SELECT event_id, t.id AS id, t.key AS key, t.type AS kind, t.atom ->> '$' AS said FROM given, json_tree(given.artifact) t),
named AS (SELECT event_id, id, kind, said, regexp_replace(regexp_replace(lower(key), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS name FROM nodes),
found AS (SELECT event_id, id, list_filter([CASE {_KEY_CASE} END, CASE WHEN kind = 'VARCHAR' AND regexp_matches(said, '{privacy.NOTE_PATTERN}') THEN 'note_text_forbidden' END,
  CASE WHEN kind = 'VARCHAR' AND ({_SECRET_SQL}) THEN 'secret_forbidden' END, CASE WHEN kind = 'VARCHAR' AND regexp_matches(lower(said), '({'|'.join(x.replace('.', '[.]') for x in privacy.CHECKPOINT_SUFFIXES)})$') THEN 'checkpoint_forbidden' END], lambda x: x IS NOT NULL) AS r FROM named),
walked AS (SELECT event_id, flatten(list(r ORDER BY id)) AS r FROM found GROUP BY event_id),
rooted AS (SELECT event_id, sum((m.key NOT IN ({', '.join(map(repr, privacy.METRIC_FIELDS))}))::INT + (m.type NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE'))::INT) AS bad FROM given, json_each(json_extract(given.artifact, '$.metrics')) m GROUP BY event_id),
whole AS (SELECT event_id, r || list_transform(range(CAST(coalesce(bad, 0) AS BIGINT)), lambda x: 'artifact_structure_invalid') AS r FROM walked LEFT JOIN rooted USING (event_id))
SELECT event_id, len(r) = 0 AS allowed, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') AS reasons, len(r) AS finding_count FROM whole""")
def event_artifact_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Each event as an artifact to publish, with names and values that it may not hold at any depth."""
    metrics = F.lit("")
    for k, x in _NESTED.items():
        metrics = F.when(F.col("event_id") % 7 == k, F.lit(_nested(x))).otherwise(metrics)
    quoted = F.concat(F.lit('"'), F.replace(F.replace("props", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    text = F.concat(F.lit(_HEAD + ', "metrics": '), metrics, F.lit(', "limitations": '), quoted, F.lit("}"))
    audits = privacy.artifact_audits(read_table(spark, folder, "events").select(F.col("event_id").alias("artifact_id"), text.alias("artifact"), F.lit("public_report").alias("destination")))
    return audits.select(F.col("artifact_id").alias("event_id"), "allowed", F.array_join("reasons", ",").alias("reasons"), "finding_count")
