"""One registered query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fill_middle, flac, html_text, lattice_lm, minhash, packing, quality_rules, radix_dedup, resampling, secret_scan, substring_dedup, token_counts
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), 4096)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op3_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lm_scores(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 4096, 1)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op10_radix_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.report(table(spark, sf_dir, "documents"))


def op12_flac_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.report(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return resampling.resample(table(spark, sf_dir, "documents"), target)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_secret_scan": op2_secret_scan,
    "op3_suffix_tree_dedup": op3_suffix_tree_dedup,
    "op4_lattice_lm": op4_lattice_lm,
    "op5_quality_rules": op5_quality_rules,
    "op6_spaced_seed_decontamination": op6_spaced_seed_decontamination,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_html_extraction": op8_html_extraction,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_radix_sort_dedup": op10_radix_sort_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_flac_columns": op12_flac_columns,
    "op13_importance_resampling": op13_importance_resampling,
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: SQL for the operators whose whole result it can express. The others need a tokenizer, a trained
#: model, a renderer or approximate alignment; tests hold them to brute force.
ORACLE: dict[str, str] = {
    "op3_suffix_tree_dedup": f"""WITH split AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM split),
windows AS (SELECT *, string_agg(word, ' ') OVER f AS win, count(*) OVER f AS n FROM words
  WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
starts AS (SELECT doc_id, pos, word, CASE WHEN n = 20 AND row_number() OVER (PARTITION BY win, n ORDER BY doc_id, pos) > 1 THEN 1 ELSE 0 END AS again FROM windows),
covered AS (SELECT doc_id, pos, word, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM starts),
kept AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM covered GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (doc_id)""",
    "op9_minhash_near_dedup": f"""WITH RECURSIVE split AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS total FROM split),
windows AS (SELECT doc_id, pos, total, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM words
  WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
shingles AS (SELECT DISTINCT doc_id, s FROM windows WHERE n = 5 OR (total < 5 AND pos = 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM split LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)""",
    "op10_radix_sort_dedup": """WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM docs WHERE len(h) >= 800),
keyed AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM windows),
again AS (SELECT doc_id, i FROM keyed QUALIFY count(*) OVER (PARTITION BY k) > 1),
marked AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM again),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM marked),
spans AS (SELECT doc_id, run, min(i) AS s, max(i) + 400 AS e FROM numbered GROUP BY ALL),
pieces AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS z FROM spans UNION ALL SELECT doc_id, max(e), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, CASE WHEN z IS NULL THEN len(h) ELSE 2 * (z - a) END), '' ORDER BY a) AS kept FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS removed FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)""",
    "op11_fill_in_middle": """WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS d FROM documents),
drawn AS (SELECT *, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (n + 1) AS y,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
       WHEN CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM texts),
cut AS (SELECT *, least(x, y) AS lo, greatest(x, y) AS hi FROM drawn),
made AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, lo) || '<S>' || substr(t, hi + 1) || '<M>' || substr(t, lo + 1, hi - lo)
  ELSE '<S>' || substr(t, hi + 1) || '<P>' || substr(t, 1, lo) || '<M>' || substr(t, lo + 1, hi - lo) END AS output FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(lo AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(hi - lo AS BIGINT) END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM made""",
    "op13_importance_resampling": rf"""WITH RECURSIVE rounds AS (SELECT n, n AS c, 0 AS k FROM range(256) r(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM rounds WHERE k < 8),
steps AS (SELECT list(c ORDER BY n) AS t FROM rounds WHERE k = 8),
every AS (SELECT doc_id, text, true AS own FROM documents UNION ALL SELECT NULL, text, false FROM benchmark),
found AS (SELECT doc_id, own, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM every),
words AS (SELECT doc_id, own, unnest(w) AS word FROM found),
spelled AS (SELECT word, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))) AS b
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM words)),
buckets AS (SELECT word, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM spelled, steps),
counts AS (SELECT bucket, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t FROM words JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM counts),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((c.t + 1) * (a.s + 10000) AS DOUBLE) / CAST((c.s + 1) * (a.t + 10000) AS DOUBLE))) AS BIGINT) AS g FROM counts c, totals a),
weighed AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM words JOIN buckets USING (word) JOIN gain USING (bucket) WHERE own GROUP BY doc_id),
scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM found LEFT JOIN weighed USING (doc_id) WHERE own),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM ranked) THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)""",
}
