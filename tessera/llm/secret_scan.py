r"""Secret spans: three base patterns, and character Markov models compared by likelihood.

Base spans are the leftmost non-overlapping matches per kind, kept if long enough: assign
(keyword, separator, value of 12+), access (AKIA...), hex runs. Spark has no function for
match positions, so they come from the lengths of what stands between and in the matches
(`split` and `regexp_extract_all` by one pattern). Keywords are matched in either case in
ASCII letters only.

The method adds spans of kind markov: runs of 20 or more of `[A-Za-z0-9+/_=-]` with a digit
and a letter that touch no base span, whose mean log-likelihood ratio per transition between
two first-order character models is at least MIN_RATIO. One model is of random strings (hex,
base64, letters and digits, drawn from hashes), the other of ordinary identifiers (pairs of
WORDS joined as programs do, and words of about SAMPLE_DOCS documents, those of smallest
hash, without base matches; nothing of them is collected but counts). Their counts,
at most one per character pair and label, become one literal array; all else is DataFrame
expressions. Arrays of spans are built, compared and cut in blocks, so work follows a text's
length, not its square.

Defined results: null and empty texts have no spans (the hash of the empty string; `redact`
leaves a null null); a text of any length is scanned whole; ties and repeated rows are scanned
alike, each with its row, and a null doc_id stays null; an empty table gives no rows; other
columns are ignored by the report and pass `redact` untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_share, let, text_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SAMPLE_DOCS = 2000
RANDOM_STRINGS = 2000
MIN_RATIO, BACKOFF = 3.0, 20
WORDS = (
    "access account action address admin array base build cache call class client code config content count create data date default delete device "
    "document element email end error event field file filter first format function get group handler header height host image index info input "
    "item key label last length level line link list load local map message method mode model module name network node number object option order "
    "page parent password path plugin port position process project property query read record remote report request response result role root "
    "rule sample schema secret server service session set setting size source start state status storage string style system table tag target "
    "task template test text time title token total type update upload url user value version view width window write"
).split()
BLOCK, PIECE = 256, 4096
SPAN = "array<struct<s:int,k:int,e:int>>"


def _scan(items: Column, step, kind: str) -> Column:
    """Each item's result where step(state, item) gives the next state and a result; the state is
    an int, 0 at first. Results are gathered in blocks, so that no array is copied once per item."""
    state = lambda a: a["state"]
    none = F.array().cast(f"array<{kind}>")

    def of_block(before: Column, part: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            new, out = step(state(acc), x)
            return F.struct(new.cast("int").alias("state"), F.concat(acc["out"], F.array(out.cast(kind))).alias("out")).cast(f"struct<state:int,out:array<{kind}>>")

        return F.aggregate(part, F.struct(before.alias("state"), none.alias("out")).cast(f"struct<state:int,out:array<{kind}>>"), one)

    blocks = F.transform(F.sequence(F.lit(1), F.size(items), F.lit(BLOCK)), lambda b: F.slice(items, b, BLOCK))
    whole = f"struct<state:int,out:array<array<{kind}>>>"
    gathered = F.aggregate(
        blocks, F.struct(F.lit(0).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")).cast(whole),
        lambda acc, part: let(of_block(state(acc), part), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out"))).cast(whole),
    )
    return F.when(F.size(items) > 0, F.flatten(gathered["out"])).otherwise(none)


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Spans (start, kind, end) of the matches, in order."""
    p = F.lit(pattern)
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, p, 0)
    after = lambda at, x: (at + x["g"] + x["w"], F.struct((at + x["g"]).alias("s"), F.lit(kind).alias("k"), (at + x["g"] + x["w"]).alias("e")))
    sized = let(F.struct(gaps.alias("g"), hits.alias("h")), lambda x: F.transform(x["h"], lambda h, i: F.struct(F.length(F.get(x["g"], i)).alias("g"), F.length(h).alias("w"))))
    return F.when(F.regexp_like(text, p), let(sized, lambda x: _scan(x, after, "struct<s:int,k:int,e:int>"))).otherwise(F.array().cast(SPAN))


def _touches(spans: Column):
    """A function that says whether a stretch (s, e) touches one of spans, which are sorted by start;
    blocks of them are looked at first."""
    blocks = F.transform(F.sequence(F.lit(1), F.size(spans), F.lit(BLOCK)), lambda b: let(F.slice(spans, b, BLOCK), lambda x: F.struct(F.get(x, F.lit(0))["s"].alias("s"), F.array_max(F.transform(x, lambda y: y["e"])).alias("e"), x.alias("x"))))
    near = lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"])
    return F.when(F.size(spans) > 0, blocks), lambda blocks, s: F.coalesce(F.exists(blocks, lambda b: near(b, s) & F.exists(b["x"], lambda x: near(x, s))), F.lit(False))


def base_spans(text: Column) -> Column:
    """All base spans in no particular order."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), 2)
    assign = let(_spans(text, ASSIGN, 0), lambda s: F.when(F.size(s) > 0, let(values, lambda v: F.filter(s, lambda x, i: F.length(F.get(v, i)) >= 12))).otherwise(s))
    return F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2))


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled samples of secrets: n strings each in hex, base64, and letters with digits."""
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256)
    coded = F.base64(F.unhex(digest))
    forms = F.array(F.substring(digest, 1, 40), F.translate(coded, "=", ""), F.translate(coded, "+/=", ""), F.upper(F.translate(coded, "+/=", "")))
    return spark.range(n, numPartitions=1).select(F.explode(forms).alias("text"), F.lit(True).alias("secret"))


def ordinary_strings(docs: DataFrame, n: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled samples of identifiers: the words of 4 to 19 characters of about n documents, base
    matches left out (longer ones are the candidates that the model is to judge)."""
    text = text_of(docs)
    for pattern in (ASSIGN, ACCESS, HEX):
        text = F.regexp_replace(text, pattern, " ")
    some = hash_share(docs.select("doc_id", "text"), n, "doc_id", "text")
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/_=-]{4,}"), 0)
    return some.select(F.explode(F.filter(words, lambda w: F.length(w) < 20)).alias("text"), F.lit(False).alias("secret"))


def known_identifiers(spark: SparkSession) -> DataFrame:
    """Labelled samples of identifiers as programs have them: pairs of WORDS, joined in four ways,
    some with a number behind."""
    words = F.lit(list(WORDS))
    pairs = spark.range(1, numPartitions=1).select(F.explode(words).alias("a")).select("a", F.explode(words).alias("b"))
    a, b = F.col("a"), F.col("b")
    forms = F.array(F.concat_ws("_", a, b), F.concat_ws("-", a, b), F.concat(a, F.initcap(b)), F.upper(F.concat_ws("_", a, b)), F.concat(F.initcap(a), F.initcap(b), F.lit("2")), F.concat_ws("/", a, b, F.lit("v1")))
    return pairs.select(F.explode(forms).alias("text"), F.lit(False).alias("secret"))


def fit_ratios(samples: DataFrame) -> list[float]:
    """log p(b | a, random) - log p(b | a, ordinary) at [a * n + b]; a pair's probability backs
    off to its second character's where the first is rare."""
    n = len(ALPHABET)
    pairs = samples.where(F.length("text") > 1).select(
        "secret",
        F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring(F.col("text"), i, F.lit(2)))).alias("pair"),
    )
    counts = {(r[0], r[1]): r[2] for r in pairs.groupBy("secret", "pair").count().collect()}  # bounded by the alphabet

    def logs(label: bool) -> list[list[float]]:
        rows = [[counts.get((label, a + b), 0) for b in ALPHABET] for a in ALPHABET]
        second = [sum(column) + 0.5 for column in zip(*rows, strict=True)]
        total = sum(second)
        return [[math.log((x + BACKOFF * s / total) / (sum(row) + BACKOFF)) for x, s in zip(row, second, strict=True)] for row in rows]

    out = [x - y for one, two in zip(logs(True), logs(False), strict=True) for x, y in zip(one, two, strict=True)]
    assert len(out) == n * n
    return out


def _ratio(word: Column, table: Column) -> Column:
    """Mean log-likelihood ratio per transition."""
    at = lambda i: F.position(F.substring(word, i, F.lit(1)), F.lit(ALPHABET)) - 1
    each = F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.get(table, at(i) * len(ALPHABET) + at(i + 1)))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / (F.length(word) - 1)


def _markov(text: Column, base: Column, ratios: list[float]) -> Column:
    import numpy as np

    table = F.lit(np.array(ratios))
    words = F.regexp_extract_all(text, F.lit(CANDIDATE), 0)
    mixed = lambda w: F.regexp_like(w, F.lit("[0-9]")) & F.regexp_like(w, F.lit("[A-Za-z]"))

    blocks, touches = _touches(base)

    def kept(w: Column, spans: Column) -> Column:
        return let(blocks, lambda b: F.filter(spans, lambda s, i: mixed(F.get(w, i)) & (_ratio(F.get(w, i), table) >= MIN_RATIO) & ~touches(b, s)))

    some = F.regexp_like(text, F.lit(CANDIDATE))
    return F.when(some, let(words, lambda w: let(_spans(text, CANDIDATE, 3), lambda s: kept(w, s)))).otherwise(F.array().cast(SPAN))


def with_spans(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """docs with _base and _spans, both ordered by start and kind."""
    text = text_of(docs)
    found = let(text, lambda t: let(F.sort_array(base_spans(t)), lambda b: F.struct(b.alias("base"), F.sort_array(F.concat(b, _markov(t, b, ratios))).alias("spans"))))
    return docs.withColumn("_found", found).withColumns({"_base": F.col("_found.base"), "_spans": F.col("_found.spans")}).drop("_found")


def learn(docs: DataFrame) -> list[float]:
    spark = docs.sparkSession
    return fit_ratios(random_strings(spark).union(known_identifiers(spark)).union(ordinary_strings(docs)))


def _named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    found = with_spans(docs.select("doc_id", "text"), learn(docs))
    n = lambda k: F.size(F.filter("_spans", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), n(3).alias("n_markov"),
        F.sha2(_named(F.col("_base")), 256).alias("base_sha256"), _named(F.col("_spans")).alias("spans"),
    )


def _stretches(spans: Column) -> Column:
    """The stretches (s, e) that spans, sorted by start, cover."""
    kind = "struct<first:boolean,s:int,e:int>"
    reach = lambda end, x: (F.greatest(end, x["e"]), F.struct((x["s"] >= end).alias("first"), x["s"].alias("s"), F.greatest(end, x["e"]).alias("e")))

    def joined(marks: Column) -> Column:
        starts = F.filter(marks, lambda x, i: x["first"] | (i == 0))
        ends = F.filter(marks, lambda x, i: F.coalesce(F.get(marks, i + 1)["first"], F.lit(True)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a["s"].alias("s"), b["e"].alias("e")))

    return let(_scan(spans, reach, kind), joined)


def _cutter(pieces: Column):
    """A function that gives the characters from a to b of a text in pieces of PIECE characters."""
    def cut(a: Column, b: Column) -> Column:
        one, two = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        head = F.coalesce(F.get(pieces, one), F.lit(""))
        tail = F.substring(F.coalesce(F.get(pieces, two), F.lit("")), F.lit(1), (b - two * PIECE).cast("int"))
        between = F.array_join(F.slice(pieces, one + 2, F.greatest(two - one - 1, F.lit(0))), "")
        return F.when(one == two, F.substring(head, (a - one * PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise(F.concat(F.substring(head, (a - one * PIECE + 1).cast("int"), F.lit(PIECE)), between, tail))

    return cut


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each stretch covered by spans replaced by mark, and n_chars to match."""
    columns = docs.columns
    text = F.col("text")

    def cut(spans: Column) -> Column:
        between = lambda r, piece: F.concat(
            F.transform(r, lambda x, i: let(F.coalesce(F.get(r, i - 1)["e"], F.lit(0)), lambda a: piece(a, x["s"]))),
            F.array(piece(F.get(r, F.size(r) - 1)["e"], F.length(text))),
        )
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0)
        return let(_stretches(spans), lambda r: let(pieces, lambda p: F.array_join(between(r, _cutter(p)), mark)))

    found = with_spans(docs.select(F.struct(*columns).alias("_row"), "text"), learn(docs))
    some, own = F.size("_spans") > 0, F.col("_row")
    done = found.withColumn("text", F.when(some, cut(F.col("_spans"))).otherwise(text))
    new = {"text": F.col("text")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return done.select(*(new.get(c, own[c]).alias(c) for c in columns))
