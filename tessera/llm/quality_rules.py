"""Quality rules: text statistics and a learned decision list, as Spark expressions only.

`with_statistics` adds counts in one pass over each text, with array expressions and no
shuffle. `learn` fits an ordered list of threshold conjunctions by sequential covering on at
most `SAMPLE_ROWS` labelled documents (those with the smallest hash of doc_id, each once): each rule grows by
the condition of greatest information gain (thresholds halfway between neighbouring values)
on two thirds of the rows left, is pruned on the other third, is kept if its precision
(Laplace estimate) is at least 0.9, and the rows it covers leave. `verdict` turns
the list into one conditional expression: the first rule that holds rejects, else a text
stays.

Defined results: null and empty texts have no words, so they fail the base rules; a text of any
length is counted whole; rows that repeat a doc_id are judged one by one, and one of them (least
hash of the text, then the lower label) stands for it when rules are learned; a null label, a label
without doc_id or of a missing document is not used, and a null doc_id has none; without labels of
both kinds the list is empty and only the base rules decide; an empty table gives no rows; other
columns pass `keep_good` untouched, whatever their names (`with_statistics` replaces columns of
the same name as a statistic).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, hash_sample, let, text_of

SAMPLE_ROWS = 4000
WINDOW = 8
SYMBOLS = "#*$%&|<>"
_SPACE_CHARS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = "0123456789"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_same_as_before", "n_marks", "n_upper", "n_digits")


def _repeated(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the array."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        def starts(pairs: Column) -> Column:
            same = lambda x, i: F.coalesce(x["h"] == F.get(pairs, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(pairs, i + 1)["h"], F.lit(False))
            found = F.sort_array(F.transform(F.filter(pairs, same), lambda x: x["i"]))
            return let(found, lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
                F.lit(0), lambda a, x: a + x,
            ))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, starts))

    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n < WINDOW, F.lit(0)).otherwise(let(hashes, covered))


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with STATISTICS and base_failed."""
    text = text_of(docs)
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    words = F.array_remove(F.split(text, SPACE_CLASS + "+", -1), "")
    of_words = let(words, lambda w: F.struct(
        F.size(w).alias("n_words"), _repeated(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).alias("n_same_as_before"),
    ))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, _SPACE_CHARS, "")) > 0)
    counts = {
        "word_chars": F.length(F.translate(text, _SPACE_CHARS, "")),
        "n_symbols": without(SYMBOLS),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_marks": without("!?|"),
        "n_upper": without(_UPPER),
        "n_digits": without(_DIGITS),
    }
    named = {"_of_words": of_words} | {k: v.cast("long") for k, v in counts.items()}
    got = docs.withColumns(named)
    got = got.withColumns({k: F.col("_of_words")[k].cast("long") for k in ("n_words", "n_repeat_words", "n_same_as_before")}).drop("_of_words")
    return got.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _per(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    """What rules compare: name to an expression over the statistics."""
    return {
        "symbols_per_word": _per("n_symbols", "n_words"),
        "marks_per_word": _per("n_marks", "n_words"),
        "upper_share": _per("n_upper", "word_chars"),
        "digit_share": _per("n_digits", "word_chars"),
        "repeat_share": _per("n_repeat_words", "n_words"),
        "run_share": _per("n_same_as_before", "n_words"),
        "dup_lines_per_word": _per("n_dup_lines", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, rows: dict) -> object:
        x = rows[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        x = features()[self.feature]
        return x > self.threshold if self.above else x <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    precision: float

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


def fit_list(rows: dict, bad: object, max_rules: int = 12, max_conditions: int = 3, min_precision: float = 0.9) -> tuple[Rule, ...]:
    """Sequential covering over numpy columns; `bad` marks the rows to reject."""
    import numpy as np

    bad = np.asarray(bad, bool)
    left, rules = np.ones(len(bad), bool), []
    third = np.arange(len(bad)) % 3 == 2

    def holds(conditions, where):
        out = where.copy()
        for c in conditions:
            out &= c.holds(rows)
        return out

    def grow(where):
        chosen: list[Condition] = []
        inside = where.copy()
        while len(chosen) < max_conditions and (inside & ~bad).any():
            p, n = (inside & bad).sum(), (inside & ~bad).sum()
            best = (1e-9, None)
            for name, x in rows.items():
                seen = np.unique(x[inside])
                at = np.unique(np.searchsorted(seen, np.quantile(x[inside], np.linspace(0, 1, 41), method="lower")))
                for t in (seen[at[at < len(seen) - 1]] + seen[at[at < len(seen) - 1] + 1]) / 2:
                    for above in (True, False):
                        hit = inside & (x > t if above else x <= t)
                        p1, n1 = (hit & bad).sum(), (hit & ~bad).sum()
                        if p1:
                            gain = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p / (p + n)))
                            if gain > best[0]:
                                best = (gain, Condition(name, above, float(t)))
            if best[1] is None:
                break
            chosen.append(best[1])
            inside &= best[1].holds(rows)
        return chosen

    def worth(conditions, where):
        hit = holds(conditions, where)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rules) < max_rules and (left & bad).any():
        conditions = grow(left & ~third)
        if not conditions:
            break
        check = left & third
        while len(conditions) > 1 and worth(conditions[:-1], check) >= worth(conditions, check):
            conditions.pop()
        hit = holds(conditions, left)
        n = int(hit.sum())
        precision = float(((hit & bad).sum() + 1) / (n + 2))
        if precision < min_precision or worth(conditions, check) < 2 * min_precision - 1:
            break
        tight = {}
        for c in conditions:  # a later condition on the same side of a feature is the tighter one
            tight[c.feature, c.above] = c
        rules.append(Rule(tuple(tight.values()), n, precision))
        left &= ~hit
    return tuple(rules)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    import numpy as np

    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("_quality"))
    sample = hash_sample(known, "doc_id", sample_rows)
    joined = with_statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    # One row for each doc_id, so there are as many as in the sample at most.
    got = joined.select("doc_id", F.struct(F.xxhash64("text").alias("h"), "_quality", *(v.alias(k) for k, v in features().items())).alias("x"))
    rows = [r.x for r in got.groupBy("doc_id").agg(F.min("x").alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    if not rows:
        return ()
    columns = {k: np.array([r[k] for r in rows], float) for k in features()}
    return fit_list(columns, np.array([r["_quality"] == 0 for r in rows]))


def verdict(rules: tuple[Rule, ...]) -> Column:
    """False where the base rules fail or a rule holds, else true; over the statistics."""
    out = F.when(F.col("base_failed"), F.lit(False))
    for r in rules:
        out = out.when(r.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = with_statistics(docs.select("doc_id", "text"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict(learn(docs, labels)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text")  # apart from statistics of the same name
    return with_statistics(whole).where(verdict(learn(docs, labels))).select("_row.*")
