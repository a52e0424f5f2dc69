"""Repeats in texts that repeat themselves at a short distance: rulers, zeros, padding."""

import random

import pytest

from tessera.llm import radix_dedup, repeats, substring_dedup

from .test_operators import later_words, repeated_bytes, rows_of

r = random.Random(11)
PROSE = " ".join(r.choice("abcdefghij") * r.randint(1, 9) for _ in range(400))
TEXTS = {
    1: "a" * 3000,
    2: "=" * 399 + " " + "=" * 401,
    3: PROSE + " " + "-" * 900 + " " + PROSE[:700],
    4: "hello worl " * 300,
    5: "lo worl hel" * 200 + "lo worl h",
    6: "x y z " * 200 + PROSE[300:900],
    7: "same " * 21,
    8: "same " * 20,
    9: "a" * 400,
    10: "".join(f"{r.randrange(10**9):09d} " + "#" * 60 for _ in range(40)),
    11: "word " * 700 + "last",
    12: (PROSE[:350] + "|") * 9,
    13: (PROSE[:390] + "|") * 9,
}


@pytest.mark.parametrize("hot", [None, 3])
def test_results_are_those_of_all_windows(spark, monkeypatch, hot):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").repartition(3)
    assert rows_of(radix_dedup.remove_repeats(df, hot), "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeated_bytes(TEXTS, 400)
    assert rows_of(substring_dedup.remove_repeats(df, hot), "n_words", "n_removed", "kept_sha256") == later_words(TEXTS, 20)
    monkeypatch.setattr(repeats, "RUN", 1)
    monkeypatch.setattr(repeats, "GATHERED", 2000)
    assert rows_of(radix_dedup.remove_repeats(df, hot), "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeated_bytes(TEXTS, 400)
    assert rows_of(substring_dedup.remove_repeats(df, hot), "n_words", "n_removed", "kept_sha256") == later_words(TEXTS, 20)


@pytest.mark.parametrize("module, unit, per_row", [(radix_dedup, "a", 5000), (radix_dedup, "hello worl ", 5000), (substring_dedup, "a ", 400), (substring_dedup, "a b c ", 400)])
def test_segments_are_few(spark, monkeypatch, module, unit, per_row):
    sent, found = [], repeats._found
    monkeypatch.setattr(repeats, "_found", lambda segments, *a: sent.append(segments) or found(segments, *a))
    text = unit * (1_000_000 // len(unit))
    row = module.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    if module is radix_dedup:
        assert (row.n_removed, row.n_spans) == (len(text), 1)
    else:
        assert row.n_words - row.n_removed == len(unit.split())  # the first window goes but for its start
    assert sum(x.count() for x in sent) < len(text) / per_row
