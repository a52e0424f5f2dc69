"""Long words in the language model: common ones are broadcast like any other, and scores are the same."""

import math
import tracemalloc

import pytest

from tessera.llm import lattice_lm
from tessera.llm.queries import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")
LONG, LONGER, ONCE = "ab" * 40, "Ü" * 50, "x" * 65


def test_a_long_word_of_many_documents_stays_where_it_is(spark, monkeypatch):
    sent, parts = [], lattice_lm._parts
    monkeypatch.setattr(lattice_lm, "_parts", lambda *a: sent.append(parts(*a)) or sent[-1])
    texts = {k: f"{LONG} w{k} {LONGER} {LONG.upper()}" for k in range(200)} | {200: ONCE, 201: LONG[:64]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in lattice_lm.lm_scores(df, MODEL).collect()}
    rare = [r.word for r in sent[0].where("word IS NOT NULL").collect()]
    assert len(rare) == 202 and sum(w.startswith(b"\xff") for w in rare) == 1  # w0 to w199 and the two others

    count = {}
    for k, t in texts.items():
        if not got[k].held_out:
            for w in [*t.lower().replace("Ü".lower(), "Ü").split(), ""]:
                count[w] = count.get(w, 0) + 1
    total, distinct = sum(count.values()), len(count)
    for k, t in texts.items():
        tokens = [*t.lower().replace("Ü".lower(), "Ü").split(), ""]
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(tokens), sum(w in count for w in tokens), total)
        assert got[k].base_score == pytest.approx(sum(math.log10((count.get(w, 0) + 1) / (total + distinct + 1)) for w in tokens), rel=1e-9)
    assert got[0].score == pytest.approx(got[1].score, abs=0.7)


def test_one_unbroken_word_takes_little_memory():
    lattice = lattice_lm.Lattice(MODEL, {}, 1)
    lattice.score("warm up")
    word = "qZ7" * 100_000
    tracemalloc.start()
    assert math.isfinite(lattice.score(word))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(word)
