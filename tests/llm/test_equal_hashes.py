"""Near duplicates where different words have equal hashes."""

import pyarrow as pa
import pytest

from tessera.llm import minhash, words

ONE, TWO = "abcdefghopuezrzq", "eoontedp86f;p\\`<"


def text(*parts):
    return " ".join(parts)


def test_the_words_do_hash_alike():
    (_, _, h, _), = words.word_hashes(pa.array([text(ONE, TWO)]))
    assert h[0] == h[1]


@pytest.mark.parametrize("second", [TWO, "another"])
def test_counts_and_links_are_of_words(spark, second):
    same = ["x1", "x2", "x3", "x4"]
    a = [ONE, *same, second, *same, *(f"y{k}" for k in range(11))]
    docs = [(1, text(*a)), (2, text(*a, "z1", "z2", "z3")), (3, text(TWO, *same, *(f"q{k}" for k in range(9)))), (4, text(ONE, *same, *(f"q{k}" for k in range(9))))]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 85).collect()}
    assert got[1] == (17, 1, True) and got[2] == (20, 1, False)
    assert got[3] == (10, 3, True) and got[4] == (10, 4, True)  # 9 of 11 in common, 10 by hashes


def test_distinct_windows_of_repetitive_texts():
    for t in ("a " * 400, "a b c d e f " * 50, text(ONE, TWO) + " " + text(TWO, ONE), " ".join(map(str, range(90)))):
        w = t.encode().split()
        for n in (1, 2, 5):
            (_, found, size), = minhash.shingle_sets(pa.array([t.encode()], pa.binary()), n)
            assert size == (len({tuple(w[k : k + n]) for k in range(len(w) - n + 1)}) if len(w) >= n else 1) >= len(found)
