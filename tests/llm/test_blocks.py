"""Open buckets: links inside blocks, with texts only for members that have a likely partner."""

import random

from tessera.llm import minhash

PERCENT, N = 85, 5


def family(r, size, changes):
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    for _ in range(size):
        words = list(base)
        for _ in range(r.randint(0, changes)):
            words[r.randrange(len(words))] = f"v{r.randrange(10**6)}"
        yield " ".join(words)


def smallest_reachable(texts):
    shingles = {}
    for k, t in texts.items():
        words = t.split()
        shingles[k] = {tuple(words[i : i + N]) for i in range(len(words) - N + 1)}
    of = {k: k for k in texts}
    for a in texts:
        for b in texts:
            if a < b and 100 * len(shingles[a] & shingles[b]) >= PERCENT * len(shingles[a] | shingles[b]) and of[a] != of[b]:
                low, high = sorted((of[a], of[b]))
                of = {k: low if c == high else c for k, c in of.items()}
    return of


def test_links_across_blocks(spark, monkeypatch):
    r = random.Random(23)
    rows = [t for changes in (2, 3, 4, 5, 6, 8) for t in family(r, 25, changes)]
    r.shuffle(rows)
    texts = dict(enumerate(rows))
    want = smallest_reachable(texts)
    assert 6 < len(set(want.values())) < len(texts)  # neither all linked nor none
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    sent, by_block = [], minhash._by_block
    monkeypatch.setattr(minhash, "_by_block", lambda rows, *a: sent.append(rows) or by_block(rows, *a))
    for size in (512, 4):
        sent.clear()
        monkeypatch.setattr(minhash, "BLOCK", size)
        got = {x.doc_id: x.component_id for x in minhash.near_duplicates(df, PERCENT).collect()}
        assert got == want
        first, second = (x.count() for x in sent)
        assert "z" not in sent[0].columns and 0 < second < first
