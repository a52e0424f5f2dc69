"""A benchmark of many items is joined by seeds and gives what the broadcast one gives."""

import random

from tessera.llm import decontamination


def passages(r, n, words):
    return [" ".join(f"w{r.randrange(3000)}" for _ in range(words)) for _ in range(n)]


def changed(r, words, n):
    words = list(words)
    for k in r.sample(range(len(words)), n):
        words[k] = f"x{r.randrange(10**6)}"
    return words


def test_joined_rows_equal_broadcast_rows(spark, monkeypatch):
    r = random.Random(6)
    items = list(enumerate(passages(r, 60, 40) + passages(r, 20, 9) + passages(r, 20, 7)))
    head = "which of the following is the best answer to the question that was asked above"
    items += [(100 + k, f"{head} {t}") for k, t in enumerate(passages(r, 20, 20))]
    docs = []
    for k in range(150):
        words = passages(r, 1, 60)[0].split()
        for _ in range(r.randint(0, 3)):
            own = r.choice(items)[1].split()
            a = r.randrange(max(1, len(own) - 13))
            at = r.randrange(len(words))
            words[at:at] = changed(r, own[a:], r.randint(0, 4))
        docs.append((k, " ".join(words)))
    docs += [(1000 + k, docs[3][1]) for k in range(40)] + [(2000, None), (2001, ""), (None, docs[4][1]), (7, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([*items, (500, items[0][1]), (501, None), (None, "")], "item_id long, text string").repartition(3)

    def both():
        rows = decontamination.contamination(df, bench).collect()
        kept = decontamination.clean(df, bench).collect()
        return sorted(map(str, rows)), sorted(map(str, kept))

    few = both()
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 10)
    assert both() == few and len(few[0]) > 150 and len(few[1]) > 20


def test_an_item_of_long_words_is_not_cut(spark):
    words = [f"{chr(97 + k % 26)}{k}" * 3000 for k in range(60)]
    item = " ".join(words)
    assert len(item) > 400_000
    docs = [(k, "before " + " ".join(words[k : k + 13]) + " after") for k in range(0, 47, 3)] + [(99, " ".join(words[5:15]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {(x.doc_id, x.first_word, x.n_words, x.n_agree) for x in decontamination.contamination(df, bench).collect()}
    # The words before and after stand where other words of the item would, two substitutions at most.
    assert got == {(0, 1, 14, 13)} | {(k, 0, 15, 13) for k in range(3, 47, 3)}
    assert [x.doc_id for x in decontamination.clean(df, bench).collect()] == [99]
