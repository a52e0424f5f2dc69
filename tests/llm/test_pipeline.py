"""The pipeline's stages on a small folder of tables with planted cases."""

import random

import corpus_pipeline
import pytest

from tessera.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choice("er on an ti nd ou ing re".split()) for _ in range(2)) for _ in range(n))
    clean = [prose(120) for _ in range(60)]
    junk = [" ".join(w + "###" for w in prose(80).split()) for _ in range(30)]
    item = prose(40)
    texts = clean + junk + [clean[0], clean[1] + " more", prose(40) + " " + item + " " + prose(40), prose(60) + " password=abcdef0123456789abcdef " + prose(10), None, ""]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60)) for i in range(0, 90)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(seen["quality"]) == {*range(60), 90, 91, 92, 93}
    assert set(seen["near_dedup"]) == {*range(60), 92, 93}
    assert set(seen["decontaminate"]) == {*range(60), 93}
    assert "[SECRET]" in seen["redact_secrets"][93] and all(seen["redact_secrets"][i] == seen["quality"][i] for i in range(60))
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == {*range(60), 93} and all(r.offset + r.length <= 4096 for r in packed)


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables; then null ids, null texts, repeated rows and columns of the stages' own names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, _row int, component_id string, k string, row int, piece string"
    words = lambda k: " ".join(f"word{k}x{j}" for j in range(60))
    own = ("en", "s", 1, "mine", 7, "c", "key", 3, "p")
    rows = [(1, words(1), *own), (1, words(1), *own), (1, words(2), *own), (None, words(3), *own), (None, words(3), *own), (2, None, *own), (3, "", *own), (4, words(1), *own), (5, words(5) + " token=abcdefabcdef0123456789", *own)]
    for name, some in (("none", []), ("odd", rows)):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, path)
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
            seen[stage] = docs.collect()
            assert all((r.n_words, r._row, r.component_id, r.k, r.row, r.piece) == ("mine", 7, "c", "key", 3, "p") for r in seen[stage])
        ids = lambda stage: sorted((r.doc_id or 0 for r in seen[stage]))
        packed = corpus_pipeline.run(spark, path).collect()
        if not some:
            assert not any(seen.values()) and not packed
            continue
        assert ids("quality") == [0, 0, 1, 1, 1, 4, 5] and ids("near_dedup") == ids("decontaminate") == ids("redact_secrets") == [0, 0, 1, 1, 1, 5]
        assert [r.text for r in seen["redact_secrets"] if r.doc_id == 5] == [words(5) + " [SECRET]"]
        assert sorted(r.doc_id or 0 for r in packed) == ids("redact_secrets")


def test_every_operator_is_registered():
    assert sorted(int(x[2:].split("_")[0]) for x in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)
