"""The corpus pipeline: five stages over `documents`, each by one operator of tessera.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents, whatever
else these hold; columns that share a name with something a stage computes keep their values.
Every stage reads whole texts of any length, takes an empty table, null texts, null doc_ids and
repeated rows as its docstring says, and decides alike on equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, minhash, packing, quality_rules, secret_scan
from tessera.llm.common import table, written
from tessera.llm.queries import vocabulary

NEAR_PERCENT, SEQUENCE_TOKENS, END_ID = 80, 4096, 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the rules learned from `labels` keep. A null or empty
    text has no words and goes; a document without doc_id, or with one that repeats, is judged by
    its own text; without labels only the base rules decide."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, a similarity of 0.8 or more) the document of
    smallest doc_id. Rows that repeat that doc_id stay with it; a document without doc_id or
    without words stays."""
    return minhash.keep_one(docs, NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of `benchmark`. Null texts and items match nothing, and an
    empty benchmark drops nothing."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars counted again; a null text stays null."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its place in a sequence of SEQUENCE_TOKENS tokens. A null
    text is the end token alone; rows that repeat are documents of their own; an empty table has no
    pieces."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), SEQUENCE_TOKENS, END_ID)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("pack", pack),
]

#: No SQL can express learned rules, MinHash groups or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
