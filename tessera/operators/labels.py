"""Label vocabulary of the training partition, and encoding by it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import on_workers
from ..contracts import EncodedLabels, LabelConfig, LabelContract, LabelFitAudit, LabelTransformAudit, require
from ..functions.hashing import canonical_json, vocabulary_digest
from ..functions.identifiers import is_native_code, stripped
from ..sources.staging import materialized
from .ordering import numbered

#: A contract's vocabulary is collected and sent to all executors; a larger one is a table.
MOST_LABELS = 500_000


def label_support(examples: DataFrame) -> DataFrame:
    """label and the number of admissions that have it."""
    one = examples.select(F.explode(F.array_distinct(F.transform("labels", stripped))).alias("label"))
    return one.groupBy("label").agg(F.count("*").alias("support"))


def indexed(support: DataFrame, minimum: int) -> DataFrame:
    """label_index, label, support of the labels that reach minimum, in order of label; places come
    from a range sort, so no task sees all labels."""
    kept = numbered(support.where(F.col("support") >= minimum), [F.col("label").asc()], name="label_index")
    return kept.withColumn("label_index", F.col("label_index").cast("int"))


@dataclass(frozen=True)
class LabelTable:
    """A vocabulary of any size: labels has label_index, label and support. Its hash is that of the
    LabelContract with the same labels."""

    labels: DataFrame
    vocabulary_hash: str
    audit: LabelFitAudit


def table_digest(labels: DataFrame) -> str:
    """vocabulary_digest of a table's labels, which are native codes. A digest has one order, so one
    task streams the labels, sorted with spilling; it holds none but the last batch."""
    on_workers(labels.sparkSession)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        digest, first = hashlib.sha256(b"["), True
        for b in batches:
            words = b.column(0).to_pylist()
            if words:
                digest.update(("" if first else ",").encode() + canonical_json(words)[1:-1].encode())
                first = False
        digest.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["digest"])

    return labels.select("label").repartition(1).sortWithinPartitions("label").mapInArrow(work, "digest string").first()[0]


def _checked(examples: DataFrame) -> int:
    """The examples, all of the training partition, one an admission, with native codes."""
    bad, n, distinct, invalid = examples.agg(
        F.count_if(~F.col("partition").eqNullSafe("train")), F.count("*"), F.count_distinct("hadm_id"),
        F.count_if(F.exists("labels", lambda x: ~is_native_code(stripped(x)))),
    ).first()
    require(
        (bad == 0, "label vocabulary fitting accepts training examples only"),
        (n == distinct, "duplicate_training_admission"),
        (invalid == 0, "invalid native ICD-9 code in training labels"),
    )
    return n


def fit_label_table(examples: DataFrame, config: LabelConfig) -> LabelTable:
    """fit_training_label_contract without a vocabulary on the driver."""
    n = _checked(examples)
    labels = materialized(indexed(label_support(examples), config.minimum_support).select("label_index", "label", "support"), "labels")
    size = labels.count()
    require((size > 0, "training label selection produced an empty vocabulary"))
    return LabelTable(labels, table_digest(labels), LabelFitAudit(n, size))


def fit_training_label_contract(examples: DataFrame, config: LabelConfig) -> LabelContract:
    """The vocabulary as a value on the driver; one of over MOST_LABELS labels is for
    fit_label_table."""
    n = _checked(examples)
    kept = label_support(examples).where(F.col("support") >= config.minimum_support).select("label").limit(MOST_LABELS + 1).collect()
    require((len(kept) <= MOST_LABELS, f"vocabulary has more than {MOST_LABELS} labels: fit_label_table takes any number"), (len(kept) > 0, "training label selection produced an empty vocabulary"))
    vocabulary = tuple(sorted(r[0] for r in kept))
    return LabelContract(config.selection, config.minimum_support, vocabulary, vocabulary_digest(vocabulary), LabelFitAudit(n, len(vocabulary)))


def _vocabulary(examples: DataFrame, contract: LabelContract) -> DataFrame:
    return examples.sparkSession.createDataFrame(list(enumerate(contract.vocabulary)), "label_index int, label string")


def long_labels(examples: DataFrame, contract: LabelContract) -> DataFrame:
    """hadm_id, label, label_index (null if unknown), once for each distinct label."""
    one = examples.select("hadm_id", F.explode(F.array_distinct(F.transform("labels", stripped))).alias("label"))
    return one.join(F.broadcast(_vocabulary(examples, contract)), "label", "left")  # MOST_LABELS rows at most


def transform_labels(examples: DataFrame, contract: LabelContract) -> EncodedLabels:
    """Each example's labels as 0s and 1s over the vocabulary; unknown labels are counted."""
    names = F.lit(list(contract.vocabulary))
    clean = F.array_distinct(F.transform("labels", stripped))
    known = examples.withColumn("_clean", clean).withColumn("_unknown", F.size(F.array_except("_clean", names)))
    n, unknown, some = known.agg(F.count("*"), F.coalesce(F.sum("_unknown"), F.lit(0)), F.count_if(F.col("_unknown") > 0)).first()
    rows = known.withColumn("encoded", F.transform(names, lambda x: F.array_contains("_clean", x).cast("int"))).drop("_clean", "_unknown")
    return EncodedLabels(rows, contract.vocabulary_hash, LabelTransformAudit(n, unknown, some), checked=True)


@dataclass(frozen=True)
class SparseLabels:
    """rows: hadm_id and indices, the places of its ones among `width` labels, in order. A row is as
    long as its labels."""

    rows: DataFrame
    width: int
    vocabulary_hash: str
    audit: LabelTransformAudit


def sparse_labels(examples: DataFrame, table: LabelTable) -> SparseLabels:
    """transform_labels by a join with the vocabulary, which Spark broadcasts if it is small and
    deals by label, splitting hot ones, if it isn't."""
    one = examples.select("hadm_id", F.explode_outer(F.array_distinct(F.transform("labels", stripped))).alias("label"))
    found = one.join(table.labels.select("label", "label_index"), "label", "left")
    unknown = F.col("label").isNotNull() & F.col("label_index").isNull()
    rows = materialized(found.groupBy("hadm_id").agg(F.array_sort(F.collect_list("label_index")).alias("indices"), F.count_if(unknown).alias("unknown")), "sparse")
    n, all_unknown, some = rows.agg(F.count("*"), F.coalesce(F.sum("unknown"), F.lit(0)), F.count_if(F.col("unknown") > 0)).first()
    return SparseLabels(rows.select("hadm_id", "indices"), table.audit.vocabulary_size, table.vocabulary_hash, LabelTransformAudit(n, all_unknown, some))


def dense(indices: Column, width: int) -> Column:
    """Indices as 0s and 1s, for those who want them whole."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array_contains(indices, i).cast("int"))
