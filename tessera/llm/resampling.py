"""Importance resampling towards a target's distribution, by an external sort-count.

Words fall into hashed buckets. One pass writes them as a packed stream: a row has many documents'
buckets as uint16, two bytes a word, and where each document starts. Counts come from the streams:
each task sorts the buckets of a row and run-length encodes them, so at most a row a bucket leaves
it; rows of a bucket are summed map-side, then in one exchange. A bucket's gain is a whole number from
its counts in the corpus and in the target. The second pass reads the streams again, two bytes a
word, gathers gains by bucket and sums them by document with np.add.reduceat. The draw adds noise
of the document's number (Gumbel's, so that the highest sums are a draw without replacement) and
takes the highest; ranks come from a range sort and its partitions' sizes.

Defined results: a null or empty text, or one of separators only, has no features and weight 0; rows
that repeat are documents of their own, ranked one after the other; a null doc_id is drawn as an
empty number and comes first among ties; without a target, or without documents, counts are 0 and gains follow from that; texts
of any length go whole, SLICE bytes at a time; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import modest_batches, text_of, written
from .words import raw

BUCKETS, LONGEST = 10_000, 1
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Texts are cut into words so many bytes at a time; a worker remembers so many features' buckets.
SLICE, CACHE_ENTRIES = 1 << 20, 400_000

#: Letters and digits, and all beyond ASCII, are words; A-Z become a-z, the rest spaces.
_WORDS = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))


class _Buckets(dict):
    """A feature's bytes to its bucket, remembered while there is room."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        b = self[feature] = zlib.crc32(feature) % self.buckets
        return b


def stream(data: bytes, buckets: _Buckets, longest: int) -> np.ndarray:
    """The buckets of a text's features: all runs of up to `longest` words, joined by one space."""
    found, last, at = [], [], 0
    while at < len(data):
        to = at + SLICE
        while to < len(data) and _WORDS[data[to]] != 32:
            to += 1
        words = data[at:to].translate(_WORDS).split()
        found.append(np.fromiter(map(buckets.__getitem__, words), np.uint16, len(words)))
        for n in range(2, longest + 1):
            around = last[1 - n :] + words  # runs that end in this slice
            runs = [b" ".join(around[i : i + n]) for i in range(len(around) - n + 1)]
            found.append(np.fromiter(map(buckets.__getitem__, runs), np.uint16, len(runs)))
        last, at = (last + words)[-longest:], to
    return np.concatenate(found) if found else np.zeros(0, np.uint16)


def streams(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """A row for each batch of documents: ids, words (of each), offsets (with the end, in features)
    and their buckets, packed as little-endian uint16."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = _Buckets(buckets)
        for b in batches:
            data, offsets = raw(b.column(1))
            data = data.tobytes()
            parts = [stream(data[a:z], known, longest) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])
            packed = np.concatenate(parts).astype("<u2").tobytes() if parts else b""
            # A text of n words has n + (n - 1) + ... runs of up to `longest` words.
            arrays = [pa.array([b.column(0).to_pylist()], pa.list_(b.column(0).type)), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([packed], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["ids", "offsets", "packed"])

    modest_batches(docs.sparkSession)
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, f"ids array<{kind}>, offsets array<long>, packed binary")


def bucket_counts(packed: DataFrame) -> DataFrame:
    """bucket and n, from streams sorted and run-length encoded a row at a time."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for x in b.column(0):
                ordered = np.sort(np.frombuffer(x.as_py(), "<u2"))
                starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
                sizes = np.diff(np.r_[starts, len(ordered)])
                yield pa.RecordBatch.from_arrays([pa.array(ordered[starts].astype(np.int32)), pa.array(sizes.astype(np.int64))], ["bucket", "n"])

    return packed.select("packed").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket, in thousandths of a nat, rounded down."""
    s, t = (np.array([x.get(b, 0) for b in range(buckets)], np.float64) for x in (corpus, target))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _n_words(n_features: np.ndarray, longest: int) -> np.ndarray:
    """Words of texts by their features: the least number with that many runs."""
    w = np.arange(longest + 1)
    short = np.array([sum(max(0, int(x) - n + 1) for n in range(1, longest + 1)) for x in w])
    return np.where(n_features >= short[-1], longest + (n_features - short[-1]) // longest, np.searchsorted(short, n_features))


def weights(packed: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_features, n_words and weight: each stream's gains gathered, summed by document."""
    kind = packed.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for ids, offsets, stream_ in zip(b.column(0), b.column(1), b.column(2)):
                ends = offsets.values.to_numpy(zero_copy_only=False)
                each = gain[np.frombuffer(stream_.as_py(), "<u2")]
                n, total = np.diff(ends), np.zeros(len(ends) - 1, np.int64)
                some = n > 0  # reduceat gives an empty stretch its next element
                if some.any():
                    total[some] = np.add.reduceat(each, ends[:-1][some])
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(n), pa.array(_n_words(n, longest)), pa.array(total)], ["doc_id", "n_features", "n_words", "weight"])

    return packed.mapInArrow(run, f"doc_id {kind}, n_features long, n_words long, weight long")


def _noise(doc_id: Column, seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _counted(packed: DataFrame, buckets: int) -> dict[int, int]:
    return {r.bucket: r.n for r in bucket_counts(packed).collect()}  # a row a bucket: 65,536 at most


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each document; the drawn ones have ranks 1, 2, 3 ...
    by falling score, ties to the smaller doc_id, the others none. Drawn are percent of the
    documents that have least_words. target has doc_id and text."""
    packed = written(streams(docs, buckets, longest), "streams")
    gain = gains(_counted(packed, buckets), _counted(streams(target, buckets, longest), buckets), buckets)
    scored = weights(packed, gain, longest).withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))
    # Rows that are alike in all are one with a number of copies.
    same = ["doc_id", "n_features", "n_words", "weight", "score"]
    groups = written(scored.groupBy(*same).agg(F.count("*").alias("copies")), "scores")
    may = F.col("n_words") >= least_words
    n = groups.agg(F.sum(F.when(may, F.col("copies")))).first()[0] or 0
    drawn = percent * n // 100
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("n_features").asc(), F.col("weight").asc()]
    ranked = numbered(groups.where(may), order, F.col("copies"), "_before").select("doc_id", "n_features", "weight", "score", "copies", "_before")
    rest = groups.where(~may).select("doc_id", "n_features", "weight", "score", "copies", F.lit(None).cast("long").alias("_before"))
    blocks = ranked.unionByName(rest).withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    each = blocks.withColumn("_copy", F.explode(F.sequence("_first", F.least(F.col("_first") + COPIES, F.col("copies")) - 1)))
    rank = F.col("_before") + F.col("_copy") + 1
    return each.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


#: Copies of a row that are made from one array.
COPIES = 4096
