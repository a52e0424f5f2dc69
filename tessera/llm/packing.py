"""Best-fit decreasing packing of token sequences, exact at any size.

Where best fit decreasing puts documents depends on lengths alone, and lengths are whole
numbers up to the capacity. So the driver gets the histogram of lengths (at most `capacity`
rows) and runs best fit decreasing on runs of equal lengths and equal bins: a segment tree
over remaining capacities, whose leaves count the open bins with that capacity left, finds
the tightest capacity that fits in logarithmic time. The tightest bin stays the tightest
while it fits more of the same length, so a run of bins takes its floor(left / length)
documents each, just as one document at a time would go. Each placement is a rule (length,
ranks, first bin, documents per bin, offset); executors rank the documents of a length and
join them to the rules. The rules are bounded by the capacity, never by the documents.

Defined results: null and empty texts are documents of the end id alone; a text of any length is
encoded whole and cut only where it is over the capacity; rows that repeat a doc_id, or all of a
row, are documents of their own, and so are rows without doc_id; of pieces of equal length any may
come first; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import modest_batches, parts_for, text_of, written

#: Distinct words that a worker remembers before it starts anew.
CACHE_ENTRIES = 400_000
#: Rows ranked by one window group, at most, about.
RANK_ROWS = 50_000
PIECES = "doc_id {kind}, row_key long, piece int, start long, length long, ids_crc32 long"


class SegmentTree:
    """Counts over 0..size-1; `first_at_least(x)` is the least index >= x with a count."""

    def __init__(self, size: int):
        self.base = 1 << max(0, size - 1).bit_length()
        self.sums = [0] * (2 * self.base)

    def add(self, at: int, n: int) -> None:
        at += self.base
        while at:
            self.sums[at] += n
            at >>= 1

    def first_at_least(self, at: int) -> int | None:
        if at >= self.base:
            return None
        at += self.base
        if self.sums[at]:
            return at - self.base
        while at > 1:
            if not at & 1 and self.sums[at + 1]:  # what lies right of the path so far
                at += 1
                while at < self.base:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.base
            at >>= 1
        return None


def best_fit_rules(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first bin, documents per bin, offset in the bin) of each
    placement; ranks of a length count from 0."""
    tree, opened, bins, rules = SegmentTree(capacity + 1), {}, 0, []

    def put(left: int, first: int, n: int) -> None:
        if n:
            opened.setdefault(left, []).append((first, n))
            tree.add(left, n)

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.first_at_least(length)
            if left is None:
                left, each = capacity, capacity // length
                first, n = bins, -(-todo // each)
                bins += n
            else:
                each = left // length
                first, n = opened[left].pop()
                tree.add(left, -n)
                used = min(n, -(-todo // each))
                put(left, first + used, n - used)
                n = used
            full, part = divmod(todo, each) if n * each > todo else (n, 0)
            if full:
                rules.append((length, rank, full * each, first, each, capacity - left))
                put(left - each * length, first, full)
            if part:
                rules.append((length, rank + full * each, part, first + full, part, capacity - left))
                put(left - part * length, first + full, 1)
            placed = full * each + part
            rank, todo = rank + placed, todo - placed
    return rules


class _Ids(dict):
    """Word, with A-Z in lower case, to its ids as little-endian unsigned 32-bit bytes.

    A word of Latin-1 letters is one pre-token that the normalizer leaves alone, so it goes
    to the library's merges directly; so does one with a full stop or comma behind it, which
    the pre-tokenizer splits off. All other words go through the whole library."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        self.merges = self.library.model.tokenize
        self.marks = {x: self._whole(x) for x in (".", ",")}
        # The byte-level alphabet: bytes that do not print stand at 256 and up, in order.
        odd = [x for x in range(256) if x <= 32 or 127 <= x <= 160 or x == 173]
        self.shown = {x: 256 + i for i, x in enumerate(odd)}

    def _whole(self, word: str) -> bytes:
        return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, key: bytes) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if key.isalpha():
            ids = array("I", [x.id for x in self.merges(key.decode())]).tobytes()
        else:
            word = key.decode()
            if word.isalpha() and max(word) <= "\xff":
                shown = word.lower().encode().decode("latin-1").translate(self.shown)
                ids = array("I", [x.id for x in self.merges(shown)]).tobytes()
            elif word[-1] in self.marks and word[-2:-1].isalpha() and word[-2] <= "\xff":
                ids = self[word[:-1].encode()] + self.marks[word[-1]]
            else:
                ids = self._whole(word)
        self[key] = ids
        return ids


_ids: dict[str, _Ids] = {}


def word_ids(tokenizer_file: str) -> _Ids:
    """The tokenizer drops white space and merges within words only, so a text's ids are its
    words' ids in a row; it takes letters in lower case. Each distinct word goes to the library
    once while it is remembered."""
    if tokenizer_file not in _ids:
        _ids[tokenizer_file] = _Ids(tokenizer_file)
    return _ids[tokenizer_file]


def encoded(texts, ids: _Ids) -> Iterator[bytes]:
    for t in texts:
        yield b"".join(map(ids.__getitem__, t.as_py().encode().lower().split()))


def pieces_of(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of at most `capacity` tokens of each document, ids then the end id."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, end = word_ids(tokenizer_file), int(end_id).to_bytes(4, "little")
        for b in batches:
            rows: list[tuple] = []
            for i, data in enumerate(encoded(b.column(2), ids)):
                data += end
                view = memoryview(data)
                for p, at in enumerate(range(0, len(data), 4 * capacity)):
                    x = view[at : at + 4 * capacity]
                    rows.append((i, p, at // 4, len(x) // 4, zlib.crc32(x)))
            if rows:
                at, p, start, length, crc = (pa.array(x) for x in zip(*rows))
                arrays = [b.column(0).take(at), b.column(1).take(at), p.cast(pa.int32()), start, length, crc]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row_key", "piece", "start", "length", "ids_crc32"])

    modest_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64(F.monotonically_increasing_id()).alias("row_key"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, PIECES.format(kind=kind))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (doc_id, row_key, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    total = sum(histogram.values())
    rules = best_fit_rules(histogram, capacity)
    buckets = max(parts_for(spark), total // RANK_ROWS)
    # A row's pieces, and rows that repeat, part like any others.
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("row_key", "piece"), F.lit(buckets)).cast("int"))
    before = (
        keyed.groupBy("length", "bucket").count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    own = Window.partitionBy("length", "bucket").orderBy("row_key", "piece")
    ranked = (
        keyed.withColumn("own_rank", F.row_number().over(own) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("own_rank") + F.col("before"))
    )
    table = spark.createDataFrame(rules, "length long, first_rank long, ranks long, first_bin long, per_bin long, at long")
    rule = F.broadcast(  # one row a length, with its placements by first rank: bounded by the capacity
        table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "ranks", "first_bin", "per_bin", "at"))).alias("placements"))
    )
    mine = F.element_at(F.filter("placements", lambda p: (p["first_rank"] <= F.col("rank")) & (F.col("rank") < p["first_rank"] + p["ranks"])), 1)
    within = F.col("rank") - F.col("mine.first_rank")
    return ranked.join(rule, "length").withColumn("mine", mine).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("mine.first_bin") + F.floor(within / F.col("mine.per_bin"))).cast("long").alias("sequence_id"),
        (F.col("mine.at") + F.pmod(within, F.col("mine.per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    return pack(written(pieces_of(docs, tokenizer_file, capacity, end_id), "pieces"), capacity)
