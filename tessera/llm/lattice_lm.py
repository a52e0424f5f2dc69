"""Language-model scores of whole texts: word unigrams, and a subword lattice.

The lattice model takes the strings of an existing vocabulary as pieces. A word, with a space
mark before it, has the summed probability of all its segmentations into pieces, by forward
recursion in log space; characters that are no piece are spelt in byte pieces. No piece crosses
a word, so a text's probability is the product of its words' and of the end mark's.

The unigram probabilities of the pieces are learned from the training documents: each distinct
word's count goes to the pieces of its one segmentation by the vocabulary's own library (not to
all paths of the lattice), add-one smoothed. The scores in a merge-based vocabulary file are
merge ranks and no probabilities, so they can't serve as they are.

Steps, all bounded in memory by PIECE bytes of text or HELD words, however long a text is:

1. Count words. Tasks add up HELD distinct words before they send any, and Spark sums by word.
2. Each distinct word is cut once for the piece counts, and scored once on the lattice.
3. The words with the most occurrences are broadcast, COMMON at most, so documents are scored
   where they are read, but for their other words. Those leave as (key, row, times), meet the
   word table in a join by key, and come back as sums by row. A word's key is the word itself, or
   for words over LONG_WORD bytes their SHA-256, so keys are short and a long word can be common
   like any other: none in that join occurs as often as the common ones.

Defined results: null text counts as empty (the end alone); a null doc_id counts as the empty
text when folds are dealt; repeated rows are documents of their own, each with its row; texts
of any length are read whole, in pieces cut between words; without training documents N and V
are 0; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, text_of, written

#: Bytes of text that are cut into words at once, and distinct words that a task adds up.
PIECE, HELD = 1 << 20, 200_000
#: How many words are broadcast, and over how many bytes a hash stands for one of them.
COMMON, LONG_WORD = 100_000, 64
SPACE = "▁"
#: The end of a text in word counts; no word is empty.
END = b""


def pieces_of(text: bytes, size: int = 0) -> Iterator[bytes]:
    """text in pieces of about PIECE bytes, cut at white space."""
    import re

    size, at = size or PIECE, 0
    if len(text) <= size:
        yield text
        return
    space = re.compile(rb"[\x20\x09-\x0D]")
    while at < len(text):
        found = space.search(text, at + size)
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to


def key_of(word: bytes) -> bytes:
    """The word, or for a long one its hash, after a byte that no text holds."""
    return word if len(word) <= LONG_WORD else b"\xff" + hashlib.sha256(word).digest()


def _prepared(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.encode(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), "utf-8")) % 7 == 2
    return docs.select(docs["doc_id"], held.alias("held_out"), text_of(docs).cast("binary").alias("text"))


def _counts(rows: DataFrame) -> DataFrame:
    """word, n (in training documents), m (in all): partial sums, a word's end mark included."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = {True: Counter(), False: Counter()}  # by held_out

        def sums() -> Iterator:
            train, held = counts[False], counts[True]
            words = [*train, *(w for w in held if w not in train)]
            for at in range(0, len(words), 50_000):
                w = words[at : at + 50_000]
                n = [train.get(x, 0) for x in w]
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(n, pa.int64()), pa.array([x + held.get(y, 0) for x, y in zip(n, w)], pa.int64())], ["word", "n", "m"])
            train.clear()
            held.clear()

        for b in batches:
            for held, text in zip(b.column(0).to_pylist(), b.column(1)):
                own = counts[held]
                own[END] += 1
                for piece in pieces_of(text.as_py()):
                    own.update(piece.lower().split())
                    if len(counts[True]) + len(counts[False]) > HELD:
                        yield from sums()
        yield from sums()

    return rows.select("held_out", "text").mapInArrow(run, "word binary, n long, m long")


def _piece_counts(words: DataFrame, model_file: str) -> DataFrame:
    """piece, n: how often the library's cut of all training words gives each piece."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        total = np.zeros(library.get_piece_size(), np.int64)
        for b in batches:
            ids = library.encode([w.decode(errors="replace") for w in b.column(0).to_pylist()])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
            np.add.at(total, flat, np.repeat(b.column(1).to_numpy(), sizes))
        known = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known.astype(np.int32)), pa.array(total[known])], ["piece", "n"])

    return words.where((F.col("n") > 0) & (F.length("word") > 0)).select("word", "n").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))


class Lattice:
    """Unigram piece probabilities; `score` is a word's log10 probability over all its
    segmentations."""

    def __init__(self, model_file: str, counts: dict[int, int], ends: int):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = library.get_piece_size()
        total = math.log(sum(counts.values()) + ends + n + 1)
        log = {k: math.log(counts.get(k, 0) + 1) - total for k in range(n)}
        self.pieces = {library.id_to_piece(k): x for k, x in log.items() if not (library.is_control(k) or library.is_unknown(k) or library.is_byte(k))}
        self.bytes = [log[library.piece_to_id(f"<0x{k:02X}>")] for k in range(256)]
        self.end = (math.log(ends + 1) - total) / math.log(10)
        #: Each beginning of a piece, with the piece's log probability where it is one itself.
        self.edges: dict[str, float | None] = {}
        for piece, p in self.pieces.items():
            for k in range(1, len(piece)):
                self.edges.setdefault(piece[:k])
            self.edges[piece] = p

    def score(self, word: str) -> float:
        s, edges, exp, log = SPACE + word, self.edges, math.exp, math.log
        size = len(s)
        arrived = defaultdict(list)  # log probabilities of paths' last steps, by where they end, as far as a piece reaches
        at = 0.0
        for i in range(size):
            j = i + 1
            if s[i] not in self.pieces:
                arrived[j].append(at + sum(self.bytes[x] for x in s[i].encode()))
            while j <= size:
                p = edges.get(s[i:j], 1.0)
                if p is None:
                    pass
                elif p > 0:  # no piece begins so
                    break
                else:
                    arrived[j].append(at + p)
                j += 1
            terms = arrived.pop(i + 1)
            at = terms[0]
            if len(terms) > 1:
                top = max(terms)
                at = top + log(sum([exp(x - top) for x in terms]))
        return at / math.log(10)


def _scored(words: DataFrame, model_file: str, counts: dict[int, int], ends: int) -> DataFrame:
    """words, by their keys, with each one's lattice score."""
    given = words.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lattice = Lattice(model_file, given.value, ends)
        for b in batches:
            found = b.column(0).to_pylist()
            log_p = [lattice.score(w.decode(errors="replace")) for w in found]
            yield pa.RecordBatch.from_arrays([pa.array(map(key_of, found), pa.binary()), *b.columns[1:], pa.array(log_p, pa.float64())], ["word", "n", "m", "log_p"])

    return words.where(F.length("word") > 0).select("word", "n", "m").mapInArrow(run, "word binary, n long, m long, log_p double")


def _common(words: DataFrame) -> list[tuple[bytes, int, float]]:
    """word (its key), n and log_p of at most COMMON words, which occur more often than any other. Their least
    count comes from a histogram in steps of an eighth, so no task or driver holds more."""
    step = F.floor(F.log2(F.col("m").cast("double")) * 8).cast("int").alias("step")
    least, total = None, 0
    for r in words.where(F.col("m") > 1).groupBy(step).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        total += r.n
        if total > COMMON:
            break
        least = r.step
    if least is None:
        return []
    return [(bytes(r.word), r.n, r.log_p) for r in words.where((F.col("m") > 1) & (step >= least)).select("word", "n", "log_p").collect()]


PARTS = "row long, doc_id {}, held_out boolean, words long, known long, base double, score double, word binary, times long"


def _parts(rows: DataFrame, common: list[tuple[bytes, int, float]]) -> DataFrame:
    """For pieces of documents the sums over their common words (word is null), and their other
    words with how often each occurs."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    given = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shared = {w: k for k, (w, _, _) in enumerate(given.value)}
        n_shared = len(shared)
        n = np.array([x for _, x, _ in given.value] or [0], np.int64)
        log_c, log_p, is_known = np.log10(n + 1.0), np.array([x for _, _, x in given.value] or [0.0]), n > 0
        names = ["row", "doc_id", "held_out", "words", "known", "base", "score", "word", "times"]

        def sums(ids, held, row, at: list[int], found: list) -> Iterator:
            places, k = np.array(at), len(at)
            doc = np.repeat(np.arange(k), [len(x) for x in found])
            flat = np.concatenate([np.zeros(0, np.int32), *found])
            own = flat < n_shared
            d, w = doc[own], flat[own]
            add = lambda x: pa.array(np.bincount(d, x[w], k).astype(float))
            out = [pa.array(np.bincount(doc, minlength=k).astype(np.int64)), pa.array(np.bincount(d, is_known[w], k).astype(np.int64)), add(log_c), add(log_p)]
            yield pa.RecordBatch.from_arrays([row.take(pa.array(places)), ids.take(pa.array(places)), held.take(pa.array(places)), *out, pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], names)
            pairs, times = np.unique(doc[~own].astype(np.int64) << 32 | flat[~own], return_counts=True)
            if len(pairs):
                rare, _ = list(words)[n_shared:], words.clear()
                size = len(pairs)
                for s in range(0, size, 50_000):
                    p = pairs[s : s + 50_000]
                    word = pa.array([rare[x - n_shared] for x in (p & 0xFFFFFFFF).tolist()], pa.binary())
                    nothing = [pa.nulls(len(p), t) for t in (ids.type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([row.take(pa.array(places[p >> 32])), *nothing, word, pa.array(times[s : s + 50_000])], names)

        def fresh() -> dict:
            found = defaultdict(count(n_shared).__next__)
            found.update(shared)
            return found

        words = fresh()
        for b in batches:
            row, ids, held = b.column(0), b.column(1), b.column(2)
            at, found, size = [], [], 0
            for k, text in enumerate(b.column(3)):
                for piece in pieces_of(text.as_py()):
                    w = piece.lower().split()
                    if len(piece) > LONG_WORD and len(max(w, key=len, default=b"")) > LONG_WORD:
                        w = [*map(key_of, w)]
                    found.append(np.fromiter(map(words.__getitem__, w), np.int32, len(w)))
                    at.append(k)
                    size += len(w)
                    if size > HELD:
                        yield from sums(ids, held, row, at, found)
                        at, found, size, words = [], [], 0, fresh()
            if at:
                yield from sums(ids, held, row, at, found)
                words = fresh()

    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(run, PARTS.format(kind))


def lm_scores(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    modest_batches(docs.sparkSession)
    rows = _prepared(docs)
    words = written(_counts(rows).groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "words")
    n, v, ends = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.coalesce(F.max(F.when(F.length("word") == 0, F.col("n"))), F.lit(0))).first()
    pieces = {r[0]: r[1] for r in _piece_counts(words, model_file).collect()}  # bounded by the vocabulary
    scored = written(_scored(words, model_file, pieces, ends), "scored")
    common = _common(scored)
    parts = written(_parts(rows, common), "parts")
    floor, end = math.log10(n + v + 1), Lattice(model_file, pieces, ends).end

    times = F.col("times")
    rare = parts.where(F.col("word").isNotNull()).select("row", "word", "times").join(scored.select("word", "n", "log_p"), "word")
    kinds = {f.name: f.dataType for f in parts.schema}
    nothing = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    rare = rare.select(
        "row", nothing("doc_id"), nothing("held_out"), nothing("words"),
        F.when(F.col("n") > 0, times).otherwise(0).alias("known"), (times * F.log10(F.col("n") + F.lit(1.0))).alias("base"), (times * F.col("log_p")).alias("score"),
    )
    whole = parts.where(F.col("word").isNull()).select(rare.columns)
    sums = whole.union(rare).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("words", "known", "base", "score")))
    tokens = F.col("words") + 1
    return sums.select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + math.log10(ends + 1) - tokens * F.lit(floor)).alias("base_score"), (F.col("score") + end).alias("score"),
    )
