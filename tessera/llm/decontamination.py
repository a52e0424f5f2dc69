"""Benchmark passages in documents, found by spaced seeds and verified with substitutions.

Words are runs of ASCII letters and digits or other characters, in lower case; punctuation
separates. Each mask of SEEDS hashes some word positions of a window and ignores the others.
Test and training windows with the same hash under the same mask are a hit, which fixes an
item and an alignment; the words around it are compared position by position. A document
holds an item where WINDOW words in a row agree in all but SUBSTITUTIONS places (an item of
fewer words, MIN_ITEM at least, must occur whole and unchanged). The two masks were chosen so
that every such window has an agreeing seed (a test tries all substitutions).

Equal items are taken once. A benchmark of BLOCK_WORDS words at most is broadcast and meets the
documents in one pass, without a shuffle. A larger one is never on the driver or in one task: its
seeds are a table, each with the words around it (a window holds its seed, so these decide every
window that the seed lies in), and are joined by seed with those of the documents. Document seeds
are first held against a map of the test side's, of 32 bits a seed and 2**MAP_BITS bits at most, so
few others travel. Windows are verified behind the join; only overlaps that were found meet the
documents a second time.

Defined results: null texts and items count as empty and match nothing; items under MIN_ITEM
words are not searched; a text of any length is searched whole; repeated rows of documents are
judged alike, each with its row, repeated items by id and text (a row each); items are never
cut, however long they or their words are; empty tables give no overlaps and drop nothing; other columns, whatever their names, and null ids pass `clean` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, modest_batches, text_of, written

SEEDS = ((0, 3, 7, 8, 9, 10), (0, 1, 2, 3, 5, 6))
WINDOW, SUBSTITUTIONS, MIN_ITEM = 13, 2, 7
BLOCK_WORDS, MAP_BITS = 200_000, 29
_FILTER_BITS = 22
#: Words kept of a seed's surroundings: from BEFORE words before its start, SPAN words. Every window of
#: WINDOW words that a seed of SEEDS lies in is within.
BEFORE, SPAN = WINDOW - 1 - min(m[-1] for m in SEEDS), 2 * WINDOW - 1 - min(m[-1] for m in SEEDS)
_SLICE = 1 << 16  # seeds of an Arrow batch


def seed_hashes(h, mask: tuple[int, ...]):
    """A hash of the mask's positions at each word where the mask fits; h: hashes of words."""
    import numpy as np

    from .words import U, mix

    n = max(0, len(h) - mask[-1])
    out = np.zeros(n, U)
    for p in mask:
        out *= U(0x2545F4914F6CDD1D)
        out += h[p : p + n]
    return mix(out)


class Index:
    """The seeds of some items. items: (key, text), keys being any values."""

    def __init__(self, items: list[tuple]):
        import numpy as np
        import pyarrow as pa

        from .words import NOT_ALNUM, U, word_hashes

        self.keys, self.words, seeds = [], [], [[] for _ in SEEDS]
        column = pa.array([t or "" for _, t in items], pa.string())
        for a, _, h, at in word_hashes(column, True, NOT_ALNUM):
            for k in range(len(at) - 1):
                own = h[at[k] : at[k + 1]]
                if len(own) >= MIN_ITEM:
                    self.keys.append(items[a + k][0])
                    self.words.append(own)
        self.seeds = []
        for mask in SEEDS:
            hs = [seed_hashes(w, mask) for w in self.words]
            h = np.concatenate([np.zeros(0, U), *hs])
            item = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
            at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in hs)])
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[(h >> U(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.seeds.append((mask, h[order], item[order], at[order], seen))

    def overlaps(self, h, at) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, first word in the text, words, words that agree) of the best overlap
        of each text and item; h: word hashes of texts, `at` where texts start."""
        import numpy as np

        from .words import U

        found = set()
        for mask, keys, items, places, seen in self.seeds:
            g = seed_hashes(h, mask)
            here = np.flatnonzero(seen[(g >> U(64 - _FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, g[here], "left"), np.searchsorted(keys, g[here], "right")
            here, lo, hi = (x[hi > lo] for x in (here, lo, hi))
            text = np.searchsorted(at, here, "right") - 1
            whole = here + mask[-1] < at[text + 1]
            for t, p, a, z in zip(text[whole].tolist(), here[whole].tolist(), lo[whole].tolist(), hi[whole].tolist()):
                found.update((t, i, p - q) for i, q in zip(items[a:z].tolist(), places[a:z].tolist()))
        best: dict = {}
        for t, i, shift in sorted(found):
            w = self.words[i]
            a, z = max(int(at[t]), shift), min(int(at[t + 1]), shift + len(w))
            need = min(WINDOW, len(w))
            if z - a < need:
                continue
            same = h[a:z] == w[a - shift : z - shift]
            sums = np.concatenate(([0], np.cumsum(same)))
            good = np.flatnonzero(sums[need:] - sums[:-need] >= (need - SUBSTITUTIONS if need == WINDOW else need))
            if len(good):
                s, e = int(good[0]), int(good[-1]) + need
                got = (e - s, int(sums[e] - sums[s]), -(a + s - int(at[t])))
                best[t, i] = max(best.get((t, i), got), got)
        for (t, i), (n, agree, start) in best.items():
            yield t, i, -start, n, agree


def _items(benchmark: DataFrame) -> DataFrame:
    """k, item_id of the rows of benchmark; k stands for their text."""
    return benchmark.where(benchmark["text"].isNotNull()).select(F.sha2(benchmark["text"].cast("string"), 256).alias("k"), benchmark["item_id"])


def _distinct(benchmark: DataFrame) -> DataFrame:
    """k, text of the distinct texts of benchmark."""
    texts = benchmark.where(benchmark["text"].isNotNull()).select(benchmark["text"].cast("string").alias("text")).distinct()
    return texts.select(F.sha2("text", 256).alias("k"), "text")


def _few(texts: DataFrame) -> list[tuple] | None:
    """(k, text) of all texts, if they have BLOCK_WORDS words at most."""
    words = F.length("text") / 2 + 1  # words and separators take a character each at least
    if (texts.agg(F.sum(words)).first()[0] or 0) > BLOCK_WORDS:
        return None
    return [(r[0], r[1]) for r in texts.orderBy("k").collect()]


def _seeds(texts: DataFrame, seen=None) -> DataFrame:
    """The seeds of texts (k, text): k, seed, at (its first word), near (the hashes of the words around
    it), before and after (how many of these are the text's, to the left of `at` and from it on) and
    size (the text's words, WINDOW at most). seen: a broadcast map; only seeds in it."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .words import NOT_ALNUM, U, mix, word_hashes

        around = np.arange(-BEFORE, SPAN - BEFORE)
        for b in batches:
            for a, _, h, starts in word_hashes(b.column(1), True, NOT_ALNUM):
                for j, mask in enumerate(SEEDS):
                    g = mix(seed_hashes(h, mask) + U(j + 1))
                    here = np.arange(len(g))
                    if seen is not None:
                        here = np.flatnonzero(_in_map(seen.value, g))
                    text = np.searchsorted(starts, here, "right") - 1
                    fits = here + mask[-1] < starts[text + 1]
                    here, text = here[fits], text[fits]
                    for x in range(0, len(here), _SLICE):
                        p, t = here[x : x + _SLICE], text[x : x + _SLICE]
                        near = h[np.clip(p[:, None] + around, 0, len(h) - 1)].astype("<u8")
                        offsets = (np.arange(len(p) + 1) * (8 * SPAN)).astype(np.int32)
                        first, size = starts[t], starts[t + 1] - starts[t]
                        yield pa.RecordBatch.from_arrays(
                            [
                                b.column(0).take(pa.array(a + t)),
                                pa.array(g[p].view(np.int64)),
                                pa.array(p - first),
                                pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer(offsets), pa.py_buffer(near.tobytes())]),
                                pa.array(np.minimum(p - first, BEFORE).astype(np.int32)),
                                pa.array(np.minimum(starts[t + 1] - p, SPAN - BEFORE).astype(np.int32)),
                                pa.array(np.minimum(size, WINDOW).astype(np.int32)),
                            ],
                            ["k", "seed", "at", "near", "before", "after", "size"],
                        )

    return texts.mapInArrow(run, "k string, seed long, at long, near binary, before int, after int, size int")


def _in_map(packed: tuple, g):
    """Which seeds may be in a map: two of its bits stand for each."""
    import numpy as np

    from .words import U

    bits, data = packed
    hit = np.ones(len(g), bool)
    for shift in (0, 64 - bits):
        place = ((g >> U(shift)) & U((1 << bits) - 1)).astype(np.int64)
        hit &= (data[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return hit


def _map(seeds: DataFrame) -> tuple:
    """bits, and 2**bits bits that tell which seeds there are, eight to a byte: 2**MAP_BITS / 8 bytes reach
    the driver at most."""
    import numpy as np

    bits = max(16, min(MAP_BITS, (32 * seeds.count()).bit_length()))
    low = F.lit((1 << bits) - 1)
    places = (F.col("seed").bitwiseAND(low), F.shiftrightunsigned("seed", 64 - bits).bitwiseAND(low))
    place = seeds.select("seed").distinct().select(F.explode(F.array(*(x + 1 for x in places))).alias("place"))  # the functions count from 1
    rows = place.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    data = np.zeros(1 << bits - 3, np.uint8)
    for r in rows.toLocalIterator():
        part = np.frombuffer(r.bits, np.uint8)
        at = (r.bucket - 1) * len(part)
        data[at : at + len(part)] = part[: len(data) - at]
    return bits, data


def _verified(batches: Iterator) -> Iterator:
    """Of seeds that met (k, item, at, item_at, and both sides' words), those with a window that agrees:
    k, item, shift (the item's start in the text), first and end of the windows in the text."""
    import numpy as np
    import pyarrow as pa

    from .words import raw

    place, starts = np.arange(SPAN), np.arange(SPAN - WINDOW + 1)
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        of = {name: b.column(x) for x, name in enumerate(b.schema.names)}
        doc, item = (raw(of[x])[0].view("<u8").reshape(n, SPAN) for x in ("near", "item_near"))
        number = {x: of[x].to_numpy() for x in ("at", "item_at", "before", "item_before", "after", "item_after", "item_size")}
        lo = BEFORE - np.minimum(number["before"], number["item_before"])
        hi = BEFORE + np.minimum(number["after"], number["item_after"])
        same = (doc == item) & (place >= lo[:, None]) & (place < hi[:, None])
        sums = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(same, axis=1)], axis=1)
        good = sums[:, WINDOW:] - sums[:, :-WINDOW] >= WINDOW - SUBSTITUTIONS
        good &= (starts >= lo[:, None]) & (starts + WINDOW <= hi[:, None])
        first, end = good.argmax(axis=1), SPAN - good[:, ::-1].argmax(axis=1)
        short = number["item_size"] < WINDOW
        whole = sums[:, -1] == number["item_size"]
        first = np.where(short, BEFORE - number["item_before"], first)
        end = np.where(short, first + number["item_size"], end)
        found = np.where(short, whole & (number["item_size"] >= MIN_ITEM), good.any(axis=1))
        zero = number["at"] - BEFORE
        yield pa.RecordBatch.from_arrays(
            [of["k"], of["item"], *(pa.array(x.astype(np.int64)) for x in (number["at"] - number["item_at"], zero + first, zero + end))],
            ["k", "item", "shift", "first", "end"],
        ).filter(pa.array(found))


def _windows(rows: DataFrame, texts: DataFrame, which: bool) -> DataFrame:
    """The windows of rows (k, text) that agree with one of texts (k, text): k, item, shift, first and end of
    each alignment, written. Unless which, items with equal words around a seed count once, and
    only k is returned, once."""
    spark = rows.sparkSession
    items = written(_seeds(texts), "item_seeds")
    shared = spark.sparkContext.broadcast(_map(items))
    own = items.select(
        "seed",
        *(F.col(x).alias(f"item_{x}") for x in ("near", "before", "after", "size")),
        *((F.col("k").alias("item"), F.col("at").alias("item_at")) if which else (F.lit("").alias("item"), F.lit(0).cast("long").alias("item_at"))),
    ).distinct()
    met = _seeds(rows, shared).drop("size").distinct().join(own.hint("shuffle_merge"), "seed").drop("seed")
    found = met.mapInArrow(_verified, "k string, item string, shift long, first long, end long")
    if which:
        found = found.groupBy("k", "item", "shift").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    else:
        found = found.select("k").distinct()
    found = written(found, "windows")
    shared.destroy()
    forget(items)
    return found


def _words(texts: DataFrame) -> DataFrame:
    """k and the hashes of the words of texts (k, text)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .words import NOT_ALNUM, word_hashes

        for b in batches:
            for a, z, h, starts in word_hashes(b.column(1), True, NOT_ALNUM):
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), lists], ["k", "words"])

    return texts.mapInArrow(run, "k string, words array<long>")


def _joined(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, k (the item), first_word, n_words, n_agree of rows (doc_id, text) and items, by joins."""
    keyed = rows.select("doc_id", F.sha2("text", 256).alias("k"), "text")
    found = _windows(keyed.select("k", "text"), texts, True)
    hit = written(keyed.join(found.select("k").distinct(), "k", "left_semi"), "hit")
    docs, items = _words(hit.select("k", "text").dropDuplicates(["k"])), _words(texts).withColumnRenamed("k", "item")
    part = lambda at: F.slice("words", (at + 1).cast("int"), (F.col("end") - F.col("first")).cast("int"))
    pairs = found.join(docs, "k").select(found["*"], part(F.col("first")).alias("own"))
    pairs = pairs.join(items, "item").withColumn("other", part(F.col("first") - F.col("shift")))
    agree = F.size(F.filter(F.zip_with("own", "other", lambda x, y: x == y), lambda x: x)).cast("long")
    best = F.max(F.struct((F.col("end") - F.col("first")).alias("n_words"), agree.alias("n_agree"), (-F.col("first")).alias("at"))).alias("best")
    one = pairs.groupBy("k", "item").agg(best)
    return hit.select("doc_id", "k").join(one, "k").select("doc_id", F.col("item").alias("k"), (-F.col("best.at")).alias("first_word"), "best.n_words", "best.n_agree")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words, n_agree: the longest overlap of each row of docs
    and item that overlap."""
    spark = docs.sparkSession
    modest_batches(spark)
    rows = docs.select(docs["doc_id"], text_of(docs).alias("text"))
    texts = _distinct(benchmark)
    few = _few(texts)
    if few is None:
        found = _joined(rows, texts)
    else:
        shared = spark.sparkContext.broadcast(few)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            from .words import NOT_ALNUM, word_hashes

            index = Index(shared.value)
            for b in batches:
                for a, _, h, at in word_hashes(b.column(1), True, NOT_ALNUM):
                    got = list(index.overlaps(h, at))
                    if got:
                        t, i, first, n, agree = zip(*got)
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array([a + x for x in t])), pa.array([index.keys[x] for x in i]), *(pa.array(x, pa.int64()) for x in (first, n, agree))],
                            ["doc_id", "k", "first_word", "n_words", "n_agree"],
                        )

        found = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k string, first_word long, n_words long, n_agree long")
    return found.join(_items(benchmark), "k").select("doc_id", "item_id", "first_word", "n_words", "n_agree")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item."""
    spark, place = docs.sparkSession, docs.columns.index("text")
    modest_batches(spark)
    texts = _distinct(benchmark)
    few = _few(texts)
    if few is None:
        key = F.sha2(text_of(docs), 256)
        found = _windows(docs.select(key.alias("k"), text_of(docs).alias("text")), texts, False)
        return docs.join(found, key == found["k"], "left_anti")
    shared = spark.sparkContext.broadcast(few)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .words import NOT_ALNUM, word_hashes

        index = Index(shared.value)
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for a, _, h, at in word_hashes(b.column(place).fill_null(""), True, NOT_ALNUM):
                keep[[a + t for t, *_ in index.overlaps(h, at)]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
