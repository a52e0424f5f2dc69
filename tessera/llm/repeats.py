"""Repeated windows of tokens over a whole table: what substring and radix dedup share.

A window is `width` tokens in a row of one text. Its anchor is the least hash among the
stretches of some shorter length in it (the leftmost of equal ones), so equal windows have
equal anchors at equal places, and neighbouring windows mostly share one. Where a text repeats itself
at a short distance (a ruler, zeros, padding), neighbouring windows have different anchors of one
hash; they are one run, too, of RUN times the windows of one anchor at most. Such a run can hold
equal windows itself, so the Finder looks at it even where it is alone, and what is left to send of
it is one window for each place of the period. Steps:

1. Each text's anchors, with the run of windows each stands for, go to their hash's task,
   which keeps those that occur twice. Within a batch, equal hashes are known to repeat, so
   one of them is sent and the others pass by, spread over all tasks: no key gets more rows
   than there are batches. An anchor that occurs once has no repeated window.
2. Texts join their repeated anchors, and each run of windows becomes a segment: the text under
   it. Before segments leave a task, a `Finder` looks for equal windows among those at hand, a
   memory-sized set at a time; all but one of equal windows end here, and segments lose them.
3. Segments meet by anchor, and the Finder settles whole groups, a memory-sized set at a time.
   A group of more than `Tokens.hot` anchors is dealt to several tasks first; what each leaves of it
   goes on under the anchors of longer stretches (`Tokens.grams`, the last being whole windows),
   until no group is larger. Equal windows shrink by the number a task holds, and different
   ones part, so this ends; the Finder decides in the same way each time.
4. Texts join the stretches to remove: runs of neighbouring windows, not windows.

Anchors and their hashes only decide what meets; that windows are equal is the Finder's to
say, on the tokens themselves. Texts travel compressed.

A document is a (doc_id, text): rows that repeat both are one document, read once and
each given its result; rows that share a doc_id but not the text are documents of their own
(ordered by a hash of the text). Rows without doc_id take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, text_of, written

#: Bytes of segments that a task gathers before it looks for equal windows among them.
GATHERED = 4_000_000
_BITS = 21
CHUNK_TOKENS = 1 << 20
#: How many times the windows of one anchor a run of anchors of one hash has at most.
RUN = 64


@dataclass(frozen=True)
class Tokens:
    """How texts are cut. `grams` are the lengths of stretches that anchor windows, from the first
    to the whole window; `hashes(column)` yields (first row, end row, token hashes or bytes, where
    rows start); `stretches(tokens, n)` the hash of the n tokens from each on; `cut(text)` a function
    from token positions to bytes; `part(body, a, z)` the same for a segment. A Finder gets about
    `at_once` bytes of segments (whole groups) at a time; groups of more than `hot` anchors are dealt
    to several tasks first."""

    width: int
    grams: tuple[int, ...]
    hashes: Callable
    stretches: Callable
    cut: Callable
    part: Callable
    at_once: int
    hot: int


def sliding_min(x, n: int):
    import numpy as np

    have = 1
    while 2 * have <= n:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if have < n else x


def reach(kind: Tokens, level: int = 0) -> int:
    """How many windows in a row one anchor can stand for."""
    return kind.width - kind.grams[min(level, len(kind.grams) - 1)] + 1


def anchors(tokens, at, kind: Tokens, level: int = 0):
    """(text, hash, first window, last window, places of anchors) arrays; tokens of texts in a row, `at`
    where they start, with the end."""
    import numpy as np

    from .words import U, mix

    found = []
    gram = kind.grams[min(level, len(kind.grams) - 1)]
    most = reach(kind, level)
    total = len(tokens)
    live = np.zeros(total + 1, np.int32)
    sizes = np.diff(at)
    long = np.flatnonzero(sizes >= kind.width)
    np.add.at(live, at[long], 1)
    np.add.at(live, at[long + 1] - kind.width + 1, -1)
    live = np.cumsum(live[:-1]) > 0
    mask = U((1 << _BITS) - 1)
    for s in range(0, total, CHUNK_TOKENS):
        part = tokens[s : s + CHUNK_TOKENS + kind.width - 1]
        g = kind.stretches(part, gram)
        if len(g) < most:
            break
        least = sliding_min((g & ~mask) | np.arange(len(g), dtype=U), most)[:CHUNK_TOKENS]
        place = (least & mask).astype(np.int64)
        ok = live[s : s + len(place)]
        moved = np.concatenate(([True], (place[1:] != place[:-1]) | (ok[1:] != ok[:-1])))
        edge = np.flatnonzero(moved)
        h = g[place[edge]]
        same = np.concatenate(([False], (h[1:] == h[:-1]) & ok[edge[1:]] & ok[edge[1:] - 1]))
        if same.any():  # one run, cut where it would be too long
            start = np.maximum.accumulate(np.where(same, 0, edge))
            nth = (edge - start) // (RUN * most)
            same &= np.concatenate(([False], nth[1:] == nth[:-1]))
        place_of = np.flatnonzero(~same)
        places = np.diff(np.append(place_of, len(edge)))
        first, h = edge[place_of], h[place_of]
        last = np.append(first[1:], len(place)) - 1
        own = ok[first]
        first, last, h, places = first[own], last[own], h[own], places[own]
        text = np.searchsorted(at, s + first, "right") - 1
        found.append((text, mix(h + U(level)) if level else h, s + first - at[text], s + last - at[text], places))
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate(x) for x in zip(*found))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, v, text (bytes) of the rows with a doc_id; v tells apart texts that share one."""
    rows = docs.where(docs["doc_id"].isNotNull()).select(docs["doc_id"], text_of(docs).cast("binary").alias("text"))
    shared = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return rows.select("doc_id", (F.lit(0).cast("long") if shared.isEmpty() else F.xxhash64("text")).alias("v"), "text")


def _anchor_rows(rows: DataFrame, kind: Tokens) -> DataFrame:
    """part, h, doc_id, v, first, last, n, own: runs of anchors with the key they go to; n counts a
    batch's equal ones for the one that is sent, whose hash is the key itself (h is null), and is 0 for
    others; own: several places have the anchor, so the run counts for as many as its length makes it."""
    doc_kind, most = rows.schema["doc_id"].dataType.simpleString(), reach(kind)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .words import U, mix

        for b in batches:
            got = [(a + t, *rest) for a, _, tokens, at in kind.hashes(b.column(2)) for t, *rest in [anchors(tokens, at, kind)] if len(t)]
            if not got:
                continue
            row, h, first, last, places = (np.concatenate(x) for x in zip(*got))
            weight = np.where(places > 1, 1 - (first - last - 1) // most, 1)
            _, where, same = np.unique(h, return_index=True, return_inverse=True)
            n = np.zeros(len(h), np.int64)
            n[where] = np.bincount(same, weight).astype(np.int64)
            part = np.where(n > 0, h, mix(h + np.arange(len(h), dtype=U)))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.view(np.int64)), pa.array(h.view(np.int64), mask=n > 0), b.column(0).take(row), b.column(1).take(row), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(places > 1)],
                ["part", "h", "doc_id", "v", "first", "last", "n", "own"],
            )

    return rows.mapInArrow(run, f"part long, h long, doc_id {doc_kind}, v long, first int, last int, n int, own boolean")


def _repeated(rows: DataFrame, doc_kind: str) -> DataFrame:
    """h, doc_id, v, first, last, own, total of the anchors that occur twice or more; total is null for
    those that passed by."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["h", "doc_id", "v", "first", "last", "own", "total"]

        def decided(x: pa.Table) -> pa.Table:
            part, n = x.column("part").to_numpy(), x.column("n").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            sizes = np.diff(np.append(edge, len(part)))
            total = np.repeat(np.add.reduceat(n.astype(np.int64), edge), sizes)
            keep = (n == 0) | (total > 1)
            own = pa.array(np.where(n == 0, x.column("h").fill_null(0).to_numpy(), part))
            out = x.select(["doc_id", "v", "first", "last", "own"]).append_column("h", own).append_column("total", pa.array(total, mask=n == 0))
            return out.filter(pa.array(keep)).select(names).combine_chunks()

        rest = None
        for b in batches:
            x = pa.Table.from_batches([b])
            x = pa.concat_tables([rest, x]) if rest is not None else x
            part = x.column("part").to_numpy()
            edge = int(np.searchsorted(part, part[-1]))
            if edge:
                yield from decided(x.slice(0, edge)).to_batches()
            rest = x.slice(edge)
        if rest is not None and rest.num_rows:
            yield from decided(rest).to_batches()

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, f"h long, doc_id {doc_kind}, v long, first int, last int, own boolean, total long")


def packed_texts(rows: DataFrame) -> DataFrame:
    """The rows with their last column, a text without nulls, compressed by zstd as z."""
    *others, text = rows.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([squeeze(t.as_py()) for t in b.column(len(others))], pa.binary())], [*others, "z"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.select(*others, F.col(text).cast("binary")).mapInArrow(run, ", ".join([*kinds, "z binary"]))


#: A segment to look at, or (body is null) a stretch of windows to remove, with any h.
SEGMENT = "h long, salt int, salts int, doc_id {}, v long, first int, last int, body binary"
NAMES = ["h", "salt", "salts", "doc_id", "v", "first", "last", "body"]


def _types(doc_type) -> list:
    import pyarrow as pa

    return [pa.int64(), pa.int32(), pa.int32(), doc_type, pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _runs(segment, window):
    """Where runs of neighbouring windows of a segment start and end; the arrays are sorted."""
    import numpy as np

    edge = np.flatnonzero(np.concatenate(([True], (segment[1:] != segment[:-1]) | (window[1:] != window[:-1] + 1))))
    return edge, np.append(edge[1:], len(segment)) - 1


def _stretch_rows(x, segment, first, last):
    """Rows of stretches to remove: of table x's segments, windows first to last."""
    import numpy as np
    import pyarrow as pa

    from .words import U, mix

    own = pa.array(segment)
    ids, v = x.column("doc_id").combine_chunks().take(own), x.column("v").combine_chunks().take(own)
    spread = mix(v.to_numpy().astype(U) + first.astype(U) * U(0x9E3779B97F4A7C15) + np.arange(len(first), dtype=U))
    cols = [pa.array(spread.view(np.int64)), pa.array(np.zeros(len(first), np.int32)), pa.array(np.ones(len(first), np.int32)), ids, v]
    return pa.RecordBatch.from_arrays([*cols, pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.nulls(len(first), pa.binary())], NAMES)


def _order_of(x):
    """The order of each segment's document among those of table x, equal documents alike."""
    import numpy as np

    _, rank = np.unique(x.column("doc_id").to_numpy(), return_inverse=True)
    v = x.column("v").to_numpy()
    order = np.lexsort((v, rank))
    new = np.concatenate(([0], (rank[order][1:] != rank[order][:-1]) | (v[order][1:] != v[order][:-1])))
    out = np.empty(len(v), np.int64)
    out[order] = np.cumsum(new)
    return out


def _settled(x, kind: Tokens, keep_first: bool, finder: Callable):
    """(stretches to remove or None, table of the segments with one of each of equal windows)."""
    import numpy as np
    import pyarrow as pa

    doc, first = _order_of(x), x.column("first").to_numpy()
    order = np.lexsort((first, doc))  # so windows are numbered in the order of documents and places
    x, doc, first = x.take(pa.array(order)).combine_chunks(), doc[order], first[order]
    node, window = finder(x.column("body").combine_chunks())
    if not len(node):
        return None, x
    key = np.sort(node << 32 | window)
    node, window = key >> 32, key & 0xFFFFFFFF
    sizes = x.column("last").to_numpy() - first + 1
    base = np.cumsum(sizes) - sizes
    place = np.repeat((doc << 32) + first - base, sizes)
    place += np.arange(len(place))
    start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    counts = np.diff(np.append(start, len(node)))
    same = place[window] == np.repeat(place[window[start]], counts)  # the first itself, or a repeated row's
    gone = ~same if keep_first else np.repeat(np.logical_or.reduceat(~same, start), counts)
    segment = np.repeat(np.arange(len(sizes)), sizes)
    stretches = None
    if gone.any():
        at = np.sort(window[gone])
        i, j = _runs(segment[at], at)
        own = segment[at[i]]
        stretches = _stretch_rows(x, own, first[own] + at[i] - base[own], first[own] + at[j] - base[own])

    left = np.ones(len(place), bool)
    left[window] = False
    left[window[start]] = True
    at = np.flatnonzero(left)
    i, j = _runs(segment[at], at) if len(at) else (at, at)
    own = segment[at[i]]
    a, b = at[i] - base[own], at[j] - base[own]
    kept = x.take(pa.array(own))
    bodies, whole = kept.column("body").to_pylist(), (b - a + 1 == sizes[own]).tolist()
    bodies = [y if all_of else kind.part(y, p, q + kind.width) for y, all_of, p, q in zip(bodies, whole, a.tolist(), b.tolist())]
    cols = [kept.column(c) for c in NAMES[:5]] + [pa.array((first[own] + a).astype(np.int32)), pa.array((first[own] + b).astype(np.int32)), pa.array(bodies, pa.binary())]
    return stretches, pa.table(cols, names=NAMES)


def _sets(x, at_once: int, own=None) -> Iterator:
    """Table x, sorted by h and salt, in whole groups of two segments or more (or of one that may hold
    equal windows itself: own), about at_once bytes at a time; and the segments that are alone, as
    (table, alone)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    h, salt = x.column("h").to_numpy(), x.column("salt").to_numpy()
    edge = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]))))
    sizes = np.diff(np.append(edge, len(h)))
    looked_at = (sizes > 1) | (np.logical_or.reduceat(own, edge) if own is not None else False)
    many = np.repeat(looked_at, sizes)
    if not many.all():
        yield x.filter(pa.array(~many)), True
    if not many.any():
        return
    x, sizes = x.filter(pa.array(many)).combine_chunks(), sizes[looked_at]
    nbytes = np.cumsum(pc.binary_length(x.column("body")).to_numpy().astype(np.int64))
    ends = np.cumsum(sizes)
    at = done = 0
    while at < len(ends):
        to = max(int(np.searchsorted(nbytes[ends - 1], done + at_once)), at + 1)
        start = ends[at - 1] if at else 0
        yield x.slice(start, ends[to - 1] - start), False
        at, done = to, nbytes[ends[to - 1] - 1]


def _segments(texts: DataFrame, lists: DataFrame, doc_kind: str, kind: Tokens, keep_first: bool, finder: Callable) -> DataFrame:
    """Segments, with stretches that are settled in the task. Texts come sorted and runs are sorted
    here, so a task that runs again after a loss sends the same rows to the same places."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        rows, selves, size, doc_type = [], [], 0, None

        def combined() -> Iterator:
            if not rows:
                return
            x = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _types(doc_type))], names=NAMES)
            order, own = np.argsort(x.column("h").to_numpy(), kind="stable"), np.array(selves)
            rows.clear()
            selves.clear()
            # Salts part what is sent, but all that is here can be looked at together.
            x = x.take(pa.array(order))
            plain = x.set_column(1, "salt", pa.array(np.zeros(x.num_rows, np.int32)))
            salts = iter(x.column("salt").to_pylist()) if x.column("salts").to_numpy().max() > 1 else None
            for part, alone in _sets(plain, kind.at_once, own[order]):
                stretches, kept = (None, part) if alone else _settled(part, kind, keep_first, finder)
                if stretches is not None:
                    yield stretches
                if salts is not None:
                    n = kept.column("salts").to_numpy()
                    place = [xxhash.xxh3_64_intdigest(f"{d}:{v}:{f}") >> 1 for d, v, f in zip(*(kept.column(c).to_pylist() for c in ("doc_id", "v", "first")))]
                    kept = kept.set_column(1, "salt", pa.array((np.array(place, np.int64) % n).astype(np.int32)))
                yield from kept.combine_chunks().to_batches(max_chunksize=10_000)

        for b in batches:
            doc_type = b.schema.field(0).type
            for doc, v, z, runs in zip(*(b.column(k).to_pylist() for k in range(4))):
                cut = kind.cut(expand(z))
                for r in sorted(runs, key=itemgetter("first", "last")):
                    body = cut(r["first"], r["last"] + kind.width)
                    rows.append((r["h"], 0, r["salts"], doc, v, r["first"], r["last"], body))
                    selves.append(r["own"])
                    # Runs of one hash are one group, which is looked at whole.
                    size += len(body) * (GATHERED // kind.at_once if r["own"] else 1) + 100
                    if size > GATHERED:
                        yield from combined()
                        size = 0
        yield from combined()

    joined = texts.join(lists, ["doc_id", "v"]).select("doc_id", "v", "z", "runs").sortWithinPartitions("doc_id", "v")  # no extra sort where the join has sorted
    return joined.mapInArrow(run, SEGMENT.format(doc_kind))


def _found(segments: DataFrame, doc_kind: str, kind: Tokens, keep_first: bool, finder: Callable, level: int) -> DataFrame:
    """Stretches to remove, and of groups that were dealt to several tasks what is left, as segments
    by the anchors of the next level."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def onward(x) -> Iterator:
            column = x.column("body").combine_chunks()
            bodies, base = column.to_pylist(), x.column("first").to_numpy()
            for a, _, tokens, at in kind.hashes(column):
                text, h, first, last, _ = anchors(tokens, at, kind, level)  # one of each window is left
                own = a + text
                cut = [kind.part(bodies[s], p, q + kind.width) for s, p, q in zip(own.tolist(), first.tolist(), last.tolist())]
                zero = np.zeros(len(own), np.int32)
                ids = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(zero), pa.array(zero + 1), x.column("doc_id").combine_chunks().take(ids), x.column("v").combine_chunks().take(ids), pa.array((base[own] + first).astype(np.int32)), pa.array((base[own] + last).astype(np.int32)), pa.array(cut, pa.binary())],
                    NAMES,
                )

        def settled(x: pa.Table) -> Iterator:
            done = pc.is_null(x.column("body"))
            yield from x.filter(done).combine_chunks().to_batches()
            x = x.filter(pc.invert(done))
            if not x.num_rows:
                return
            for part, alone in _sets(x, kind.at_once):
                stretches, kept = (None, part) if alone else _settled(part, kind, keep_first, finder)
                if stretches is not None:
                    yield stretches
                kept = kept.filter(pc.greater(kept.column("salts"), 1))
                if kept.num_rows:
                    yield from onward(kept)

        rest: list = []
        size = 0
        for b in (x.slice(at, 1000) for x in batches for at in range(0, x.num_rows, 1000)):
            rest.append(b)
            size += b.column(7).nbytes
            if size > kind.at_once:
                x = pa.Table.from_batches(rest).combine_chunks()
                h, salt = x.column("h").to_numpy(), x.column("salt").to_numpy()
                other = np.flatnonzero((h != h[-1]) | (salt != salt[-1]))
                if len(other):
                    edge = int(other[-1]) + 1
                    yield from settled(x.slice(0, edge))
                    rest = x.slice(edge).combine_chunks().to_batches()
                    size = sum(r.column(7).nbytes for r in rest)
        if rest:
            x = pa.Table.from_batches(rest).combine_chunks()
            if x.num_rows:
                yield from settled(x)

    return segments.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(run, SEGMENT.format(doc_kind))


def _dealt(rows: DataFrame, totals: DataFrame, hot: int) -> DataFrame:
    """rows with salts: to how many tasks their group is dealt. totals has h and total."""
    salts = F.ceil(F.col("total") / hot).cast("int")
    if totals.isEmpty():
        return rows.withColumn("salts", F.lit(1))
    return rows.join(totals.select("h", salts.alias("salts")), "h", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))


def repeated_stretches(docs: DataFrame, kind: Tokens, keep_first: bool, finder: Callable, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts: doc_id, v and zstd-compressed UTF-8 z; stretches: doc_id, v and the list of (start,
    end) tokens to remove), both by document.

    keep_first: remove all but the first of equal windows (by document, then place); else all
    that occur at two places. finder(bodies) gives the (class, number) arrays of the windows that
    are equal to another of the segments', all windows of all bodies being numbered in order."""
    hot = max(hot or kind.hot, 2)  # of two or more in a task, equal ones become one, so each level has fewer
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    modest_batches(docs.sparkSession)
    rows = keyed(docs)
    repeated = written(_repeated(_anchor_rows(rows, kind), doc_kind), "repeated")
    many = written(repeated.where(F.col("total") > hot).groupBy("h").agg(F.max("total").alias("total")), "hot")
    marked = _dealt(repeated.select("h", "doc_id", "v", "first", "last", "own"), many, hot)
    lists = marked.groupBy("doc_id", "v").agg(F.collect_list(F.struct("h", "first", "last", "own", "salts")).alias("runs"))
    # The filter is what the inner join below asks for; stated here, both joins share one exchange.
    texts = packed_texts(rows).where(F.col("doc_id").isNotNull())
    segments, found, level = _segments(texts, lists, doc_kind, kind, keep_first, finder), [], 0
    parted = not many.isEmpty()
    while True:
        level += 1
        step = _found(segments, doc_kind, kind, keep_first, finder, level)
        if not parted:
            found.append(step)
            break
        step = written(step, f"step-{level}")
        found.append(step.where(F.col("body").isNull()))
        left = step.where(F.col("body").isNotNull())
        if left.isEmpty():
            break
        size = F.ceil((F.col("last") - F.col("first") + 1) / reach(kind, level))
        many = written(left.groupBy("h").agg(F.sum(size).alias("total")).where(F.col("total") > hot), f"hot-{level}")
        parted = not many.isEmpty()
        spread = F.pmod(F.xxhash64("doc_id", "v", "first"), F.col("salts")).cast("int")
        segments = _dealt(left.drop("salts"), many, hot).withColumn("salt", spread).select(*NAMES)
    ends = [x.select("doc_id", "v", F.col("first").alias("start"), (F.col("last") + kind.width).alias("end")) for x in found]
    every = ends[0]
    for x in ends[1:]:
        every = every.union(x)
    return texts, every.groupBy("doc_id", "v").agg(F.collect_list(F.struct("start", "end")).alias("stretches"))


def covered(stretches: list, n: int):
    """Mask of the n tokens that stretches of (start, end) cover."""
    import numpy as np

    edges = np.zeros(n + 1, np.int64)
    if stretches:
        pairs = np.array([(x["start"], x["end"]) for x in stretches])
        np.add.at(edges, pairs[:, 0], 1)
        np.add.at(edges, pairs[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def texts_with_stretches(docs: DataFrame, texts: DataFrame, stretches: DataFrame) -> DataFrame:
    """doc_id, z, stretches of all rows of docs; those without doc_id have none."""
    rest = packed_texts(docs.where(docs["doc_id"].isNull()).select(docs["doc_id"], text_of(docs).cast("binary").alias("text")))
    found = texts.join(stretches, ["doc_id", "v"], "left").select("doc_id", "z", "stretches")
    return found.union(rest.select("doc_id", "z", F.lit(None).cast(stretches.schema["stretches"].dataType)))
