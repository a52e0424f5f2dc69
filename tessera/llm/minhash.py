"""Near-duplicate groups by circulant MinHash, bands and exact Jaccard similarity.

A document's set holds hashes of its distinct word shingles; its size counts shingles that differ in
words, even where their hashes are equal. Two permutations make all
signature coordinates: sigma spreads a shingle over 2**32 places, pi (a bijection of these)
ranks them, and coordinate k is the least pi(sigma(x) + k mod 2**32), pi shifted circularly
by k. Documents of the same words form one class (by a 128-bit hash of them); classes that
agree in a band of ROWS coordinates share a bucket.

Candidates, without all pairs of a bucket: first each member with the bucket's smallest
(a star), verified on full sets and joined into components; then, in buckets that still
hold several components, members outside the smallest one's component against the whole
bucket, in blocks of about BLOCK members. A block takes a pair in the first band that the two
share and leaves out pairs that are connected already. It is read twice: by signatures, which
tell its members that have a likely partner in it, and then with the texts of these alone, where it
compares full sets itself and emits only links that join components, so no list of pairs is ever
made. Candidates whose signatures agree in too few places (five standard deviations under the
threshold) are dropped before full sets are compared. Two texts share no bucket with probability (1 - t**ROWS)**BANDS:
7e-7 at a similarity t of 0.85 and 1e-4 at 0.8; texts half alike share one in 4 cases of 10.
Sets are compared by hashes first, unless two shingles of one text share a hash, and a link is
confirmed on the shingles' own words.

Defined results: null texts, empty ones and ones without words have the empty set and are
linked with nothing; fewer words than a shingle make one shingle of all of them; a text of any
length is read whole; a row without doc_id is kept and takes no part; rows that repeat a
doc_id give a row each, and the links of any of them are that doc_id's; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, text_of, written
from .graph import components
from .repeats import packed_texts

SHINGLE, BANDS, ROWS, BLOCK = 5, 30, 6, 512
PLACES = BANDS * ROWS
KEY = ["n_shingles", "t1", "t2"]


def shingle_sets(column, n: int) -> Iterator[tuple[int, object, int]]:
    """(row, sorted distinct shingle hashes, distinct shingles) of a string column without nulls.
    Windows of different hashes differ; of those that share a hash, the words are compared."""
    import numpy as np

    from .words import U, mix, shingle_hashes, word_hashes

    for a, _, h, at in word_hashes(column, lower=True):
        every = shingle_hashes(h, n)
        for k in range(len(at) - 1):
            s, e = int(at[k]), int(at[k + 1])
            if e - s >= n:
                own = every[s : e - n + 1]
                found = np.unique(own)
                yield a + k, found, len(own) if len(found) == len(own) else distinct_shingles(own, words_of(column[a + k].as_py()), n)
            elif e > s:
                yield a + k, mix(shingle_hashes(h[s:e], e - s) + U(e - s)), 1
            else:
                yield a + k, np.zeros(0, U), 0


def distinct_shingles(hashes, words: list[bytes], n: int) -> int:
    """How many different windows a text has: those of a hash of their own, and of the others each
    run of words once."""
    import numpy as np

    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    shared = np.r_[same, False] | np.r_[False, same]
    return int(len(order) - shared.sum()) + len({b" ".join(words[i : i + n]) for i in order[shared].tolist()})


def may_be_similar(s, size_s: int, t, size_t: int, percent: int) -> bool:
    """False only if two sets can't have percent of their union in common: where each shingle of a text
    has a hash of its own, common hashes are no fewer than common shingles."""
    import numpy as np

    if size_s != len(s) or size_t != len(t):
        return True
    both = np.intersect1d(s, t, assume_unique=True).size
    return both > 0 and 100 * both >= percent * (size_s + size_t - both)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # both by ASCII rules


def exactly_similar(a: bytes, b: bytes, percent: int, n: int) -> bool:
    """Whether the sets of word shingles of two texts have percent of their union in common."""
    sets = []
    for words in (words_of(a), words_of(b)):
        sets.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()})
    both = len(sets[0] & sets[1])
    return both > 0 and 100 * both >= percent * len(sets[0] | sets[1])


def signatures(sets: list) -> object:
    """PLACES coordinates (columns) of each non-empty set (rows)."""
    import numpy as np

    from .words import U

    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    sigma = (np.concatenate(sets) * U(0xA24BAED4963EE407) >> U(32)).astype(np.uint32)
    out = np.empty((len(sets), PLACES), np.uint32)
    v = np.empty_like(sigma)
    t = np.empty_like(sigma)
    for k in range(PLACES):
        np.add(sigma, np.uint32(k), out=v)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
            np.right_shift(v, np.uint32(shift), out=t)
            np.bitwise_xor(v, t, out=v)
            if factor:
                np.multiply(v, np.uint32(factor), out=v)
        out[:, k] = np.minimum.reduceat(v, starts)
    return out


def band_keys(sig) -> object:
    import numpy as np

    from .words import U, mix

    out = np.zeros((len(sig), BANDS), U)
    for r in range(ROWS):
        out = mix(out * U(0x2545F4914F6CDD1D) + sig[:, r::ROWS].astype(U))
    return mix(out + np.arange(BANDS, dtype=U))


def _sketches(docs: DataFrame, n: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        def made(b, part: list) -> pa.RecordBatch:
            rows, sets = [r for r, _, _ in part], [s for _, s, _ in part]
            full = [s for s in sets if len(s)]
            sig = signatures(full) if full else np.zeros((0, PLACES), np.uint32)
            bands = iter(band_keys(sig).astype(np.int64).tolist())
            low = iter((sig & np.uint32(255)).astype(np.uint8))
            same = [xxhash.xxh3_128_digest(b" ".join(words_of(b.column(1)[r].as_py()))) for r in rows]
            t = np.frombuffer(b"".join(same), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(rows)), pa.array([size for _, _, size in part], pa.int64()), pa.array(t[:, 0]), pa.array(t[:, 1]),
                    pa.array([next(bands) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                    pa.array([next(low).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                ],
                ["doc_id", *KEY, "bands", "sig"],
            )

        for b in batches:
            part, size = [], 0
            for found in shingle_sets(b.column(1), n):
                part.append(found)
                size += len(found[1])
                if size > 150_000:
                    yield made(b, part)
                    part, size = [], 0
            if part:
                yield made(b, part)

    schema = f"doc_id {kind}, n_shingles long, t1 long, t2 long, bands array<long>, sig binary"
    return docs.select("doc_id", text_of(docs).cast("binary").alias("text")).mapInArrow(run, schema)


def least_agreement(threshold: float) -> int:
    return math.floor(PLACES * (threshold - 5 * math.sqrt(threshold * (1 - threshold) / PLACES)))


def _likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose signatures agree in enough places."""
    least = least_agreement(threshold)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for x in batches:
            sig = [np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint8).reshape(-1, PLACES) for k in (2, 3)]
            yield x.select([0, 1]).filter(pa.array((sig[0] == sig[1]).sum(1) >= least))

    sig = reps.select(F.col("id"), F.col("sig"))
    joined = pairs.join(sig.toDF("b", "sig_b"), "b").join(sig.toDF("a", "sig_a"), "a").select("a", "b", "sig_a", "sig_b")
    kind = pairs.schema["a"].dataType.simpleString()
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def _verified(pairs: DataFrame, packed: DataFrame, percent: int, n: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have percent of their union in common."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for x in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            keep = []
            one, two = ([expand(z) for z in x.column(k).to_pylist()] for k in (2, 3))
            left, right = (shingle_sets(pa.array(y, pa.binary()), n) for y in (one, two))
            for (k, *s), (_, *t) in zip(left, right, strict=True):
                keep.append(may_be_similar(*s, *t, percent) and exactly_similar(one[k], two[k], percent, n))
            yield x.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(packed.toDF("b", "z_b"), "b").join(packed.toDF("a", "z_a"), "a").select("a", "b", "z_a", "z_b")
    kind = pairs.schema["a"].dataType.simpleString()
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


class _Block:
    """Members of a block and their open pairs: across components, in the first band that the two
    share, with signatures that agree in `least` places."""

    def __init__(self, x, least: int):
        import numpy as np

        self.ids, self.comp, self.inside = (x.column(c).to_numpy(zero_copy_only=False).copy() for c in ("id", "component", "inside"))
        self.cross, self.band = x.column("t")[0].as_py() == 0, x.column("band")[0].as_py()
        self.sig = np.frombuffer(b"".join(x.column("sig").to_pylist()), np.uint8).reshape(-1, PLACES)
        self.bands = x.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        self.least = least

    def open_pairs(self) -> Iterator[tuple]:
        """(members, others, in how many places their signatures agree, or 0 where a pair isn't open),
        64 members at a time; components are those of the moment."""
        import numpy as np

        one, two = (np.flatnonzero(self.inside), np.flatnonzero(~self.inside)) if self.cross else (np.arange(len(self.ids)),) * 2
        for at in range(0, len(one) if len(two) else 0, 64):
            left = one[at : at + 64]
            agree = (self.sig[left][:, None, :] == self.sig[two][None, :, :]).sum(2)
            same_band = self.bands[left][:, None, :] == self.bands[two][None, :, :]
            agree[(agree < self.least) | (same_band.argmax(2) != self.band)] = 0
            if not self.cross:
                agree[left[:, None] >= two[None, :]] = 0
            agree[self.comp[left][:, None] == self.comp[two][None, :]] = 0
            yield left, two, agree

    def with_partners(self):
        """Mask of the members that are in an open pair."""
        import numpy as np

        out = np.zeros(len(self.ids), bool)
        for left, two, agree in self.open_pairs():
            out[left] |= agree.any(1)
            out[two] |= agree.any(0)
        return out

    def links(self, texts: list[bytes], percent: int, n: int) -> Iterator[tuple]:
        """Links between documents, found once per pair and only across components."""
        import numpy as np
        import pyarrow as pa

        sets = [s for _, *s in shingle_sets(pa.array(texts, pa.binary()), n)]
        for left, two, agree in self.open_pairs():
            while True:  # the likeliest open pair of each row, until none is left
                agree[self.comp[left][:, None] == self.comp[two][None, :]] = 0
                best = agree.argmax(1)
                rows = np.flatnonzero(agree[np.arange(len(left)), best])
                if not len(rows):
                    break
                for r in rows:
                    i, j = left[r], two[best[r]]
                    agree[r, best[r]] = 0
                    if self.comp[i] != self.comp[j] and may_be_similar(*sets[i], *sets[j], percent) and exactly_similar(texts[i], texts[j], percent, n):
                        self.comp[self.comp == self.comp[j]] = self.comp[i]
                        yield self.ids[i], self.ids[j]


def _by_block(rows: DataFrame, group: list[str], found, schema: str) -> DataFrame:
    """What found(table) yields for the rows of each group, gathered by an exchange."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        waiting = None
        for b in batches:
            x = pa.Table.from_batches([b])
            x = (pa.concat_tables([waiting, x]) if waiting is not None else x).combine_chunks()
            marks = np.stack([x.column(c).to_numpy() for c in group])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1
            bounds = [0, *cuts.tolist()]
            for s, e in zip(bounds, bounds[1:]):
                yield from found(x.slice(s, e - s).combine_chunks())
            waiting = x.slice(bounds[-1])
        if waiting is not None and waiting.num_rows:
            yield from found(waiting.combine_chunks())

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema)


def _within(members: DataFrame, packed: DataFrame, percent: int, n: int) -> DataFrame | None:
    """Links across components in buckets that hold several; members has key, band, id,
    component, sig, bands and inside (of the smallest member's component). None if there is no
    such bucket."""
    least, kind = least_agreement(percent / 100), members.schema["id"].dataType.simpleString()
    sizes = members.groupBy("key").agg(F.count_if("inside").alias("n_in"), F.count_if(~F.col("inside")).alias("n_out")).where((F.col("n_out") > 0) & (F.col("n_in") + F.col("n_out") > 2))
    sizes = written(sizes, "open-buckets")
    if sizes.isEmpty():
        return None
    rows = members.join(sizes, "key")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    rows = rows.withColumns({"of_in": F.greatest(blocks("n_in"), F.lit(1)), "of_out": blocks("n_out")})
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("inside"), F.col("of_in")).otherwise(F.col("of_out"))).cast("int"))
    cell = lambda t, i, j: F.struct(F.lit(t).alias("t"), i.alias("i"), j.alias("j"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = F.col("own")
    cells = F.when(F.col("inside"), F.transform(upto("of_out"), lambda j: cell(0, own, j))).otherwise(
        F.concat(F.transform(upto("of_in"), lambda i: cell(0, i, own)), F.transform(upto("of_out"), lambda j: cell(1, F.least(j, own), F.greatest(j, own))))
    )
    group, rest = ["key", "t", "i", "j"], ["band", "id", "component", "inside", "sig", "bands"]
    dealt = rows.select("key", F.explode(cells).alias("c"), *rest).select("key", "c.t", "c.i", "c.j", *rest)

    def likely(x) -> Iterator:
        import pyarrow as pa

        if x.num_rows > 1:
            yield from x.filter(pa.array(_Block(x, least).with_partners())).to_batches()

    def linked(x) -> Iterator:
        import pyarrow as pa
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        found = list(_Block(x, least).links([expand(z) for z in x.column("z").to_pylist()], percent, n))
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    left = written(_by_block(dealt, group, likely, schema), "likely-members")
    if left.isEmpty():
        return None
    return _by_block(left.join(packed.toDF("id", "z"), "id").select(*left.columns, "z"), group, linked, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document."""
    modest_batches(docs.sparkSession)
    threshold = percent / 100
    docs = docs.select("doc_id", "text")
    packed = packed_texts(docs.select("doc_id", text_of(docs).cast("binary").alias("text")))
    sketches = written(_sketches(docs, shingle), "sketches")
    takes_part = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    full = sketches.where(takes_part)
    reps = written(full.groupBy(*KEY).agg(F.min(F.struct("doc_id", "bands", "sig")).alias("r")).select(*KEY, F.col("r.doc_id").alias("id"), "r.bands", "r.sig"), "classes")
    buckets = reps.select(F.posexplode("bands").alias("band", "key"), "id")
    shared = written(buckets.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where(F.col("n") > 1), "buckets")
    members = written(buckets.join(shared, "key").select("key", "band", "id", "least"), "members")
    stars = members.where(F.col("id") != F.col("least")).select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    links = written(_verified(_likely(stars, reps, threshold), packed, percent, shingle), "star-links")
    final = components(links)
    known = written(reps.select("id", "sig", "bands").join(final, "id", "left").select("id", "sig", "bands", F.coalesce("component", "id").alias("component")), "labels")
    centres = known.select(F.col("id").alias("least"), F.col("component").alias("least_component"))
    inside = (F.col("component") == F.col("least_component")).alias("inside")
    open_members = members.join(known, "id").join(centres, "least").select("key", "band", "id", "component", "sig", "bands", inside)
    more = _within(open_members, packed, percent, shingle)
    if more is not None and not (more := written(more, "block-links")).isEmpty():
        final = components(links.union(more))
    class_of = written(reps.select(*KEY, "id").join(final, "id", "left").select(*KEY, F.coalesce("component", "id").alias("component_id")), "components")
    own = full.select("doc_id", *KEY).join(class_of, KEY).select("doc_id", "n_shingles", "component_id")
    none = sketches.where(~takes_part).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return own.union(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with the columns of docs."""
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
