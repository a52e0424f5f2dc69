"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are the windows of WINDOW bytes whose anchor occurs twice (`repeats`); others cannot
repeat. Each task sorts the suffixes of a memory-sized set of groups from the most significant
digit on. A digit is a stretch of DIGIT bytes; the order of digits is that of their 64-bit
hashes, as a radix sort may take any order of its alphabet. A pass orders each group of the
pass before by its next digit, groups of one leave at once, and after WINDOW / DIGIT passes the
groups left are the repeated windows. Nothing is ordered beyond WINDOW bytes. Then the members
of each group are compared byte by byte; should two digits have shared a hash, the set is sorted
again by digits of eight bytes as they are. All occurrences go, in whichever documents.

Defined results: null and empty texts have 0 bytes (and the hash of the empty string); texts
under WINDOW bytes stay; a text of any length is read whole; rows that repeat doc_id and text are
one document, and each gets its result (so they aren't repeats of one another); rows that
share a doc_id only are documents of their own; a row without doc_id stays whole and takes no
part; bytes are removed wherever a window says so, even inside a character, as the contract
counts bytes; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from . import repeats

WINDOW, GRAMS, DIGIT = 400, (32, 216, 308, 354, 400), 100


def _bytes(column) -> Iterator:
    from .words import chunks, raw

    data, offsets = raw(column)
    for a, z in chunks(offsets):
        yield a, z, data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]


def stretch_hashes(data, size: int, mixed: bool = True):
    """64-bit hashes of the `size` bytes from each byte on: of 8 bytes, then of twice as many at a
    time, the last two overlapping."""
    import numpy as np

    from .words import U, mix

    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(U)
    have = 8
    while have < size:
        step = min(have, size - have)
        pair = out[: len(out) - step] * U(0x9E3779B97F4A7C15)
        pair ^= pair >> U(32)
        pair *= U(0xD6E8FEB86659FD93 + 2 * have)
        pair += out[step:]
        out, have = pair, have + step
    return mix(out) if mixed else out


def _cut(text: bytes):
    return lambda a, z: text[a:z]


def _part(body: bytes, a: int, z: int) -> bytes:
    return body[a:z]


BYTES = repeats.Tokens(WINDOW, GRAMS, _bytes, stretch_hashes, _cut, _part, at_once=800_000, hot=1_500)


def eight_bytes(data):
    """The eight bytes from each byte on, as a number in their order."""
    import numpy as np

    padded = np.concatenate([data, np.zeros(7, np.uint8)])
    return np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(np.uint64)


def radix_groups(digits, starts, places):
    """(index of starts, group) of the suffixes whose digits at all `places` equal another's, in
    order: a pass for each place, most significant first. A pass orders each group of the pass
    before by its next digit; groups of one leave at once."""
    import numpy as np

    from .words import U

    alive, group = np.arange(len(starts)), np.zeros(len(starts), U)
    for at in places:
        if not len(alive):
            break
        digit = digits[starts[alive] + at]
        bits = int(group[-1]).bit_length()
        key = group << U(64 - bits) | digit >> U(bits) if bits else digit  # the group, then the leading bits of the digit
        order = np.argsort(key)
        key, d = key[order], digit[order]
        same = (key[1:] == key[:-1]) & (d[1:] == d[:-1])
        if np.count_nonzero(key[1:] == key[:-1]) != np.count_nonzero(same):  # bits that follow decide
            order = np.lexsort((digit, group))
            g, d = group[order], digit[order]
            same = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        alive = alive[order][keep]
        fresh = np.concatenate(([True], ~same))[keep]
        group = (np.cumsum(fresh) - 1).astype(U)
    return alive, group.astype(np.int64)


def _equal(text: bytes, starts, alive, group) -> bool:
    """Whether all suffixes of each group agree in WINDOW bytes, compared run by run: neighbours
    whose groups' first members are neighbours, too, are one comparison."""
    import numpy as np

    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    leader = np.repeat(np.minimum.reduceat(starts[alive], edge), np.diff(np.append(edge, len(group))))
    at = starts[alive]
    order = np.argsort(at)
    at, leader = at[order], leader[order]
    edge = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (leader[1:] != leader[:-1] + 1))))
    last = np.append(edge[1:], len(at)) - 1
    return all(text[a : z + WINDOW] == text[b : b + z - a + WINDOW] for a, z, b in zip(at[edge].tolist(), at[last].tolist(), leader[edge].tolist()) if a != b)


def find_repeats(bodies):
    """(group, number of the window) of the windows that equal another; the windows of all bodies
    are numbered in order."""
    import numpy as np

    from .words import raw

    data, offsets = raw(bodies)
    n = np.diff(offsets) - WINDOW + 1
    starts = np.arange(int(n.sum())) + np.repeat(offsets[:-1] - (np.cumsum(n) - n), n)
    alive, group = radix_groups(stretch_hashes(data, DIGIT, False), starts, range(0, WINDOW, DIGIT))
    if len(alive) and not _equal(data.tobytes(), starts, alive, group):  # two digits of one hash
        alive, group = radix_groups(eight_bytes(data), starts, range(0, WINDOW, 8))
    return group, alive


def remove_repeats(docs: DataFrame, hot: int | None = None, bytes_too: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with bytes_too the kept bytes."""
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    texts, stretches = repeats.repeated_stretches(docs, BYTES, False, find_repeats, hot)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if bytes_too else [])]

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for z, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                text, kept, at, n = expand(z), [], 0, 0
                for s, e in sorted((x["start"], x["end"]) for x in found or ()):
                    if s > at or not n:
                        n += 1
                        kept.append(text[at:s])
                    at = max(at, e)
                rest = b"".join(kept) + text[at:]
                rows.append((len(text), len(text) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest))
            cols = list(zip(*rows)) if rows else [()] * 5
            arrays = [b.column(0), *(pa.array(x, t) for x, t in zip(cols, [pa.int64()] * 3 + [pa.string(), pa.binary()]))]
            yield pa.RecordBatch.from_arrays(arrays[: len(names)], names)

    joined = repeats.texts_with_stretches(docs, texts, stretches)
    return joined.mapInArrow(run, f"doc_id {doc_kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * bytes_too)
