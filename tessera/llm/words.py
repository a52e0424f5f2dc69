"""Words of many texts at once: spans and 64-bit hashes from UTF-8 bytes, with numpy.

A word is a run of bytes other than \\x20 and \\x09-\\x0D, which never lie inside a UTF-8
character. Texts go through in chunks of about CHUNK bytes, long ones cut between words, so
memory follows a text by its hashes only. Hashes choose candidates; what must be equal is
compared on the words themselves by those who ask.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import SPACES

CHUNK = 1 << 20
U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: ASCII other than letters and digits: separators of words without punctuation.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(x).isalnum() for x in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
#: What is left of eight bytes when a word has fewer, by how many it has.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Words over this many bytes are hashed by the library, one by one.
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def spans(data: np.ndarray, text_starts: np.ndarray, separators: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; none crosses a text's start."""
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    cuts = text_starts[(text_starts > 0) & (text_starts < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, of eight bytes at a time, mixed in between."""
    if not len(starts):
        return np.zeros(0, U)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix((eight[starts] & _KEEP[np.minimum(size, 8)]) ^ mix(size.astype(U)))
    rest, at = np.flatnonzero(size > 8), 8
    while len(rest) and at < _LONG:
        left = size[rest] - at
        out[rest] = mix(out[rest] * U(_BASE) + (eight[starts[rest] + at] & _KEEP[np.minimum(left, 8)]))
        rest, at = rest[left > 8], at + 8
    if len(rest):
        import xxhash

        text = data.tobytes()
        out[rest] = [xxhash.xxh3_64_intdigest(text[starts[k] : ends[k]]) for k in rest]
    return out


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK bytes; a longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column without nulls."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def word_hashes(column, lower: bool = False, separators: np.ndarray = _IS_SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows of a string column without nulls: first row, end row, the hashes of
    their words in order, and where each row's words start (with the end)."""
    data, offsets = raw(column)
    for a, z in chunks(offsets):
        part = data[offsets[a] : offsets[z]]
        if lower:
            part = _LOWER[part]
        if z - a == 1 and len(part) > CHUNK:
            found, at = [], 0
            while at < len(part):
                to = min(at + CHUNK, len(part))
                while to < len(part) and not separators[part[to]]:
                    to += 1
                piece = part[at:to]
                found.append(hashes(piece, *spans(piece, np.zeros(0, np.int64), separators)))
                at = to
            h = np.concatenate(found)
            yield a, z, h, np.array([0, len(h)])
        else:
            local = offsets[a : z + 1] - offsets[a]
            s, e = spans(part, local[:-1], separators)
            yield a, z, hashes(part, s, e), np.searchsorted(s, local)


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n words in a row."""
    out = np.zeros(max(0, len(h) - n + 1), U)
    for i in range(n):
        out *= U(_BASE)
        out += h[i : i + len(out)]
    return mix(out)
