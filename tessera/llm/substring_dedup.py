"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix whose first WINDOW words occur once is a lone leaf above depth WINDOW and can't lie
under a deep internal node, so suffixes go on only where the stretch that anchors their window
occurs twice (`repeats`). They are dealt by prefixes of the suffixes that start at anchors, of
variable length: the anchor's GRAMS[0] words, and where such a group would exceed a task, 14
words, then all WINDOW; neighbouring windows of one anchor travel together, as one segment.
(Dealing every suffix by its own first words would send each with words of its own, some five
times the text.) Each task builds the suffix tree of a memory-sized set of whole groups: sorted
suffixes, the full lengths of their common prefixes, and from these the internal nodes. The topmost
nodes of WINDOW words or deeper hold the repeats: of the leaves under one, all but the first
(smallest doc_id, then place) go, WINDOW words each. A maximal repeat of n words is n - 19 such
nodes, one for each of its suffixes that is long enough, so its leaves join to one stretch.

Words are compared as they are (in a word of over LONG_WORD bytes, a 128-bit hash stands for it).

Defined results: null and empty texts have no words (0 removed, the hash of the empty string);
texts shorter than WINDOW words stay; a text of any length is read whole; rows that repeat
doc_id and text are one document, and each gets its result (so they aren't repeats of one
another); rows that share a doc_id only are documents of their own; a row without doc_id
stays whole and takes no part; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from . import repeats

WINDOW, GRAMS, LONG_WORD = 20, (8, 14, 20), 64


def _words(column) -> Iterator:
    from .words import word_hashes

    return word_hashes(column)


def _stretches(h, n: int):
    from .words import shingle_hashes

    return shingle_hashes(h, n)


def _short(word: bytes) -> bytes:
    import xxhash

    return b"\xff" + xxhash.xxh3_128_hexdigest(word).encode()  # no text holds the byte \xff


def _cut(text: bytes):
    words = text.split()
    if len(text) > LONG_WORD:
        words = [w if len(w) <= LONG_WORD else _short(w) for w in words]
    return lambda a, z: b" ".join(words[a:z])


def _part(body: bytes, a: int, z: int) -> bytes:
    return b" ".join(body.split(b" ")[a:z])


WORDS = repeats.Tokens(WINDOW, GRAMS, _words, _stretches, _cut, _part, at_once=2_000_000, hot=10_000)


class SuffixTree:
    """The tree of the suffixes of token rows that start at `starts`; rows end in tokens that occur
    nowhere else. Leaves are in order; `common` is how many tokens each shares with the one before
    it. An internal node is a range of leaves with the length of their common prefix."""

    def __init__(self, tokens, starts, longest: int):
        import numpy as np

        ranks, have = {1: np.unique(tokens, return_inverse=True)[1].astype(np.int64)}, 1
        while have < longest:  # the order of stretches of 2, 4, ... tokens
            last = ranks[have]
            pair = last * (len(tokens) + 1)
            pair[: len(last) - have] += last[have:] + 1
            ranks[2 * have] = np.unique(pair, return_inverse=True)[1]
            have *= 2
        self.order = np.argsort(ranks[have][starts], kind="stable")
        self.starts = starts[self.order]
        one, two = self.starts[1:], self.starts[:-1]
        grown = np.zeros(len(one), np.int64)
        for size in sorted(ranks, reverse=True):
            a, b = one + grown, two + grown
            inside = np.flatnonzero(np.maximum(a, b) < len(tokens))
            same = inside[ranks[size][a[inside]] == ranks[size][b[inside]]]
            grown[same] += size
        self.common = np.concatenate(([0], grown)) if len(starts) else grown

    def deep_nodes(self, depth: int):
        """The topmost internal nodes of `depth` tokens or deeper: (first leaf, last leaf, length of
        the common prefix of all between)."""
        import numpy as np

        inside = np.flatnonzero(self.common >= depth)
        if not len(inside):
            return (np.zeros(0, np.int64),) * 3
        edge = np.flatnonzero(np.concatenate(([True], inside[1:] != inside[:-1] + 1)))
        last = np.append(edge[1:], len(inside)) - 1
        return inside[edge] - 1, inside[last], np.minimum.reduceat(self.common[inside], edge)


def find_repeats(bodies):
    """(node, number of the window) of the windows under a deep node; bodies are words parted by
    single spaces, and their windows are numbered in order."""
    import numpy as np
    import pyarrow as pa

    from .words import raw, spans

    data, offsets = raw(bodies)
    start, end = spans(data, offsets[:-1])
    letters = data[data != 32]
    cuts = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(letters.tobytes())])
    number = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    at = np.searchsorted(start, offsets)
    sizes = np.diff(at)
    segment = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(number)) - at[segment]
    tokens = np.empty(len(number) + len(sizes), np.int64)  # each row with an end of its own
    tokens[np.arange(len(number)) + segment] = number
    ends = at[1:] + np.arange(len(sizes))
    tokens[ends] = len(number) + np.arange(len(sizes))
    own = np.flatnonzero(place + WINDOW <= sizes[segment])
    tree = SuffixTree(tokens, own + segment[own], int(sizes.max()) if len(sizes) else 1)
    first, last, _ = tree.deep_nodes(WINDOW)
    n = last - first + 1
    leaf = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(np.arange(len(n)), n), tree.order[leaf]


def remove_repeats(docs: DataFrame, hot: int | None = None, texts_too: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with texts_too the kept text."""
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    texts, stretches = repeats.repeated_stretches(docs, WORDS, True, find_repeats, hot)

    def run(batches: Iterator) -> Iterator:
        import hashlib
        from itertools import compress

        import pyarrow as pa
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for z, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = expand(z).split()
                gone = repeats.covered(found or [], len(words)) if found else None
                kept = b" ".join(words if gone is None else compress(words, (~gone).tolist()))
                rows.append((len(words), 0 if gone is None else int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept if texts_too else None))
            n, gone, sha, kept = zip(*rows) if rows else ((),) * 4
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            if texts_too:
                cols.append(pa.array([x.decode(errors="replace") for x in kept], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["text"] if texts_too else [])]
    joined = repeats.texts_with_stretches(docs, texts, stretches)
    return joined.mapInArrow(run, f"doc_id {doc_kind}, n_words long, n_removed long, kept_sha256 string" + ", text string" * texts_too)
