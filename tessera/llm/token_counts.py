"""Token counts of a SentencePiece BPE vocabulary by a whole-token shortcut.

A pre-token is a run of spaces with the characters after it up to the next space or line
feed, or the characters that follow a line feed. Pieces of the vocabulary have spaces only
in front, and none has a line feed, so no merge crosses a pre-token's edge and counts add
up (`Shortcut` checks both properties of the vocabulary when it is built). Building it also
proves, by encoding each vocabulary string alone, which pre-tokens are one token; those are
counted by a table lookup. Only other pre-tokens are merged, by the library itself, and
each distinct one once while the bounded cache holds it.

Defined results: null and empty texts have 0 bytes and 0 tokens; a text of any length is counted
whole; rows that repeat give a row each, and a null doc_id stays null; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, text_of

#: Distinct pre-tokens that a worker remembers before it starts anew.
CACHE_ENTRIES = 250_000
SPACE, LINE = "▁", "\n"


class _Counts(dict):
    """Pre-token to token count; the proven ones first, merged ones as they come."""

    def __init__(self, proven: dict[str, int], merged):
        super().__init__(proven)
        self.proven, self.merged, self.most = proven, merged, len(proven) + CACHE_ENTRIES

    def __missing__(self, key: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.proven)
        n = self[key] = self.merged(key)
        return n


class Shortcut:
    """Counts tokens; `one` and `one_bare` are the pre-tokens proven to be one token, with
    a space before them (left out of the key) and without."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        encode = self.library.encode
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        normal = [
            x for i, x in enumerate(names)
            if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))
        ]
        if any(SPACE in x.lstrip(SPACE) or LINE in x for x in normal):
            raise ValueError("the vocabulary has a piece that crosses pre-tokens")
        self.line = len(encode(LINE)) - 1  # a line feed's tokens; the other is the space put in front
        self.lone = len(encode(LINE))  # tokens before the bare pre-token in "\nX"
        spaced = [x[1:] for x in normal if x.startswith(SPACE) and SPACE not in x[1:] and len(x) > 1]
        bare = [x for x in normal if SPACE not in x]
        self.one = {x: 1 for x, ids in zip(spaced, encode(spaced)) if len(ids) == 1}
        self.one_bare = {x: 1 for x, ids in zip(bare, encode([LINE + x for x in bare])) if len(ids) == self.lone + 1}
        self.spaced = _Counts(self.one, lambda x: len(encode(x)))
        self.bare = _Counts(self.one_bare | {"": 0}, lambda x: len(encode(LINE + x)) - self.lone)
        self.wide = _Counts({" ": 1}, lambda x: len(encode(x[1:])))  # with all its spaces; the first is put in front again

    def count(self, text: str) -> int:
        if not text:
            return 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        total, spaced = 0, self.spaced.__getitem__
        for k, line in enumerate((" " + text).split(LINE)):
            first, *rest = line.split(" ")
            if k:
                total += self.line
            if first:
                total += self.bare[first]
            if "" in rest:
                run = 0
                for x in rest:
                    run += 1
                    if x:
                        total += spaced(x) if run == 1 else self.wide[" " * run + x]
                        run = 0
                if run:
                    total += self.wide[" " * run]
            else:
                total += sum(map(spaced, rest))
        return total


_made: dict[str, Shortcut] = {}


def _shortcut(model_file: str) -> Shortcut:
    if model_file not in _made:
        _made[model_file] = Shortcut(model_file)
    return _made[model_file]


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shortcut = _shortcut(model_file)
        for b in batches:
            n = [shortcut.count(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    modest_batches(docs.sparkSession)
    text = text_of(docs)
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
