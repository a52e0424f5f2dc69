"""Fill-in-middle documents, cut by a parallel automaton scan.

A small automaton reads a text's UTF-8 bytes. It counts units (code points, at their last byte) and
marks (the strings <P>, <S>, <M>) and has six states: ground, after `<`, after `<P` and the like,
and one to three bytes short of a character's end. What stands before a block of bytes is unknown
to the one who reads it, so a block gives a function: for each state that it may be entered in, the
state that it is left in, its units and its marks. Functions compose associatively, so blocks of a
text are folded in any grouping; the fold resolves the state that each block is entered in, and the
units before it tell which block has the cut.

A text of up to part_bytes is scanned in the task that reads its row, as blocks of 64 bytes with
the batch's other texts, and never moves. A longer one is dealt as parts of part_bytes over all
tasks (cut between any two bytes, inside characters and marks as well): parts give functions, these
meet by document, a few numbers a part, and each part cuts itself by the state and the units that
it begins with. Only its pieces meet again, as the document that is returned is one row as it was.

Defined results: a null or empty text has no units and is plain; a text that contains a mark is
plain; a null doc_id is drawn as an empty number; rows that repeat give a row each; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, modest_batches, parts_for, text_of, written
from .words import chunks, raw

#: Documents over this many bytes are dealt as parts of as many.
PART_BYTES = 1 << 20
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
PLAIN_FROM, SPM_BELOW, SEED = 90, 20, 1

STATES, BLOCK = 6, 64
#: Classes of bytes: any ASCII, `<`, a mark's letter, `>`, continuation, leads of 2, 3 and 4 bytes; and none.
CLASSES = 9
_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord("<"), ord(">")]] = 1, 3
_CLASS[[ord(x) for x in "PSM"]] = 2
_CLASS[0x80:0xC0], _CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = 4, 5, 6, 7
_NONE = 8


def _step(state: int, kind: int) -> tuple[int, int, int]:
    """The next state, and the units and marks that end with the byte."""
    if kind == _NONE:
        return state, 0, 0
    if kind == 4:  # a lone continuation byte is a unit of its own
        return (state - 1, 0, 0) if state > 3 else (0, 1, 0)
    if kind > 4:
        return kind - 2, 0, 0
    if state == 2 and kind == 3:
        return 0, 1, 1
    return {1: 1, 2: 2 if state == 1 else 0}.get(kind, 0), 1, 0


#: A step by one byte, and by four at once: next state, units << 3, marks << 6.
_ONE = np.array([[s | u << 3 | m << 6 for s, u, m in (_step(a, k) for a in range(STATES))] for k in range(CLASSES)], np.uint8)


def _joined(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """All steps of one table followed by all of another."""
    a, b = first[:, None, :], then[None, :, :]
    a, b = np.broadcast_arrays(a, b)
    after = np.take_along_axis(b, (a & 7).astype(np.intp), 2)
    return ((after & 7) | ((a >> 3 & 7) + (after >> 3 & 7)) << 3 | ((a >> 6) + (after >> 6)) << 6).reshape(-1, STATES).astype(np.uint8)


_FOUR = _joined(_joined(_ONE, _ONE), _joined(_ONE, _ONE))


class Scan:
    """The blocks of some texts, folded from each text's start: left, units and marks have a row a
    block and a column a state that its text may be entered in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        size = np.diff(offsets)
        self.blocks = np.maximum(1, -(-size // BLOCK))
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])
        n = int(self.first[-1])
        place = np.arange(len(data)) + np.repeat(self.first[:-1] * BLOCK - offsets[:-1], size)
        kinds = np.full(n * BLOCK, _NONE, np.uint8)
        kinds[place] = _CLASS[data]
        self.kinds = kinds.reshape(n, BLOCK)
        four = self.kinds.reshape(n, BLOCK // 4, 4).astype(np.uint16) @ np.array([729, 81, 9, 1], np.uint16)
        state = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (n, STATES))
        units, marks = np.zeros((n, STATES), np.int32), np.zeros((n, STATES), np.int32)
        for j in range(BLOCK // 4):
            got = _FOUR[four[:, j, None], state]
            state = got & 7
            units += got >> 3 & 7
            marks += got >> 6
        self.left, self.units, self.marks = state.astype(np.intp), units.astype(np.int64), marks.astype(np.int64)
        nth, far = np.arange(n) - np.repeat(self.first[:-1], self.blocks), 1
        while far < self.blocks.max(initial=0):  # each block with all that stand up to `far` before it
            late = np.flatnonzero(nth >= far)
            early = late - far
            via = self.left[early]
            take = lambda x: np.take_along_axis(x[late], via, 1)  # noqa: B023, E731
            left, units, marks = take(self.left), self.units[early] + take(self.units), self.marks[early] + take(self.marks)
            self.left[late], self.units[late], self.marks[late] = left, units, marks
            far *= 2

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's function: left, units and marks by the state it is entered in."""
        last = self.first[1:] - 1
        return self.left[last], self.units[last], self.marks[last]

    def find(self, entry: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The byte behind so many units of each text, 0 for none, if it is entered so."""
        own = np.repeat(entry, self.blocks)
        after = self.units[np.arange(len(own)), own]
        total = after[self.first[1:] - 1]
        above = np.concatenate([[0], np.cumsum(total + 1)])  # texts one above the other, so that one search serves all
        at = np.searchsorted(after + np.repeat(above[:-1], self.blocks), above[:-1] + unit)
        at = np.minimum(at, self.first[1:] - 1)
        inner = at > self.first[:-1]
        before = np.where(inner, at - 1, 0)
        state = np.where(inner, self.left[before, entry], entry)
        count = np.where(inner, self.units[before, entry], 0)
        place = np.zeros(len(at), np.int64)
        for j in range(BLOCK):
            got = _ONE[self.kinds[at, j], state]
            place += count < unit
            state, count = got & 7, count + (got >> 3 & 7)
        return np.where(unit > 0, (at - self.first[:-1]) * BLOCK + place, 0)


def _summary_udf():
    """bytes -> the function of a part."""

    @F.arrow_udf("struct<left: array<int>, units: array<long>, marks: array<long>>")
    def summary(part):
        import pyarrow as pa

        data, offsets = raw(part)
        found: list[list] = [[], [], []]
        for a, z in chunks(offsets):
            for out, x in zip(found, Scan(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]).whole()):
                out.extend(x.tolist())
        kinds = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(found, kinds)], ["left", "units", "marks"])

    return summary


def _cut_udf():
    """part, the state that it is entered in, units before each of two cuts -> their bytes."""

    @F.arrow_udf("struct<a: long, b: long>")
    def cut(part, entry, a, b):
        import pyarrow as pa

        data, offsets = raw(part)
        entry, wanted, found = np.asarray(entry), [np.asarray(x) for x in (a, b)], [[], []]
        for i, z in chunks(offsets):
            scan = Scan(data[offsets[i] : offsets[z]], offsets[i : z + 1] - offsets[i])
            for out, unit in zip(found, wanted):
                out.append(scan.find(entry[i:z], unit[i:z]))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in found], ["a", "b"])

    return cut


def _whole_udf():
    """text, two draws -> units, marks, and for the cuts drawn their units and bytes."""

    @F.arrow_udf("struct<n: long, marks: long, lo: long, hi: long, a: long, b: long>")
    def cut(text, h1, h2):
        import pyarrow as pa

        data, offsets = raw(text)
        h1, h2, rows = np.asarray(h1), np.asarray(h2), []
        for i, z in chunks(offsets):
            scan = Scan(data[offsets[i] : offsets[z]], offsets[i : z + 1] - offsets[i])
            _, units, marks = (x[:, 0] for x in scan.whole())
            x, y, ground = h1[i:z] % (units + 1), h2[i:z] % (units + 1), np.zeros(z - i, np.intp)
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            rows.append((units, marks, lo, hi, scan.find(ground, lo), scan.find(ground, hi)))
        columns = [np.concatenate(x) for x in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 6
        return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["n", "marks", "lo", "hi", "a", "b"])

    return cut


def _draws(doc_id: Column) -> list[Column]:
    """The four draws of a document, whole numbers under 2**32."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _form() -> Column:
    plain = (F.col("n") == 0) | (F.col("marks") > 0) | (F.col("h3") % 100 >= PLAIN_FROM)
    return F.when(plain, "plain").when(F.col("h4") % 100 < SPM_BELOW, "spm").otherwise("psm")


def _short(docs: DataFrame) -> DataFrame:
    """Whole texts, in the tasks that read them."""
    found = docs.withColumn("cut", _whole_udf()("text", "h1", "h2")).select("*", "cut.*").withColumn("form", _form())
    # Bytes, as a position among them takes no search.
    data = F.col("text").cast("binary")
    prefix, middle, suffix = (
        F.substring(data, F.lit(1), F.col("a").cast("int")), F.substring(data, (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")),
        F.substring(data, (F.col("b") + 1).cast("int"), F.octet_length("text")),
    )
    mark = {k: F.lit(x.encode()) for k, x in MARKS.items()}
    output = (
        F.when(F.col("form") == "psm", F.concat(mark["prefix"], prefix, mark["suffix"], suffix, mark["middle"], middle))
        .when(F.col("form") == "spm", F.concat(mark["suffix"], suffix, mark["prefix"], prefix, mark["middle"], middle)).otherwise(data)
    )
    return found.select("doc_id", "n", "form", "lo", "hi", output.cast("string").alias("output"))


def _long(docs: DataFrame, part_bytes: int) -> DataFrame | None:
    """Texts as parts, over all tasks; None if there are none. Rows that repeat are one document."""
    spark = docs.sparkSession
    data = F.col("text").cast("binary")
    starts = F.sequence(F.lit(0), ((F.octet_length("text") - 1) / part_bytes).cast("int"))
    named = docs.withColumn("text_key", F.sha2(data, 256)).select("doc_id", "text_key", "h1", "h2", "h3", "h4", data.alias("data"), F.explode(starts).alias("part"))
    cut = named.select("doc_id", "text_key", "h1", "h2", "h3", "h4", "part", F.substring("data", F.col("part") * part_bytes + 1, F.lit(part_bytes)).alias("bytes"))
    own = ["doc_id", "text_key", "part"]
    one = cut.groupBy(*own, "h1", "h2", "h3", "h4").agg(F.first("bytes").alias("bytes"), F.count("*").alias("copies"))
    parts = written(one.repartition(parts_for(spark), *own), "parts")
    if parts.isEmpty():
        return None
    functions = parts.withColumn("f", _summary_udf()("bytes")).select(*own, "h1", "h2", "h3", "h4", "copies", "f")
    by_doc = functions.groupBy("doc_id", "text_key", "h1", "h2", "h3", "h4").agg(F.array_sort(F.collect_list(F.struct("part", "f"))).alias("fs"), F.max("copies").alias("copies"))
    # Each part with the state and the units that it begins with, and what the whole comes to.
    start = F.expr("named_struct('state', 0, 'n', 0L, 'marks', 0L, 'before', cast(array() AS array<struct<part: int, entry: int, units: bigint>>))")
    fold = F.aggregate("fs", start, lambda x, p: F.struct(
        F.get(p["f"]["left"], x["state"]).alias("state"), (x["n"] + F.get(p["f"]["units"], x["state"])).alias("n"), (x["marks"] + F.get(p["f"]["marks"], x["state"])).alias("marks"),
        F.concat(x["before"], F.array(F.struct(p["part"].alias("part"), x["state"].alias("entry"), x["n"].alias("units")))).alias("before"),
    ))
    resolved = by_doc.withColumn("whole", fold).select("doc_id", "text_key", "h1", "h2", "h3", "h4", "copies", "whole.n", "whole.marks", "whole.before")
    x, y = (F.pmod(F.col(h), F.col("n") + 1) for h in ("h1", "h2"))
    resolved = resolved.withColumns({"lo": F.least(x, y), "hi": F.greatest(x, y), "form": _form()})
    begun = resolved.select("doc_id", "text_key", "copies", "n", "form", "lo", "hi", F.explode("before").alias("x")).select("*", "x.*").drop("x")
    # A part has its cuts where the units before it say so; a cut outside it is at its edge. The
    # segments are numbered in order of the text: prefix 0, middle 1, suffix 2.
    keys = [F.col(f"b.{k}").eqNullSafe(F.col(f"p.{k}")) for k in own]
    both = begun.alias("b").join(parts.select(*own, "bytes").alias("p"), keys[0] & keys[1] & keys[2]).select("b.*", "p.bytes")
    inside = lambda c: F.greatest(F.lit(0), F.col(c) - F.col("units"))
    total = F.octet_length("bytes").cast("long")
    both = both.withColumn("cut", _cut_udf()("bytes", "entry", inside("lo"), inside("hi")))
    a, b = (F.least(total, F.when(F.col(c) <= F.col("units"), F.lit(0)).otherwise(F.col(f"cut.{k}"))) for c, k in (("lo", "a"), ("hi", "b")))
    edged = both.withColumns({"a": a, "b": b})
    piece = lambda k, i, j: F.struct(F.lit(k).alias("segment"), F.expr(f"substring(bytes, cast({i} + 1 AS int), cast({j} - {i} AS int))").alias("bytes"))
    pieces = edged.select("doc_id", "text_key", "copies", "n", "form", "lo", "hi", "part", F.explode(F.array(piece(0, "a * 0", "a"), piece(1, "a", "b"), piece(2, "b", "octet_length(bytes)"))).alias("x"))
    placed = pieces.select("doc_id", "text_key", "copies", "n", "form", "lo", "hi", F.struct("part", "x.segment", "x.bytes").alias("piece"))
    again = placed.groupBy("doc_id", "text_key", "copies", "n", "form", "lo", "hi").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))

    def joined(segment: int | None) -> Column:
        chosen = F.col("pieces") if segment is None else F.filter("pieces", lambda p: p["segment"] == segment)
        return F.array_join(F.transform(chosen, lambda p: p["bytes"].cast("string")), "")

    p, s, m = (F.concat(F.lit(MARKS[k]), joined(i)) for k, i in (("prefix", 0), ("suffix", 2), ("middle", 1)))
    output = F.when(F.col("form") == "psm", F.concat(p, s, m)).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(joined(None))
    rows = again.select("doc_id", "n", "form", "lo", "hi", output.alias("output"), "copies")
    return rows.select("doc_id", "n", "form", "lo", "hi", "output", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


def fill_in_middle(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if plain)
    and output, the text to train on."""
    modest_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_of(docs).alias("text"), *_draws(docs["doc_id"]))
    size = F.octet_length("text")
    out = _short(rows.where(size <= part_bytes))
    far = _long(rows.where(size > part_bytes), part_bytes)
    if far is not None:
        out = out.unionByName(far)
    chars = lambda x: F.when(F.col("form") != "plain", x)
    return out.select("doc_id", "n", "form", chars(F.col("lo")).alias("prefix_chars"), chars(F.col("hi") - F.col("lo")).alias("middle_chars"), "output")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. What isn't plain has each mark once."""
    back = lambda x: F.when(form == "psm", F.concat(x[1], x[3], x[2])).otherwise(F.concat(x[2], x[3], x[1]))
    return F.when(form == "plain", output).otherwise(let(F.split(output, "<[PSM]>", -1), back))


def report(docs: DataFrame) -> DataFrame:
    """Each document's cut, with digests of its output and of the text rebuilt from that."""
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
