"""Fill-in-middle, FLAC columns and importance resampling against plain versions and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_middle, flac, resampling
from tessera.operators.ordering import carried

EXTRA = "doc_id long, text string, form string, n long, media binary, score long, copies long, h1 long, part int"


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, "f", 1, b"m", 2, 3, 4, 5) for i, t in rows], EXTRA).repartition(3)


# -- fill in middle -----------------------------------------------------------------------------


def plain_middle(doc_id, text):
    t = text or ""
    n, d = len(t), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    if h[3] % 100 < 20:
        return doc_id, n, "spm", lo, hi - lo, f"<S>{t[hi:]}<P>{t[:lo]}<M>{t[lo:hi]}"
    return doc_id, n, "psm", lo, hi - lo, f"<P>{t[:lo]}<S>{t[hi:]}<M>{t[lo:hi]}"


@pytest.fixture(scope="module")
def marked():
    r = random.Random(1)
    out = [None, "", "<", "<P", "<P>", "a<P>b", "<<P>", "<P<S>", "x" * 63 + "<M>", "é" * 40, " é中🙂" * 50, "<P" + "y" * 200, "z" * 62 + "<S" + "S>" * 3]
    out += ["".join(r.choice("ab<P>SM é中🙂\n") for _ in range(r.randint(1, 300))) for _ in range(60)]
    out += [re.sub("<[PSM]>", "", "".join(r.choice("ab<P>S é中🙂\n") for _ in range(r.randint(1, 300)))) for _ in range(90)]
    return list(enumerate(out)) + [(4, out[4]), (60, out[60]), (60, out[60]), (None, out[-1]), (None, None)]


@pytest.mark.parametrize("part_bytes", [1 << 20, 70, 3])
def test_middle_equals_slicing(spark, marked, part_bytes):
    """Parts of three bytes lie inside characters and marks; rows that repeat stay."""
    rows = marked if part_bytes > 3 else [x for x in marked if len(x[1] or "") < 120]
    got = fill_middle.fill_in_middle(table_of(spark, rows), part_bytes)
    assert in_order(got.collect()) == in_order(plain_middle(*x) for x in rows)


def test_middle_rebuilds_texts(spark, marked):
    got = fill_middle.fill_in_middle(table_of(spark, marked)).select(fill_middle.restored(F.col("output"), F.col("form")).alias("t"))
    assert sorted(x.t for x in got.collect()) == sorted(t or "" for _, t in marked)


def test_middle_of_no_rows(spark):
    assert fill_middle.report(table_of(spark, [(1, "a")]).where("doc_id < 0")).count() == 0


def test_functions_of_stretches_compose():
    """Entered in any state, two stretches one after the other do what the whole does."""
    r = random.Random(5)
    for _ in range(40):
        data = np.frombuffer("".join(r.choice("a<PSM>é中🙂") for _ in range(r.randint(0, 200))).encode(), np.uint8)
        cut = r.randint(0, len(data))
        ends = lambda x: np.array([0, len(x)])
        (a, u, m), (b, v, k), (c, w, n) = (fill_middle.Scan(x, ends(x)).whole() for x in (data[:cut], data[cut:], data))
        assert (c[0] == b[0][a[0]]).all() and (w[0] == u[0] + v[0][a[0]]).all() and (n[0] == m[0] + k[0][a[0]]).all()


# -- flac -----------------------------------------------------------------------------------------


def payloads():
    r = random.Random(2)
    wave = (np.sin(np.arange(192 * 50) / 9) * 90 + 128).astype(np.uint8).tobytes()
    out = [b"abc def ".ljust(192), b" " * 192 * 13, bytes(r.randrange(256) for _ in range(192 * 30)), wave, bytes([0, 255]) * 96 * 7, "é中 prose, and more of it. ".encode() * 300]
    return [p.ljust(-(-len(p) // 192) * 192) for p in out]


def test_flac_round_trip():
    given = [b"", *payloads()]
    found = flac.decode(flac.encode(given))
    assert [d.pcm for d in found] == given
    assert found[2].starts == [1152 * k for k in range(len(found[2].starts))] == found[2].offsets
    wave = flac.encode(given)[4]
    assert len(wave) < len(given[4]) / 3  # predictors work
    kinds = {x[flac._read_header(x, i.first_frame, len(x), i).body] >> 1 & 63 for x in flac.encode(given)[1:] for i in [flac.info(x)]}
    assert {0, 1} < kinds and max(kinds) >= 8


def test_flac_finds_damage():
    r, stream = random.Random(3), flac.encode([payloads()[-1]])[0]
    start = flac.info(stream).first_frame
    for _ in range(200):
        m = bytearray(stream)
        m[r.randrange(start, len(m))] ^= 1 << r.randrange(8)
        with pytest.raises(ValueError):
            flac.decode([bytes(m)])
    for cut in (3, 10, 60, start + 40, len(stream) - 1):
        with pytest.raises(ValueError):
            flac.decode([stream[:cut]])


def test_flac_frames_of_a_batch_are_lanes_of_one_pass(monkeypatch):
    """A batch of the column's size, whose short last frames make more frames than its bytes alone."""
    r, passes, plain = random.Random(4), [], flac._subframes
    given = [bytes(r.randrange(97, 123) for _ in range(192 * r.randint(1, 60))) for _ in range(420)]
    media = flac.encode(given)
    assert flac.GROUP < sum(-(-len(p) // flac.FRAME) for p in given) < 2 * flac.GROUP
    monkeypatch.setattr(flac, "_subframes", lambda reader, at, *rest: passes.append(len(at)) or plain(reader, at, *rest))
    assert [d.pcm for d in flac.decode(media)] == given and len(passes) == 1


def test_flac_short_and_long_codes():
    """Codes of 16 bits are looked up, longer ones counted; both meet in one frame and in neighbours."""
    spiked = bytearray(b"\x80" * 1152 * 3)
    for at, x in ((7, 255), (300, 0), (1151, 200), (1152, 1), (2000, 140), (3455, 255)):
        spiked[at] = x
    steep = bytes(128 + (t % 40 == 0) * (t // 40) for t in range(1152))
    given = [bytes(spiked), steep, bytes(spiked)[:192], *payloads()]
    media = flac.encode(given)
    assert [d.pcm for d in flac.decode(media)] == given and len(media[0]) < 1152
    for k in range(16):
        for w in random.Random(k).sample(range(1 << 16), 300):
            q = 16 - w.bit_length()
            code = int(flac._short_codes()[k << 16 | w])
            if k == 15 or q + 1 + k > 16:
                assert code == 0
            else:
                u = q << k | w >> 16 - (q + 1 + k) & (1 << k) - 1
                assert (code & 31, code >> 5) == (q + 1 + k, -(u + 1) // 2 if u & 1 else u // 2)


@pytest.mark.parametrize("size", [0, 1, 2, 3, 50, 51])
def test_flac_sums_by_two_bytes(size):
    data = np.frombuffer(random.Random(size).randbytes(200), np.uint8)
    starts = np.array([0, 7, 120])
    ends = starts + np.array([size, size + 1, max(size - 2, 0)])
    plain = []
    for a, z in zip(starts, ends):
        c = 0
        for x in data[a:z]:
            for bit in range(7, -1, -1):
                c = (c << 1 ^ (0x8005 if (c >> 15) ^ (int(x) >> bit & 1) else 0)) & 0xFFFF
        plain.append(c)
    assert flac._crc16(data, starts, ends).tolist() == plain


class Writer:
    """Bits of a hand-made stream."""

    def __init__(self):
        self.bits = ""

    def put(self, value, width):
        self.bits += format(value & (1 << width) - 1, f"0{width}b") if width else ""

    def rice(self, value, k):
        u = 2 * value if value >= 0 else -2 * value - 1
        self.bits += "0" * (u >> k) + "1"
        self.put(u, k)

    def bytes(self):
        bits = self.bits + "0" * (-len(self.bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""


def residual(w, samples, order, coefs, shift, po, escape_at=None, five=False):
    """Partitioned Rice codes of a predictor's residual; one partition as plain numbers."""
    size = len(samples) >> po
    w.put(int(five), 2)
    w.put(po, 4)
    for p in range(1 << po):
        span = range(max(order, p * size), (p + 1) * size)
        guess = lambda t: sum(c * samples[t - 1 - j] for j, c in enumerate(coefs)) >> shift  # noqa: B023, E731
        if p == escape_at:
            w.put(31 if five else 15, 5 if five else 4)
            w.put(20, 5)
            for t in span:
                w.put(samples[t] - guess(t), 20)
        else:
            w.put(3 + p, 5 if five else 4)
            for t in span:
                w.rice(samples[t] - guess(t), 3 + p)


def stereo_stream(left, right, assignment):
    """16-bit stereo in two blocks, without seek points; fixed order 3, and a linear predictor with
    an escaped partition and wasted bits."""
    frames, n = [], len(left) // 2
    for k in range(2):
        x, y = left[k * n : (k + 1) * n], right[k * n : (k + 1) * n]
        side = [a - b for a, b in zip(x, y)]
        first, second = {8: (x, side), 9: (side, y), 10: ([(a + b) >> 1 for a, b in zip(x, y)], side), 1: (x, y)}[assignment]
        head = bytes([0xFF, 0xF8, 7 << 4 | 9, assignment << 4 | 4 << 1]) + flac._coded_number(k) + (n - 1).to_bytes(2, "big")
        w = Writer()
        for channel, s in enumerate((first, second)):
            deep = 16 + (assignment in (8, 10) and channel == 1 or assignment == 9 and channel == 0)
            waste = 2 if all(v % 4 == 0 for v in s) else 0
            s = [v >> waste for v in s]
            order, coefs, shift = (3, (3, -3, 1), 0) if channel == 0 else (2, (13, -6), 3)
            w.put((8 + order if channel == 0 else 31 + order) << 1 | bool(waste), 8)
            w.put(1, waste)
            for v in s[:order]:
                w.put(v, deep - waste)
            if channel:
                w.put(5 - 1, 4)
                w.put(shift, 5)
                for c in coefs:
                    w.put(c, 5)
            residual(w, s, order, coefs, shift, 2, escape_at=1 if channel else None, five=bool(channel))
        frame = head + bytes([flac._crc8(head)]) + w.bytes()
        crc = int(flac._crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
        frames.append(frame + crc.to_bytes(2, "big"))
    both = np.stack([left, right], 1).reshape(-1).astype("<i2").tobytes()
    packed = 44100 << 44 | 1 << 41 | 15 << 36 | len(left)
    info = n.to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + hashlib.md5(both).digest()
    return b"fLaC" + b"\x04\0\0\x03abc" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + b"".join(frames), both


@pytest.mark.parametrize("assignment", [1, 8, 9, 10])
def test_flac_of_other_writers(assignment):
    r = random.Random(assignment)
    left = [int(4000 * math.sin(t / 20)) + r.randint(-30, 30) for t in range(400)]
    right = [4 * (v // 8 + r.randint(-9, 9)) for v in left]
    stream, both = stereo_stream(left, right, assignment)
    found = flac.decode([stream, flac.encode(payloads()[:1])[0], stream])
    assert found[0].pcm == found[2].pcm == both and found[0].starts == [0, 200] and found[0].offsets == [0, 800]
    assert flac.read_range(stream, 150, 100) == both[600:1000]


def test_flac_columns(spark):
    rows = [(i, p) for i, p in enumerate(payloads())] + [(90, None), (91, b"")]
    made = spark.createDataFrame(rows, "k long, payload binary").repartition(3).withColumn("media", flac.encoded(F.col("payload")))
    blocks = sorted(map(tuple, flac.pcm_blocks(made, "k", "media").collect()))
    for k, p in rows:
        mine = [x for x in blocks if x[0] == k]
        assert [(x[1], x[2], x[3]) for x in mine] == [(i, 1152 * i, min(1152, len(p) - 1152 * i)) for i in range(-(-len(p or b"") // 1152))]
        assert b"".join(bytes(x[4]) for x in mine) == (p or b"")
    got = made.select("k", "payload", flac.sample_range(F.col("media"), 1000, 500).alias("r")).collect()
    assert all((x.r is None) if x.payload is None else bytes(x.r) == bytes(x.payload[1000:1500]) for x in got)


def test_flac_report(spark, marked):
    rows = [x for x in marked if x[0] is None or x[0] < 40] + [(500, "long text, " * 30_000)]
    got = flac.report(table_of(spark, rows)).collect()
    assert len(got) == len(rows)
    plain, by_text = collections.Counter(), {}
    for i, t in rows:
        b = (t or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        plain[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert collections.Counter((x.doc_id, x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) for x in got) == plain
    for x in got:
        assert by_text.setdefault(x.payload_sha256, (x.media_bytes, x.media_sha256, x.feature)) == (x.media_bytes, x.media_sha256, x.feature)
    assert flac.report(table_of(spark, [(1, "a")]).where("doc_id < 0")).count() == 0


# -- importance resampling --------------------------------------------------------------------------


def plain_draw(docs, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    found = [(i, *features(t)) for i, t in docs]
    s, t = collections.Counter(b for _, _, x in found for b in x), collections.Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, n, x in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((n, i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((k for k, x in enumerate(out) if x[0] >= least), key=lambda k: (-out[k][4], -1 if out[k][1] is None else out[k][1], out[k][2], out[k][3]))
    ranks = {k: j + 1 for j, k in enumerate(may[: percent * len(may) // 100])}
    return in_order((*x[1:], ranks.get(k)) for k, x in enumerate(out))


@pytest.fixture(scope="module")
def draw_rows():
    r = random.Random(3)
    words = ["alpha", "Beta", "gamma-ray", "é", "x1", "the", "中文"]
    texts = [None, "", " .,;", "One TWO é 中文 x_y", "a" * 5000] + [" ".join(r.choice(words) for _ in range(r.randint(1, 90))) for _ in range(150)]
    return list(enumerate(texts)) + [(7, texts[7])] * 40 + [(None, texts[9])] * 3, [texts[12], None, "the alpha alpha alpha"]


@pytest.mark.parametrize("longest, percent", [(1, 10), (3, 35)])
def test_draw_equals_plain(spark, draw_rows, monkeypatch, longest, percent):
    rows, bench = draw_rows
    monkeypatch.setattr(resampling, "COPIES", 7)
    target = spark.createDataFrame(list(enumerate(bench)), "doc_id long, text string")
    got = resampling.resample(table_of(spark, rows), target, longest=longest, percent=percent)
    assert in_order(got.collect()) == plain_draw(rows, bench, longest, percent=percent)


def test_draw_of_empty_tables(spark, draw_rows):
    docs = table_of(spark, draw_rows[0])
    none = docs.where("doc_id < 0")
    assert resampling.resample(none, docs).count() == 0
    assert in_order(resampling.resample(docs, none).collect()) == plain_draw(draw_rows[0], [])


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "Alpha beta é中, gamma " * 40
    known, sliced = resampling._Buckets(500), resampling._Buckets(500)
    want = [np.sort(resampling.stream(text.encode(), known, n)) for n in (1, 2, 3)]
    monkeypatch.setattr(resampling, "SLICE", 11)
    assert all((np.sort(resampling.stream(text.encode(), sliced, n)) == w).all() for n, w in zip((1, 2, 3), want))


def test_gathered_sums_skip_empty_documents(spark):
    rows = [(1, ""), (2, "a a"), (3, None), (4, "b"), (5, "")]
    packed = resampling.streams(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 1000)
    gain = np.arange(1000)
    a, b = (zlib.crc32(x) % 1000 for x in (b"a", b"b"))
    assert sorted((x.doc_id, x.n_features, x.weight) for x in resampling.weights(packed, gain).collect()) == [(1, 0, 0), (2, 2, 2 * a), (3, 0, 0), (4, 1, b), (5, 0, 0)]
    assert {r.bucket: r.n for r in resampling.bucket_counts(packed).collect()} == dict(collections.Counter([a, a, b]))


def test_carried_totals_are_used_by_rank(spark):
    df = spark.range(50).select((F.col("id") * 7 % 50).alias("k"))
    got = {r.k: r.before for r in carried(df, [F.col("k").asc()], {"before": F.col("k")}, 6).collect()}
    assert got == {k: k * (k - 1) // 2 for k in range(50)}
