"""Media columns: FLAC streams written, checked, decoded to PCM, and sought in.

`encode` stores bytes as 8-bit mono samples (a byte b is the sample b - 128) in frames of 1,152,
each a constant, verbatim, fixed-predictor or linear-predictor subframe with partitioned Rice
residuals; STREAMINFO has the MD5 of the samples, SEEKTABLE a point for each frame. `decode` reads
any stream of up to eight channels and 24 bits, verifies the CRC-8 of each frame's header, the CRC-16
of each frame and the MD5, and returns interleaved PCM (unsigned to 8 bits, else signed little-endian)
with the first sample and the first byte of each block; a seek is a search among the former.
`read_range` decodes just the frames that a range of samples touches.

Frames are lanes: numpy decodes one sample of each frame of a batch in a step, so the interpreter's
work goes with the samples of a frame, not with those of the batch. A stream's frames are found by
its seek points; between points that are far apart one frame leads to the next.

Defined results: null media or payloads stay null; an empty payload is a stream without frames and
decodes to no bytes; a stream that is damaged, cut off or not FLAC raises ValueError that says what
is wrong and never returns samples; a long stream is taken 2 * GROUP frames at a time, so memory follows
its bytes by a small factor; equal payloads give equal streams.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, text_of

FRAME, GROUP, ENCODE_GROUP = 1152, 2048, 256
LPC_ORDER, LPC_BITS, RATE = 4, 10, 8000
#: Payloads are padded by spaces to a positive multiple of this.
PAD_TO = 192
_MOST_PARTITIONS = 8
# The format's predictors, block sizes and sample sizes by code.
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
_SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for x in range(256):
        c = x << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) else 0)
            c &= (1 << bits) - 1
        out.append(c)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), np.array(_crc_table(0x8005, 16), np.uint16)
# What two bytes leave of a sum: that of the second one behind the first one's.
_CRC16_PAIRS = ((_CRC16[:, None] << np.uint16(8)) ^ _CRC16[(_CRC16[:, None] >> np.uint16(8)) ^ np.arange(256, dtype=np.uint16)]).ravel()


def _crc8(data: bytes) -> int:
    c = 0
    for x in data:
        c = _CRC8[c ^ x]
    return c


def _crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of many stretches of bytes at once, two bytes a step."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, left = starts[order], size[order]
    odd = left & 1
    c = np.zeros(len(order), np.uint16)
    alone = np.flatnonzero(odd)
    c[alone] = _CRC16[data[at[alone]]]
    at, left = at + odd, left >> 1
    pairs = np.zeros(len(data), np.uint16)
    pairs[:-1] = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
    # Stretches by falling size: those that have a j-th pair stand in front.
    going = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), side="right")
    for n in going.tolist():
        c[:n] = _CRC16_PAIRS[c[:n] ^ pairs[at[:n]]]
        at[:n] += 2
    out = np.empty_like(c)
    out[order] = c
    return out


# -- writing --------------------------------------------------------------------------------------


def _coded_number(n: int) -> bytes:
    """As UTF-8 has it, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    more = next(k for k in range(1, 7) if n < 1 << (6 * k + 6 - k if k < 6 else 36))
    lead = (0xFE << (6 - more)) & 0xFF
    return bytes([lead | n >> 6 * more, *(0x80 | n >> 6 * k & 0x3F for k in range(more - 1, -1, -1))])


def _header(number: int, size: int) -> bytes:
    code = next((k for k, x in _SIZES.items() if x == size), 7)
    rest = (size - 1).to_bytes(2, "big") if code == 7 else b""
    head = bytes([0xFF, 0xF8, code << 4 | 4, 1 << 1]) + _coded_number(number) + rest
    return head + bytes([_crc8(head)])


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantized predictor coefficients of each row of samples, and their shifts: Levinson's
    recursion on autocorrelations, on all rows at once."""
    m, n = x.shape
    t = np.arange(n)
    windowed = x * (1 - ((2 * t - n + 1) / (n + 1)) ** 2)
    r = [np.einsum("ij,ij->i", windowed[:, k:], windowed[:, : n - k]) for k in range(LPC_ORDER + 1)]
    error = r[0] * (1 + 1e-9) + 1e-9
    a = np.zeros((m, LPC_ORDER))
    for i in range(LPC_ORDER):
        k = (r[i + 1] - sum(a[:, j] * r[i - j] for j in range(i))) / error
        before = a.copy()
        a[:, i] = k
        for j in range(i):
            a[:, j] = before[:, j] - k * before[:, i - 1 - j]
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = np.frexp(np.abs(a).max(axis=1))[1]
    shift = np.clip(LPC_BITS - 1 - top, 0, 15)
    limit = 1 << (LPC_BITS - 1)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int64), shift.astype(np.int64)


class _Bits:
    """Fields of up to 32 bits written at given bits, many at once, by rising place. Fields don't overlap,
    so words are what their fields leave in them together."""

    def __init__(self, size: int):
        self.words = np.zeros(size // 4 + 3, np.uint32)

    def put(self, at: np.ndarray, value: np.ndarray, width: np.ndarray | int) -> None:
        if not len(at):
            return
        word, shifted = at >> 5, value.astype(np.uint64) << (64 - (at & 31) - width).astype(np.uint64)
        begin = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        both, word = np.bitwise_or.reduceat(shifted, begin), word[begin]
        self.words[word] |= (both >> np.uint64(32)).astype(np.uint32)
        self.words[word + 1] |= both.astype(np.uint32)

    def bytes(self) -> np.ndarray:
        return self.words.astype(">u4").view(np.uint8)


def _frames(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """A frame for each row of 8-bit samples (signed); rows have one length."""
    m, n = x.shape
    x = x.astype(np.int32)
    heads = [_header(k, n) for k in numbers]
    # Candidates' residuals: fixed orders 0 to 4, then the linear predictor.
    candidates, d = [x], x
    for order in range(1, 5):
        d, before = np.zeros_like(x), d
        np.subtract(before[:, order:], before[:, order - 1 : -1], out=d[:, order:])
        candidates.append(d)
    coefs, shift = _linear(x)
    guess = np.zeros_like(x)
    for j in range(LPC_ORDER):
        guess[:, j + 1 :] += coefs[:, j, None].astype(np.int32) * x[:, : n - j - 1]
    candidates.append(x - (guess >> shift[:, None].astype(np.int32)))
    candidates[5][:, :LPC_ORDER] = 0
    orders = [0, 1, 2, 3, 4, LPC_ORDER]
    extra = np.array([8 * o for o in orders]) + np.array([0] * 5 + [9 + LPC_BITS * LPC_ORDER])
    mean = np.stack([np.abs(c[:, o:]).sum(axis=1, dtype=np.int32) / (n - o) for c, o in zip(candidates, orders)])
    kind = np.argmin(n * np.log2(2 * mean + 1) + extra[:, None], axis=0)
    order = np.array(orders)[kind]
    res = np.empty_like(x)
    for k, c in enumerate(candidates):
        rows = np.flatnonzero(kind == k)
        res[rows] = c[rows]
    folded = res << 1 ^ res >> 31
    t = np.arange(n)
    folded[:, :LPC_ORDER][t[:LPC_ORDER] < order[:, None]] = 0  # these samples are no codes
    # Bits of each of the smallest partitions with each parameter, then of joined ones.
    parts = _MOST_PARTITIONS
    each = np.full((m, parts), n // parts)
    each[:, 0] -= order
    most = max(1, int(folded.max()).bit_length())
    halved, cost = folded.copy(), []
    for k in range(most):
        cost.append(each * (k + 1) + halved.reshape(m, parts, -1).sum(axis=2, dtype=np.int32))
        halved >>= 1
    cost = np.stack(cost)
    best = []
    for po in range(parts.bit_length()):
        joined = cost.reshape(most, m, 1 << po, -1).sum(axis=3)
        best.append((joined.min(axis=0).sum(axis=1) + (4 << po), joined.argmin(axis=0)))
    po = np.argmin(np.stack([b for b, _ in best]), axis=0)
    size = np.take_along_axis(np.stack([b for b, _ in best]), po[None], 0)[0] + 6 + extra[kind]
    same = (x == x[:, :1]).all(axis=1)
    raw = ~same & (size >= 8 * n)
    rice = ~same & ~raw
    body = 8 + np.where(same, 8, np.where(raw, 8 * n, size))
    head_bits = 8 * np.array([len(h) for h in heads])
    whole = (head_bits + body + 7) // 8 + 2
    ends = np.cumsum(whole)
    starts = ends - whole
    out = _Bits(int(ends[-1]))
    at = 8 * starts + head_bits
    code = np.where(same, 0, np.where(raw, 1, np.where(kind < 5, 8 + order, 32 + LPC_ORDER - 1)))
    out.put(at, code << 1, 8)
    at = at + 8
    out.put(at[same], x[same, 0] & 255, 8)
    i = np.flatnonzero(raw)
    out.put((at[i, None] + 8 * t).ravel(), (x[i] & 255).ravel(), 8)
    for o in range(LPC_ORDER):
        i = np.flatnonzero(rice & (order > o))
        out.put(at[i] + 8 * o, x[i, o] & 255, 8)
    at = at + 8 * order
    i = np.flatnonzero(rice & (kind == 5))
    out.put(at[i], np.full(len(i), (LPC_BITS - 1) << 5) | shift[i], 9)
    for j in range(LPC_ORDER):
        out.put(at[i] + 9 + LPC_BITS * j, coefs[i, j] & ((1 << LPC_BITS) - 1), LPC_BITS)
    at[i] += 9 + LPC_BITS * LPC_ORDER
    i = np.flatnonzero(rice)
    if len(i):
        out.put(at[i], po[i], 6)  # two bits of the method, 0, and four of the order
        parameter = np.stack([np.repeat(k, parts >> p, axis=1) for p, (_, k) in enumerate(best)])[po, np.arange(m)][i].astype(np.int32)
        k, u = np.repeat(parameter, n // parts, axis=1), folded if len(i) == m else folded[i]
        q = u >> k
        width = q + (k + 1)
        value = 1 << k | u - (q << k)
        head = t[:LPC_ORDER] < order[i, None]
        width[:, :LPC_ORDER][head] = 0
        value[:, :LPC_ORDER][head] = 0
        # A partition begins by four bits of its parameter.
        step = n // parts
        first = t[::step] % (n >> po[i])[:, None] == 0
        width[:, ::step] += 4 * first
        place = np.cumsum(width, axis=1, dtype=np.int64) - width + (at[i, None] + 6)
        out.put(place[:, ::step][first], parameter[first], 4)
        place[:, ::step] += 4 * first
        # A code is q noughts, a one, and the k low bits: a number of k + 1 bits behind noughts.
        out.put((place + q).ravel(), value.ravel(), (k + 1).ravel())
    data = out.bytes()[: ends[-1]]
    for s, h in zip(starts.tolist(), heads):
        data[s : s + len(h)] = np.frombuffer(h, np.uint8)
    crc = _crc16(data, starts, ends - 2)
    data[ends - 2], data[ends - 1] = crc >> 8, crc & 255
    whole_bytes = data.tobytes()
    return [whole_bytes[a:z] for a, z in zip(starts.tolist(), ends.tolist())]


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    signed = np.frombuffer(payload, np.uint8) ^ 128
    sizes = [len(f) for f in frames] or [0]
    packed = RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
    info = FRAME.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed.tobytes()).digest()
    points, at = [], 0
    for k, f in enumerate(frames):
        points.append((k * FRAME).to_bytes(8, "big") + at.to_bytes(8, "big") + min(FRAME, len(payload) - k * FRAME).to_bytes(2, "big"))
        at += len(f)
    table = b"".join(points)
    return b"".join([b"fLaC", bytes([0]), len(info).to_bytes(3, "big"), info, bytes([0x83]), len(table).to_bytes(3, "big"), table, *frames])


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload. Frames of one length are made together, ENCODE_GROUP at a time."""
    made: list[list] = [[None] * -(-len(p) // FRAME) for p in payloads]
    by_size: dict[int, list] = {}
    for i, p in enumerate(payloads):
        for k in range(len(made[i])):
            by_size.setdefault(min(FRAME, len(p) - k * FRAME), []).append((i, k))
    for size, places in by_size.items():
        if size % _MOST_PARTITIONS or size // _MOST_PARTITIONS < LPC_ORDER:
            raise ValueError(f"a payload's bytes must be a multiple of {PAD_TO}")
        for a in range(0, len(places), ENCODE_GROUP):
            group = places[a : a + ENCODE_GROUP]
            rows = np.frombuffer(b"".join(payloads[i][k * FRAME : k * FRAME + size] for i, k in group), np.uint8).reshape(-1, size)
            for (i, k), f in zip(group, _frames(rows.astype(np.int16) - 128, [k for _, k in group])):
                made[i][k] = f
    return [_stream(p, f) for p, f in zip(payloads, made)]


# -- reading --------------------------------------------------------------------------------------


@dataclass
class Info:
    """What a stream's metadata say; points are (first sample, byte from the first frame, samples)."""

    rate: int
    channels: int
    depth: int
    samples: int
    md5: bytes
    points: list[tuple[int, int, int]] = field(default_factory=list)
    first_frame: int = 0


def info(stream: bytes) -> Info:
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, found, points = 4, False, None, []
    while not last:
        if at + 4 > len(stream):
            raise ValueError("FLAC metadata are cut off")
        last, kind, size = stream[at] >= 128, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if len(body) < size:
            raise ValueError("FLAC metadata are cut off")
        if kind == 0:
            x = int.from_bytes(body[10:18], "big")
            found = Info(x >> 44, (x >> 41 & 7) + 1, (x >> 36 & 31) + 1, x & (1 << 36) - 1, body[18:34])
        elif kind == 3:
            for p in range(0, size, 18):
                point = int.from_bytes(body[p : p + 8], "big"), int.from_bytes(body[p + 8 : p + 16], "big"), int.from_bytes(body[p + 16 : p + 18], "big")
                if point[0] != (1 << 64) - 1:
                    points.append(point)
    if found is None:
        raise ValueError("a FLAC stream without STREAMINFO")
    found.points, found.first_frame = points, at
    return found


@dataclass
class _Frame:
    """A frame to decode: where it is in the batch's bytes, and what its header says."""

    at: int
    body: int
    size: int
    assignment: int
    depth: int
    number: int
    by_sample: bool

    @property
    def channels(self) -> int:
        return self.assignment + 1 if self.assignment < 8 else 2


def _read_header(data: bytes, at: int, end: int, about: Info) -> _Frame:
    if at + 6 > end or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError("no FLAC frame where one must begin")
    size_code, rate_code, assignment, depth_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    p, lead = at + 4, data[at + 4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead if not more else lead & (1 << (6 - more)) - 1 if more < 6 else 0
    for x in data[p + 1 : p + 1 + more]:
        number = number << 6 | x & 0x3F
    p += 1 + more
    if size_code in (6, 7):
        size = int.from_bytes(data[p : p + size_code - 5], "big") + 1
        p += size_code - 5
    else:
        size = _SIZES.get(size_code, 0)
    p += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    depth = _DEPTHS.get(depth_code, about.depth if depth_code == 0 else 0)
    if p >= end or not size or not depth or assignment > 10 or rate_code == 15:
        raise ValueError("a FLAC frame's header is cut off or reserved")
    if _crc8(data[at:p]) != data[p]:
        raise ValueError("a FLAC frame's header fails its CRC-8")
    return _Frame(at, p + 1, size, assignment, depth, number, bool(data[at + 1] & 1))


_ONE_BIT, _TOP_16, _LOW_16 = np.uint64(1), np.uint64(48), np.uint64((1 << 16) - 1)
_LEADING = np.array([16 if x == 0 else 16 - x.bit_length() for x in range(1 << 16)], np.int64)


@functools.cache
def _short_codes() -> np.ndarray:
    """Of each Rice parameter up to 14 and next 16 bits: the value of a code that ends in these, times 32,
    and its bits; 0 where it doesn't. So it is for parameter 15, which stands for all larger ones."""
    out, w = np.zeros((16, 1 << 16), np.int32), np.arange(1 << 16)
    for k in range(15):
        used = _LEADING + 1 + k
        u = _LEADING << k | w >> np.maximum(16 - used, 0) & (1 << k) - 1
        out[k] = np.where(used <= 16, ((u >> 1) ^ -(u & 1)) << 5 | used, 0)
    return out.ravel()


class _Reader:
    """Bits of a batch's bytes, read at many places at once. Noughts stand behind them, more than a
    damaged frame can run through before it is found out."""

    def __init__(self, data: bytes):
        self.data = data
        padded = np.frombuffer(data + bytes(1 << 19), np.uint8)
        self.eight = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,)).astype(np.uint64)
        self.most = 8 * len(data)

    def window(self, at: np.ndarray) -> np.ndarray:
        """The 57 bits or more from each place, at the top of 64."""
        return self.eight[at >> 3] << (at & 7).view(np.uint64)

    def bits(self, at: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Whole numbers of up to 57 bits."""
        return (self.window(at) >> _ONE_BIT >> (63 - width).view(np.uint64)).view(np.int64)

    def codes(self, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Noughts before the next one, and the number of so many bits behind that."""
        window = self.window(at)
        lead = _LEADING[(window >> _TOP_16).view(np.int64)]
        if lead.max(initial=0) == 16:
            far = np.flatnonzero(lead == 16)
            while len(far):
                if (at[far] + lead[far] >= self.most).any():
                    raise ValueError("a FLAC frame runs past its stream")
                more = _LEADING[(self.window(at[far] + lead[far]) >> _TOP_16).view(np.int64)]
                lead[far] += more
                far = far[more == 16]
            return lead, self.bits(at + lead + 1, width)
        return lead, (window << (lead + 1).view(np.uint64) >> _ONE_BIT >> (63 - width).view(np.uint64)).view(np.int64)

    def one(self, at: int, width: int) -> int:
        chunk = int.from_bytes(self.data[at >> 3 : (at + width + 7) >> 3], "big")
        return chunk >> (-(at + width) % 8) & (1 << width) - 1

    def one_signed(self, at: int, width: int) -> int:
        x = self.one(at, width)
        return x - (1 << width) if width and x >> (width - 1) else x


def _subframes(reader: _Reader, at: list[int], sizes: list[int], depths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """One subframe of each of many frames: samples (a row a frame), and the bits behind them. Every kind is a predictor with a residual: a constant has no residual, a
    verbatim one no predictor."""
    m, top = len(at), max(sizes)
    coefs, taps = np.zeros((32, m), np.int64), np.zeros((32, m), np.int64)
    order, shift, wasted = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    constant, fixed = np.zeros(m, bool), np.zeros(m, np.int64)
    length, escape, five = np.full(m, 1 << 40, np.int64), np.full(m, -1, np.int64), np.zeros(m, np.int64)
    place = np.zeros(m, np.int64)
    for i, (p, n, depth) in enumerate(zip(at, sizes, depths)):
        head = reader.one(p, 8)
        p, kind = p + 8, head >> 1 & 63
        if head >> 7:
            raise ValueError("a FLAC subframe's header is not valid")
        if head & 1:
            while not reader.one(p, 1) and p < reader.most:
                p, wasted[i] = p + 1, wasted[i] + 1
            p, wasted[i] = p + 1, wasted[i] + 1
            depth -= int(wasted[i])
        if kind == 0:
            constant[i], fixed[i], escape[i] = True, reader.one_signed(p, depth), 0
            p += depth
        elif kind == 1:
            escape[i] = depth
        elif 8 <= kind <= 12 or kind >= 32:
            o = order[i] = kind - 8 if kind < 32 else kind - 31
            if o > n:
                raise ValueError("a FLAC predictor is longer than its block")
            for j in range(o):  # the latest sample is tap 0
                taps[o - 1 - j, i] = reader.one_signed(p + depth * j, depth)
            p += int(depth * o)
            if kind < 32:
                coefs[:o, i] = _FIXED[o]
            else:
                bits, shift[i] = reader.one(p, 4) + 1, reader.one_signed(p + 4, 5)
                if bits == 16 or shift[i] < 0:
                    raise ValueError("a FLAC predictor's precision or shift is not valid")
                for j in range(o):
                    coefs[j, i] = reader.one_signed(p + 9 + bits * j, bits)
                p += int(9 + bits * o)
            method, po = reader.one(p, 2), reader.one(p + 2, 4)
            if method > 1 or n % (1 << po):
                raise ValueError("a FLAC residual's coding is not valid")
            five[i], length[i] = method, n >> po
            p += 6
        else:
            raise ValueError("a FLAC subframe's type is reserved")
        place[i] = p
    high = int(order.max(initial=0))
    # Samples stand below `high` rows of history, the earliest on top. Up to 12 bits a prediction of 32
    # taps of 15 bits fits in 32 bits.
    kind = np.int32 if max(depths) <= 12 else np.int64
    out = np.zeros((high + top, m), kind)
    size = np.array(sizes)
    for j in range(high):
        rows = np.flatnonzero(order > j)
        out[high + order[rows] - 1 - j, rows] = taps[j, rows]
    lanes = np.argsort(-size, kind="stable")  # long frames first, so that those that go on stand in front
    out, place, order, shift, length, escape, five, coefs = (x[..., lanes] for x in (out, place, order, shift, length, escape, five, coefs))
    going = np.searchsorted(-size[lanes], -np.arange(1, top + 1), side="right")
    coefs, shift = coefs.astype(kind), shift.astype(kind)
    parameter, one = np.zeros(m, np.int64), np.int64(1)
    short, table, last = np.zeros(m, np.int64), _short_codes(), np.uint64(48)
    due, verbatim = np.where(length < 1 << 40, 0, top + 1), (escape >= 0).any()
    escaped = verbatim
    for t, n in enumerate(going.tolist()):
        start = np.flatnonzero(due[:n] == t)
        if len(start):
            wide = 4 + five[start]
            parameter[start] = reader.bits(place[start], wide)
            place[start] += wide
            due[start] += length[start]
            short[start] = np.minimum(parameter[start], 15) << 16
            out_of = parameter[start] == (one << wide) - 1
            escape[start] = -1
            if out_of.any():
                rows = start[out_of]
                escape[rows] = reader.bits(place[rows], np.full(len(rows), 5))
                place[rows] += 5
                escaped = True
        k, p = parameter[:n], place[:n]
        if escaped:
            q, low = np.zeros(n, np.int64), np.zeros(n, np.int64)
            rice = np.flatnonzero((escape[:n] < 0) & (order[:n] <= t))
            q[rice], low[rice] = reader.codes(p[rice], k[rice])
            u = q << k | low
            value, used = (u >> 1) ^ -(u & 1), q + 1 + k
            rows = np.flatnonzero(escape[:n] >= 0)
            width = escape[rows]
            x = reader.bits(p[rows], width)
            value[rows] = np.where((width > 0) & (x >> np.maximum(width - 1, 0) > 0), x - (one << width), x)
            used[rows] = width
        else:
            bits = reader.eight.take(p >> 3) >> (last - (p & 7).view(np.uint64))
            code = table.take((bits & _LOW_16).view(np.int64) | short[:n])
            used, value = code & 31, (code >> 5).astype(kind, copy=False)
            if not used.all():  # long codes; a lane's first samples are no codes
                rows = np.flatnonzero((used == 0) & (order[:n] <= t))
                q, low = reader.codes(p[rows], k[rows])
                u = q << k[rows] | low
                value[rows], wide = (u >> 1) ^ -(u & 1), q + 1 + k[rows]
                used = used.astype(np.int64)
                used[rows] = wide
        if high:
            guess = coefs[0, :n] * out[high + t - 1, :n]
            for j in range(1, high):
                guess += coefs[j, :n] * out[high + t - 1 - j, :n]
            value += guess >> shift[:n]
        if t < high:
            skip = order[:n] > t
            value, used = np.where(skip, out[high + t, :n], value), np.where(skip, 0, used)
        out[high + t, :n] = value
        place[:n] += used
    samples, ends = np.empty((m, top), kind), np.empty(m, np.int64)
    samples[lanes], ends[lanes] = out[high:].T, place
    if constant.any():
        samples[constant] = fixed[constant, None]
    if (ends > reader.most).any():
        raise ValueError("a FLAC frame runs past its stream")
    return samples << wasted[:, None].astype(kind) if wasted.any() else samples, ends


def _decode_frames(reader: _Reader, frames: list[_Frame]) -> tuple[list[np.ndarray], list[int]]:
    """Samples of each frame, a row a channel, and the byte behind it; each frame's CRC-16 holds."""
    at, found = [8 * f.body for f in frames], [[] for _ in frames]
    for channel in range(max(f.channels for f in frames)):
        rows = [i for i, f in enumerate(frames) if f.channels > channel]
        side = lambda f: f.assignment in (8, 10) and channel == 1 or f.assignment == 9 and channel == 0  # noqa: B023, E731
        samples, ends = _subframes(reader, [at[i] for i in rows], [frames[i].size for i in rows], [frames[i].depth + side(frames[i]) for i in rows])
        for j, i in enumerate(rows):
            found[i].append(samples[j, : frames[i].size])
            at[i] = int(ends[j])
    ends = np.array([(x + 7) // 8 for x in at])
    data = np.frombuffer(reader.data, np.uint8)
    if (ends + 2 > len(data)).any():
        raise ValueError("a FLAC frame is cut off")
    told = data[ends].astype(np.uint16) << 8 | data[ends + 1]
    if (_crc16(data, np.array([f.at for f in frames]), ends) != told).any():
        raise ValueError("a FLAC frame fails its CRC-16")
    out = []
    for f, x in zip(frames, found):
        if f.assignment == 8:
            x[1] = x[0] - x[1]
        elif f.assignment == 9:
            x[0] = x[0] + x[1]
        elif f.assignment == 10:
            middle = x[0] << 1 | x[1] & 1
            x[0], x[1] = (middle + x[1]) >> 1, (middle - x[1]) >> 1
        out.append(np.stack(x))
    return out, (ends + 2).tolist()


def _signed(samples: np.ndarray, depth: int) -> bytes:
    """Interleaved, signed little-endian in whole bytes."""
    flat, wide = samples.T.reshape(-1), -(-depth // 8)
    return flat.astype(np.int8).tobytes() if wide == 1 else flat.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :wide].tobytes()


def pcm(samples: np.ndarray, depth: int) -> bytes:
    """Interleaved; up to 8 bits unsigned, else signed little-endian in whole bytes."""
    return (samples.T.reshape(-1) + 128).astype(np.uint8).tobytes() if depth <= 8 else _signed(samples, depth)


@dataclass
class Decoded:
    """A stream's PCM; block k has the samples from starts[k], its bytes from offsets[k] on."""

    info: Info
    pcm: bytes
    starts: list[int]
    offsets: list[int]


def _walk(streams: list[bytes], about: list[Info], cursors: list[tuple[int, int, int]]) -> list[list[tuple[int, np.ndarray]]]:
    """Frames from each cursor (stream, byte, end byte) on, 2 * GROUP cursors at a time; for each cursor
    its frames' first samples (or numbers times sizes) and samples. Each round decodes a frame of
    each cursor."""
    out: list[list] = [[] for _ in cursors]
    for a in range(0, len(cursors), 2 * GROUP):
        group = cursors[a : a + 2 * GROUP]
        base, pieces, total = {}, [], 0
        for k, (s, at, end) in enumerate(group):
            base[k] = total - at
            pieces.append(streams[s][at:end])
            total += end - at
        reader, at = _Reader(b"".join(pieces)), [x for _, x, _ in group]
        open_ = [k for k, (_, x, end) in enumerate(group) if x < end]
        while open_:
            frames = [_read_header(reader.data, base[k] + at[k], base[k] + group[k][2], about[group[k][0]]) for k in open_]
            samples, ends = _decode_frames(reader, frames)
            for k, f, x, end in zip(open_, frames, samples, ends):
                at[k] = end - base[k]
                if at[k] > group[k][2]:
                    raise ValueError("a FLAC frame runs past its stream")
                out[a + k].append((f.number if f.by_sample else -1, x))
            open_ = [k for k in open_ if at[k] < group[k][2]]
    return out


def _cursors(s: int, stream: bytes, x: Info) -> list[tuple[int, int, int]]:
    """Where frames are known to begin: the first one, and the seek points."""
    known = sorted({x.first_frame, *(x.first_frame + at for _, at, _ in x.points if x.first_frame + at < len(stream))})
    return [(s, a, z) for a, z in zip(known, [*known[1:], len(stream)]) if a < z]


def decode(streams: list[bytes]) -> list[Decoded]:
    about = [info(x) for x in streams]
    cursors = [c for s, (x, i) in enumerate(zip(streams, about)) for c in _cursors(s, x, i)]
    found: list[list] = [[] for _ in streams]
    for (s, _, _), frames in zip(cursors, _walk(streams, about, cursors)):
        found[s].extend(x for _, x in frames)
    out = []
    for x, frames in zip(about, found):
        starts, offsets, digest, parts, n, size = [], [], hashlib.md5(), [], 0, 0
        for f in frames:
            starts.append(n)
            offsets.append(size)
            part = pcm(f, x.depth)
            digest.update(_signed(f, x.depth))
            parts.append(part)
            n, size = n + f.shape[1], size + len(part)
        if x.samples and n != x.samples:
            raise ValueError(f"a FLAC stream has {n} samples, not {x.samples}")
        if any(x.md5) and digest.digest() != x.md5:
            raise ValueError("a FLAC stream fails its MD5")
        out.append(Decoded(x, b"".join(parts), starts, offsets))
    return out


def read_range(stream: bytes, first: int, count: int) -> bytes:
    """PCM of the samples from first on, by the seek point before them; fewer at the stream's end."""
    x = info(stream)
    start, at = max(((p, x.first_frame + b) for p, b, _ in x.points if p <= first), default=(0, x.first_frame))
    later = [x.first_frame + b for p, b, _ in x.points if p >= first + count]
    parts, n = [], start
    for _, f in _walk([stream], [x], [(0, at, min(later, default=len(stream)))])[0] if count > 0 and at < len(stream) else []:
        size = f.shape[1]
        a, z = max(first - n, 0), min(first + count - n, size)
        if a < z:
            parts.append(pcm(f[:, a:z], x.depth))
        n += size
    return b"".join(parts)


# -- columns --------------------------------------------------------------------------------------


def _each(column, work, kind):
    """work on the values that aren't null, a few MB of them at a time."""
    import pyarrow as pa

    out, group, places, size = [None] * len(column), [], [], 0

    def run() -> None:
        for i, x in zip(places, work(group)):
            out[i] = x

    for i, x in enumerate(column):
        if x.is_valid:
            group.append(x.as_py())
            places.append(i)
            size += len(group[-1])
            if size > GROUP * FRAME:
                run()
                group, places, size = [], [], 0
    run()
    return pa.array(out, kind)


def encoded(payload: Column) -> Column:
    """The FLAC stream of a binary column, whose bytes are a multiple of PAD_TO."""

    @F.arrow_udf("binary")
    def flac_encode(x):
        import pyarrow as pa

        return _each(x, encode, pa.binary())

    return flac_encode(payload)


def _feature(d: Decoded) -> str:
    """Blocks, largest sample, sum of samples' sizes and changes of sign, of 8-bit PCM."""
    x = np.frombuffer(d.pcm, np.uint8).astype(np.int64) - 128
    signs = x < 0
    return f"blocks={len(d.starts)};peak={np.abs(x).max(initial=0)};sum={np.abs(x).sum()};crossings={np.count_nonzero(signs[1:] != signs[:-1])}"


def decoded(media: Column) -> Column:
    """pcm, the first sample and byte of each block, and for up to 8 bits a feature string."""
    shape = "struct<pcm: binary, channels: int, depth: int, starts: array<long>, offsets: array<long>, feature: string>"

    @F.arrow_udf(shape)
    def flac_decode(x):
        import pyarrow as pa

        kind = pa.struct([("pcm", pa.binary()), ("channels", pa.int32()), ("depth", pa.int32()), ("starts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("feature", pa.string())])
        row = lambda d: {"pcm": d.pcm, "channels": d.info.channels, "depth": d.info.depth, "starts": d.starts, "offsets": d.offsets, "feature": _feature(d) if d.info.depth <= 8 else None}
        return _each(x, lambda group: map(row, decode(group)), kind)

    return flac_decode(media)


def sample_range(media: Column, first: Column | int, count: Column | int) -> Column:
    """PCM of a range of samples; only the frames that it touches are decoded."""

    @F.arrow_udf("binary")
    def flac_range(x, a, n):
        import pyarrow as pa

        return pa.array([read_range(m.as_py(), i.as_py(), k.as_py()) if m.is_valid and i.is_valid and k.is_valid else None for m, i, k in zip(x, a, n)], pa.binary())

    as_long = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("long")
    return flac_range(media, as_long(first), as_long(count))


def pcm_blocks(rows: DataFrame, key: str, media: str) -> DataFrame:
    """key, block, sample_offset, samples and pcm: a row for each frame of each stream."""
    modest_batches(rows.sparkSession)
    one = rows.select(F.col(key), decoded(F.col(media)).alias("d")).where(F.col("d").isNotNull())
    wide = F.col("d.channels") * F.ceil(F.col("d.depth") / 8)
    cut = one.select(key, F.posexplode("d.offsets").alias("block", "at"), "d", wide.alias("wide"))
    end = F.coalesce(F.get("d.offsets", F.col("block") + 1), F.octet_length("d.pcm").cast("long"))
    return cut.select(
        key, "block", F.get("d.starts", F.col("block")).alias("sample_offset"), ((end - F.col("at")) / F.col("wide")).cast("long").alias("samples"),
        F.substring("d.pcm", (F.col("at") + 1).cast("int"), (end - F.col("at")).cast("int")).alias("pcm"),
    )


def payload(text: Column) -> Column:
    """The text's bytes, filled up by spaces to a positive multiple of PAD_TO."""
    size = F.greatest(F.lit(PAD_TO), (F.ceil(F.octet_length(text) / PAD_TO) * PAD_TO).cast("int"))
    return F.rpad(text.cast("binary"), size, F.lit(b" "))


def report(docs: DataFrame) -> DataFrame:
    """Each text stored as FLAC, and what its stored bytes give when they are read back."""
    modest_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    stored = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), payload(F.col("text")).alias("payload")).select("doc_id", "n_bytes", encoded(F.col("payload")).alias("media"))
    back = stored.withColumn("d", decoded(F.col("media"))).select("doc_id", "n_bytes", "media", F.col("d.pcm").alias("pcm"), "d.feature")
    size = F.octet_length("pcm")
    return back.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", size - 15, F.lit(16))).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
