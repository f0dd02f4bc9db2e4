"""FLAC columns: 8-bit mono streams written and read in numpy, many frames at once.

Writing: frames of 1024 samples; for each the cheapest of a constant, raw samples, fixed predictors and a quantized linear
predictor of order 8, with Rice-coded residuals in partitions. A seek table has a point for every frame.
Reading: frames are found by the seek table (one after the other where it is missing); headers, predictors and Rice codes
of all frames are decoded in step, one sample of every frame at a time; CRC-8 of headers, CRC-16 of frames and the MD5 of
the samples are verified. The outcome are PCM blocks with the sample and byte offset at which each can be sought.

Scale: every stream is handled in the task that has its row; nothing is shuffled or written. Memory follows slices of
SLICE bytes (or one text). Equal payloads give equal streams: all choices rest on integers and elementwise arithmetic.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapgraph.llm.texts import slices

BLOCK, ORDER, PRECISION, RATE = 1024, 8, 12, 8000
SLICE = 2_000_000
UNIT = 64  # payloads are filled up with zeros to a positive multiple
#: Fixed values of the format: predictors by order, newest sample first.
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
_CONSTANT, _VERBATIM = 0, 1


class FlacError(ValueError):
    """A stream that is damaged or of a kind that is not supported."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, out = 1 << (bits - 1), []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ poly if c & top else c << 1
        out.append(c & ((1 << bits) - 1))
    return np.array(out, np.uint16 if bits == 16 else np.uint8)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_PIECE = 2048
_FAR = np.zeros((_PIECE, 256), np.uint16)  # by bytes that follow and byte: its share of the CRC-16
_FAR[0] = _CRC16
for _i in range(1, _PIECE):
    _FAR[_i] = (_FAR[_i - 1] << 8) ^ _CRC16[_FAR[_i - 1] >> 8]


def crc16(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of each span of ``data``; pieces of a span are chained by their linearity."""
    out = np.zeros(len(begin), np.uint16)
    at = begin.astype(np.int64)
    while True:
        lane = np.flatnonzero(at < end)
        if not len(lane):
            return out
        n = np.minimum(end[lane] - at[lane], _PIECE)
        stop = np.cumsum(n)
        inner = np.arange(stop[-1]) - np.repeat(stop - n, n)
        byte = data[np.repeat(at[lane], n) + inner]
        head = inner == 0
        byte[head] ^= (out[lane] >> 8).astype(np.uint8)
        second = inner == 1
        byte[second] ^= (out[lane[n > 1]] & 255).astype(np.uint8)
        rest = np.where(n == 1, (out[lane] & 255) << 8, 0).astype(np.uint16)
        out[lane] = np.bitwise_xor.reduceat(_FAR[np.repeat(n, n) - 1 - inner, byte], stop - n) ^ rest
        at[lane] += n


def crc8(header: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-8 of the first ``size`` bytes of each row."""
    out = np.zeros(len(header), np.uint8)
    for j in range(header.shape[1]):
        out = np.where(j < size, _CRC8[out ^ header[:, j]], out)
    return out


def _numbers(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers as the format writes them (like UTF-8, up to 6 bytes): bytes and how many."""
    size = 1 + sum((n >= x).astype(int) for x in (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26))
    out = np.zeros((len(n), 6), np.uint8)
    for s in range(1, 7):
        rows = size == s
        if rows.any():
            v = n[rows]
            for j in range(s - 1, 0, -1):
                out[rows, j] = 0x80 | (v & 0x3F)
                v = v >> 6
            out[rows, 0] = v if s == 1 else ((0xFF << (8 - s)) & 0xFF) | v
    return out, size


def _levinson(x: np.ndarray) -> np.ndarray:
    """Predictor coefficients of each row of ``x``, by integer autocorrelation; zeros where there is nothing to predict."""
    n = x.shape[1]
    ac = [np.einsum("ij,ij->i", x[:, : n - i], x[:, i:]).astype("f8") for i in range(ORDER + 1)]
    a, err = np.zeros((ORDER, len(x))), ac[0].copy()
    for i in range(ORDER):
        acc = ac[i + 1].copy()
        for j in range(i):
            acc -= a[j] * ac[i - j]
        k = np.divide(acc, err, out=np.zeros_like(acc), where=err > 1e-6)
        before = a[:i].copy()
        for j in range(i):
            a[j] -= k * before[i - 1 - j]
        a[i] = k
        err = err * (1 - k * k)
    return a


def _zigzag(r: np.ndarray) -> np.ndarray:
    return ((r << 1) ^ (r >> 31)).astype(np.uint16)


def _frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoded frames of rows ``x`` (int32 samples, one length): all bytes, and the size of each frame."""
    rows, n = x.shape
    a = _levinson(x)
    most = np.abs(a).max(0)
    shift = np.where(most < 1.99, 10, np.where(most < 3.98, 9, 8))
    q = np.clip(np.rint(a * (1 << shift)), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int32)
    order = min(ORDER, n - 1)
    q[order:] = 0
    residuals = [(0, x)]
    for o in (1, 2):
        residuals.append((o, np.diff(x, n=o, axis=1)))
    guess = np.zeros((rows, n - order), np.int32)
    for j in range(order):
        guess += q[j][:, None] * x[:, order - 1 - j : n - 1 - j]
    residuals.append((order, x[:, order:] - (guess >> shift[:, None].astype(np.int32))))

    split = 2 if n >= 256 and n % 4 == 0 else 0
    part = n >> split
    us = [_zigzag(r) for _, r in residuals]
    ks = range(1, 9)
    fixed = np.array([8 * o + 6 + 4 * (1 << split) for o, _ in residuals])
    fixed[-1] += 9 + PRECISION * order
    cost = np.stack([fixed[i] + np.min([(u >> k).sum(1, dtype=np.int64) + (1 + k) * u.shape[1] for k in ks], axis=0) for i, u in enumerate(us)])
    best = cost.argmin(0)
    raw = cost.min(0) >= 8 * n
    same = (x == x[:, :1]).all(1)
    rice = ~raw & ~same

    value = np.zeros((rows, n), np.uint16)
    orders = np.zeros(rows, np.int64)
    for i, (o, _) in enumerate(residuals):
        own = best == i
        value[own, o:] = us[i][own]
        orders[own] = o
    orders[~rice] = 0
    linear = rice & (best == len(residuals) - 1)
    parts = value.reshape(rows, 1 << split, part)
    costs = np.stack([(parts >> k).sum(2, dtype=np.int64) + k * part for k in range(9)])
    k = costs.argmin(0)

    # the bits of a frame, a column a field: value, bits that are written, bits that are taken
    named, name_size = _numbers(number)
    head = np.zeros((rows, 12), np.uint8)
    size_code = {256 << i: 8 + i for i in range(8)}.get(n, 6 if n <= 256 else 7)
    head[:, 0], head[:, 1], head[:, 2], head[:, 3] = 0xFF, 0xF8, size_code << 4 | 4, 1 << 1
    tail = [] if size_code > 7 else [n - 1] if size_code == 6 else [(n - 1) >> 8, (n - 1) & 255]
    for s in np.unique(name_size):
        own = name_size == s
        head[own, 4 : 4 + s] = named[own, :s]
        for i, b in enumerate(tail):
            head[own, 4 + s + i] = b
    head_size = 4 + name_size + len(tail)
    check = crc8(head, head_size)

    fields: list[tuple[np.ndarray, np.ndarray]] = []
    put = lambda v, bits: fields.append((np.broadcast_to(np.asarray(v, np.uint32), (rows,)), np.broadcast_to(np.asarray(bits, np.int32), (rows,))))
    for j in range(12):
        put(head[:, j], 8 * (j < head_size))
    put(check, 8)
    kind = np.where(same, _CONSTANT, np.where(raw, _VERBATIM, np.where(linear, 32 + order - 1, 8 + orders)))
    put(kind << 1, 8)
    byte = (x & 255).astype(np.uint32)
    put(byte[:, 0], 8 * same)
    for j in range(order):
        put(byte[:, j], 8 * (j < orders))
    put(PRECISION - 1, 4 * linear)
    put(shift, 5 * linear)
    for j in range(order):
        put(q[j] & ((1 << PRECISION) - 1), PRECISION * linear)
    put(split, 6 * rice)
    first = len(fields)
    columns = first + n + (1 << split)
    v = np.zeros((rows, columns), np.uint32)
    written = np.zeros((rows, columns), np.int32)
    for j, (a_, b_) in enumerate(fields):
        v[:, j], written[:, j] = a_, b_
    taken = written.copy()
    coded = np.where(rice[:, None], 1, 0)
    for p in range(1 << split):
        c = first + p * (part + 1)
        v[:, c], written[:, c] = k[:, p], 4 * rice
        taken[:, c] = written[:, c]
        own, kp = slice(c + 1, c + 1 + part), k[:, p : p + 1]
        u = parts[:, p].astype(np.uint32)
        here = np.arange(p * part, (p + 1) * part)[None, :] >= orders[:, None]
        ricebits = coded * here
        v[:, own] = np.where(raw[:, None], byte[:, p * part : (p + 1) * part], (1 << kp) | (u & ((1 << kp) - 1)))
        v[:, own][~here] = 0
        written[:, own] = np.where(raw[:, None], 8, ricebits * (kp + 1))
        taken[:, own] = written[:, own] + ricebits * (u >> kp.astype(np.uint32)).astype(np.int32)
    written[same, first:] = 0
    taken[same, first:] = 0
    v[written == 0] = 0
    ends = np.cumsum(taken, axis=1, dtype=np.int64)
    body = (ends[:, -1] + 7) // 8
    size = body + 2
    start = np.cumsum(size) - size
    ends += (8 * start)[:, None]
    bit = (ends - written).ravel()
    word, off = bit >> 5, (bit & 31).astype(np.uint64)
    wide = v.ravel().astype(np.uint64) << (np.uint64(64) - off - np.maximum(written.ravel(), 1).astype(np.uint64))
    total = (int(size.sum()) + 3) // 4 + 2
    out = np.bincount(word, (wide >> np.uint64(32)).astype("f8"), total) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype("f8"), total)
    data = np.frombuffer(out.astype(np.uint32).astype(">u4").tobytes(), np.uint8)[: int(size.sum())].copy()
    sums = crc16(data, start, start + body)
    data[start + body], data[start + body + 1] = sums >> 8, sums & 255
    return data, size


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload, whose bytes are 8-bit samples less 128. Payloads are not empty."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    begin = np.cumsum(sizes) - sizes
    frames = -(-sizes // BLOCK)
    of = np.repeat(np.arange(len(sizes)), frames)
    number = np.arange(len(of)) - np.repeat(np.cumsum(frames) - frames, frames)
    start = begin[of] + number * BLOCK
    length = np.minimum(BLOCK, begin[of] + sizes[of] - start)
    coded: list[bytes] = [b""] * len(of)
    for n in np.unique(length).tolist():
        lanes = np.flatnonzero(length == n)
        for lo in range(0, len(lanes), 512):
            some = lanes[lo : lo + 512]
            x = raw[start[some][:, None] + np.arange(n)].astype(np.int32) - 128
            data, size = _frames(x, number[some])
            data, at = data.tobytes(), np.cumsum(size) - size
            for i, a, s in zip(some.tolist(), at.tolist(), size.tolist(), strict=True):
                coded[i] = data[a : a + s]
    out, f = [], 0
    for p, count in zip(payloads, frames.tolist(), strict=True):
        own = coded[f : f + count]
        f += count
        points, at = [], 0
        for i, c in enumerate(own):
            points.append((i * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + min(BLOCK, len(p) - i * BLOCK).to_bytes(2, "big"))
            at += len(c)
        least, most = min(map(len, own)), max(map(len, own))
        info = BLOCK.to_bytes(2, "big") * 2 + least.to_bytes(3, "big") + most.to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(p.translate(_SIGNED)).digest()
        seek = b"".join(points)
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(own))
    return out


_SIGNED = bytes((i - 128) & 255 for i in range(256))


@dataclass
class Stream:
    """What the metadata say, and where frames begin."""

    samples: int
    md5: bytes
    first: int
    offsets: list[int]  # of frames by the seek table, from the first frame
    starts: list[int]  # their first samples


def metadata(media: bytes) -> Stream:
    if media[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, last, info, offsets, starts = 4, False, None, [], []
    while not last:
        if at + 4 > len(media):
            raise FlacError("the metadata end early")
        last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if len(body) < size:
            raise FlacError("the metadata end early")
        at += 4 + size
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if (packed >> 41) & 7 or (packed >> 36) & 31 != 7:
                raise FlacError("only mono streams of 8 bits are supported")
            info = packed & ((1 << 36) - 1), body[18:34]
        elif kind == 3:
            for i in range(0, size, 18):
                sample = int.from_bytes(body[i : i + 8], "big")
                if sample != 2**64 - 1:
                    starts.append(sample)
                    offsets.append(int.from_bytes(body[i + 8 : i + 16], "big"))
    if info is None:
        raise FlacError("no stream information")
    return Stream(info[0], info[1], at, offsets, starts)


class _Bits:
    def __init__(self, data: np.ndarray):
        full = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        w = full[:-8].copy()
        for j in range(1, 8):
            w = (w << np.uint64(8)) | full[j : len(full) - 8 + j]
        self.window = w

    def peek(self, at: np.ndarray) -> np.ndarray:
        """57 bits at least from each place, at the top of 64."""
        byte = at >> 3
        if len(byte) and int(byte.max()) >= len(self.window):
            raise FlacError("a frame ends early")
        return self.window[byte] << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, bits) -> np.ndarray:
        """Unsigned fields of up to 32 bits, which may be 0."""
        bits = np.broadcast_to(np.asarray(bits, np.uint64), at.shape)
        return np.where(bits > 0, self.peek(at) >> np.minimum(np.uint64(64) - bits, np.uint64(63)), 0).astype(np.int64)


def _signed(v: np.ndarray, bits) -> np.ndarray:
    return v - ((v >> (bits - 1)) << bits)


def decode_frames(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples of the frames that begin at ``begin`` (in the order of ``begin``, one after the other), sizes in samples, ends."""
    bits, lanes = _Bits(data), len(begin)
    if not lanes:
        none = np.zeros(0, np.int64)
        return none, none, none
    byte = np.concatenate([data, np.zeros(32, np.uint8)])
    head = byte[begin[:, None] + np.arange(17)]
    if ((head[:, 0] != 0xFF) | (head[:, 1] != 0xF8) & (head[:, 1] != 0xF9)).any():
        raise FlacError("a frame does not begin where it should")
    if (head[:, 3] >> 4).any() or (~np.isin((head[:, 3] >> 1) & 7, (0, 1))).any():
        raise FlacError("only mono frames of 8 bits are supported")
    lead = head[:, 4].astype(np.int64)
    size = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    code, row = (head[:, 2] >> 4).astype(np.int64), np.arange(lanes)
    at = 4 + size
    b0, b1 = head[row, at].astype(np.int64), head[row, at + 1].astype(np.int64)
    n = np.select([code == 1, code == 6, code == 7, code >= 8], [192, b0 + 1, (b0 << 8) + b1 + 1, 256 << np.maximum(code - 8, 0)], 576 << np.clip(code - 2, 0, 3))
    at = at + (code == 6) + 2 * (code == 7)
    rate = head[:, 2] & 15
    at = at + (rate == 12) + 2 * ((rate == 13) | (rate == 14))
    if (code == 0).any() or (crc8(head[:, :16], at) != head[row, at]).any():
        raise FlacError("a frame header fails its checksum")

    deal = np.argsort(-n, kind="stable")  # long frames first: those still running are always the first few
    begin_, n = begin[deal], n[deal]
    pos = 8 * (begin_ + at[deal] + 1)
    kind = bits.read(pos, 8)
    if (kind & 0x81).any():
        raise FlacError("wasted bits are not supported")
    kind, pos = kind >> 1, pos + 8
    linear, fixed = kind >= 32, (kind >= 8) & (kind <= 12)
    constant, verbatim = kind == _CONSTANT, kind == _VERBATIM
    if not (linear | fixed | constant | verbatim).all():
        raise FlacError("a reserved kind of subframe")
    order = np.where(linear, kind - 31, np.where(fixed, kind - 8, 0))
    if (order > n).any():
        raise FlacError("a predictor is longer than its frame")
    most = int(order.max())
    level = np.where(constant, _signed(bits.read(pos, 8 * constant), 8), 0)
    pos = pos + 8 * constant
    warm = np.zeros((max(most, 1), lanes), np.int64)
    for j in range(most):
        own = j < order
        warm[j] = np.where(own, _signed(bits.read(pos, 8 * own), 8), 0)
        pos = pos + 8 * own
    precision = bits.read(pos, 4 * linear) + 1
    pos = pos + 4 * linear
    shift = np.where(linear, _signed(bits.read(pos, 5 * linear), 5), 0)
    pos = pos + 5 * linear
    if (linear & (precision == 16)).any() or (shift < 0).any():
        raise FlacError("a reserved predictor")
    coefs = np.zeros((max(most, 1), lanes), np.int64)
    for j in range(most):
        own = linear & (j < order)
        p = np.where(own, precision, 0)
        coefs[j] = np.where(own, _signed(bits.read(pos, p), np.maximum(p, 1)), 0)
        pos = pos + p
    for o, c in FIXED.items():
        for j, v in enumerate(c if o <= most else ()):
            coefs[j][fixed & (order == o)] = v
    coded = linear | fixed
    method = bits.read(pos, 2 * coded)
    pos = pos + 2 * coded
    split = bits.read(pos, 4 * coded)
    pos = pos + 4 * coded
    if (method > 1).any() or (coded & (((n >> split) << split) != n)).any():
        raise FlacError("a reserved coding of residuals")
    wide, part = 4 + method, n >> split
    # where a partition begins in each frame: in its first, after the samples of the predictor
    count = np.where(coded, 1 << split, 0)
    lane = np.repeat(np.arange(lanes), count)
    turn = np.arange(len(lane)) - np.repeat(np.cumsum(count) - count, count)
    when = np.where(turn == 0, order[lane], turn * part[lane])
    if (coded & (order > part)).any():
        raise FlacError("a predictor is longer than its partition")
    by = np.argsort(when, kind="stable")
    lane, when = lane[by], when[by]
    cut = np.flatnonzero(np.diff(when)) + 1
    turns = {int(when[g[0]]): lane[g] for g in np.split(np.arange(len(lane)), cut) if len(g)}

    raw_bits = np.where(verbatim, 8, -1)  # fields without Rice code: raw samples, escaped partitions
    k = np.zeros(lanes, np.int64)
    longest = int(n[0])
    out = np.zeros((most + longest, lanes), np.int32)
    ends = np.searchsorted(-n, -np.arange(longest), side="left")  # frames that are longer than t
    begun = np.where(coded, order, np.where(verbatim, 0, longest))
    late = int(begun[~constant].max()) if (~constant).any() else 0
    idle = bool(constant.any())
    escapes = bool(verbatim.any())
    window = bits.window
    limit = len(window) - 1
    for t in range(longest):
        if t in turns:
            own = turns[t]
            v = bits.read(pos[own], wide[own])
            pos[own] += wide[own]
            escaped = v == (1 << wide[own]) - 1
            raw_bits[own] = -1
            if escaped.any():
                e = own[escaped]
                raw_bits[e] = bits.read(pos[e], np.full(len(e), 5))
                pos[e] += 5
                escapes = True
            k[own] = np.where(escaped, 0, v)
        m = int(ends[t])
        p = pos[:m]
        byte_at = p >> 3
        np.minimum(byte_at, limit, out=byte_at)
        w = window[byte_at] << (p & 7).astype(np.uint64)
        top = (w >> np.uint64(32)).astype(np.float64)  # exact: 32 bits
        q = 1054 - (top.view(np.int64) >> 52)  # zeros before the first one; 1054 if there is none in 32 bits
        far = q > 32
        if t < late or idle or escapes:
            live = (begun[:m] <= t) & (raw_bits[:m] < 0)
            far &= live
        kk = k[:m]
        if far.any():
            zeros = np.where(far, 0, q)
            for i in np.flatnonzero(far).tolist():
                zeros[i] = _unary(window, int(p[i]))
            w = bits.peek(np.minimum(p + zeros, 8 * limit))
            u = (zeros << kk) | _low(w, kk)
            q = zeros
        else:
            u = (q << kk) | _low(w << q.astype(np.uint64), kk)
        r = (u >> 1) ^ -(u & 1)
        step = q + 1 + kk
        if t < late or idle or escapes:
            rb = raw_bits[:m]
            plain = (begun[:m] <= t) & (rb >= 0)
            if plain.any():
                rb = np.where(plain, rb, 0)
                r = np.where(plain, np.where(rb > 0, _signed(bits.read(np.minimum(p, 8 * limit), rb), np.maximum(rb, 1)), 0), r)
                step = np.where(plain, rb, step)
            quiet = begun[:m] > t
            r = np.where(quiet, 0, r)
            step = np.where(quiet, 0, step)
        out[most + t, :m] = r
        p += step
    if (pos > 8 * len(data)).any():
        raise FlacError("a frame ends early")

    if most:
        turned = np.ascontiguousarray(coefs[:most][::-1].astype(np.int32))
        moves = np.flatnonzero(order > 0)
        cols = moves if len(moves) < lanes else slice(None)
        s, c, sh = np.ascontiguousarray(out[:, cols]), np.ascontiguousarray(turned[:, cols]), shift[cols].astype(np.int32)
        o, wm, m_of = order[cols], warm[:, cols].astype(np.int32), np.searchsorted(-n[cols], -np.arange(longest), side="left")
        exact = s.astype(np.int64) if int(np.abs(coefs).max()) * most * 128 >= 2**31 else s
        s, c = exact, c.astype(exact.dtype)
        for t in range(longest):
            m = int(m_of[t])
            guess = np.einsum("pl,pl->l", c[:, :m], s[t : t + most, :m]) >> sh[:m]
            if t < most:
                s[most + t, :m] = np.where(t < o[:m], wm[t, :m], s[most + t, :m] + guess)
            else:
                s[most + t, :m] += guess
        out[:, cols] = s
    samples = out[most:].T.copy()
    if constant.any():
        samples[constant] = level[constant][:, None]
    stop = (pos + 7) >> 3
    if (stop + 2 > len(data)).any() or (crc16(data, begin_, stop) != (byte[stop].astype(np.int64) << 8 | byte[stop + 1])).any():
        raise FlacError("a frame fails its checksum")
    back = np.argsort(deal, kind="stable")
    sizes = n[back]
    return samples[back][np.arange(longest)[None, :] < sizes[:, None]], sizes, (stop + 2)[back]


def _low(w: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k bits after the leading one of each word."""
    return (((w << np.uint64(1)) >> np.uint64(32)).astype(np.int64) >> (32 - k))


def _unary(window: np.ndarray, at: int) -> int:
    zeros = 0
    while True:
        if (at + zeros) >> 3 >= len(window):
            raise FlacError("a frame ends early")
        w = (int(window[(at + zeros) >> 3]) << ((at + zeros) & 7)) & (2**64 - 1)
        w >>= 16
        if w:
            return zeros + 48 - w.bit_length()
        zeros += 48


@dataclass
class Decoded:
    """``pcm``: unsigned 8-bit samples; blocks as (first sample, byte offset in the stream, samples)."""

    pcm: bytes
    blocks: list[tuple[int, int, int]]


def decode(media: list[bytes]) -> list[Decoded]:
    """All streams, verified. Raises FlacError for damaged ones."""
    streams = [metadata(m) for m in media]
    base = np.cumsum([0, *map(len, media)])
    data = np.frombuffer(b"".join(media), np.uint8)
    begin, owner = [], []
    for i, (s, m) in enumerate(zip(streams, media, strict=True)):
        if not s.offsets and s.samples:
            at, done = s.first, 0
            while done < s.samples:  # without a seek table, a frame says where the next begins
                _, sizes, ends = decode_frames(np.frombuffer(m, np.uint8), np.array([at]))
                s.offsets.append(at - s.first)
                s.starts.append(done)
                at, done = int(ends[0]), done + int(sizes[0])
        begin += [int(base[i]) + s.first + o for o in s.offsets]
        owner += [i] * len(s.offsets)
    begin = np.array(begin, np.int64)
    if len(begin) and int(begin.max()) + 17 > len(data) + 16:
        raise FlacError("a seek point lies outside its stream")
    samples, sizes, _ = decode_frames(data, begin)
    pcm = (samples + 128).astype(np.uint8).tobytes()
    out, f, at = [], 0, 0
    for s in streams:
        blocks, total = [], 0
        for o, first in zip(s.offsets, s.starts, strict=True):
            if first != total:
                raise FlacError("seek points are missing")
            blocks.append((first, s.first + o, int(sizes[f])))
            total += int(sizes[f])
            f += 1
        own = pcm[at : at + total]
        at += total
        if total != s.samples or hashlib.md5(own.translate(_SIGNED)).digest() != s.md5:
            raise FlacError("the samples fail their checksum")
        out.append(Decoded(own, blocks))
    return out


def payload(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes filled up with zeros to a positive multiple of UNIT, and how many there were."""
    raw = (text or "").encode()
    return raw + b"\x00" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def encode_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` of every document; a null text counts as empty, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SLICE, 2048):
                filled = [payload(t) for t in piece.column("text").to_pylist()]
                media = encode([p for p, _ in filled])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([n for _, n in filled], "int64"), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def pcm_blocks(stored: DataFrame) -> DataFrame:
    """A row per block of each stream: ``doc_id, block, sample_offset, byte_offset, samples, pcm``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "media", SLICE, 2048):
                found = decode(piece.column("media").to_pylist())
                rows = [(d, i, s, b, n, x.pcm[s : s + n]) for d, x in zip(piece.column("doc_id").to_pylist(), found, strict=True) for i, (s, b, n) in enumerate(x.blocks)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (piece.schema.field("doc_id").type, "int32", "int64", "int64", "int32", "binary"), strict=True)], ["doc_id", "block", "sample_offset", "byte_offset", "samples", "pcm"])

    kind = dict(stored.dtypes)["doc_id"]
    return stored.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, block int, sample_offset long, byte_offset long, samples int, pcm binary")


def features(pcm: bytes) -> str:
    """Level, crossings of the middle, and peak of unsigned 8-bit samples."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    return f"samples={len(x)};rms={float((x * x).sum() / len(x)) ** 0.5:.4f};mean={int(x.sum()) / len(x):.4f};peak={int(np.abs(x).max())};crossings={crossings}"


def read_back(stored: DataFrame) -> DataFrame:
    """Decode, verify and describe each stream of ``encode_texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "media", SLICE, 2048):
                media = piece.column("media").to_pylist()
                pcm = [x.pcm for x in decode(media)]
                sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
                columns = {
                    "payload_bytes": pa.array([len(x) for x in pcm], "int64"),
                    "payload_sha256": sha(pcm),
                    "tail_crc32": pa.array([zlib.crc32(x[-UNIT:]) for x in pcm], "int64"),
                    "media_bytes": pa.array([len(x) for x in media], "int64"),
                    "media_sha256": sha(media),
                    "feature": pa.array([features(x) for x in pcm]),
                }
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("n_bytes"), *columns.values()], ["doc_id", "n_bytes", *columns])

    kind = dict(stored.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", F.col("media")).mapInArrow(run, schema)
