import hashlib
import random
import zlib

import numpy as np
import pytest

from lapgraph.llm import flac


class Bits:
    def __init__(self, data):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def take(self, n):
        v = int(self.bits[self.at : self.at + n] or "0", 2)
        self.at += n
        return v

    def signed(self, n):
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self):
        n = self.bits.index("1", self.at) - self.at
        self.at += n + 1
        return n


def _crc(data, poly, bits):
    c = 0
    for b in data:
        c ^= b << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)
            c &= (1 << bits) - 1
    return c


def _plain_decode(media):
    """Bit by bit."""
    s, out = flac.metadata(media), []
    at = s.first
    while len(out) < s.samples:
        r = Bits(media[at:])
        assert r.take(16) == 0xFFF8
        code = r.take(4)
        assert r.take(4) == 4 and r.take(4) == 0 and r.take(3) == 1 and r.take(1) == 0
        lead = r.take(8)
        extra = 0 if lead < 128 else 1 if lead < 0xE0 else 2
        for _ in range(extra):
            r.take(8)
        n = r.take(8) + 1 if code == 6 else r.take(16) + 1 if code == 7 else 256 << (code - 8)
        assert _crc(media[at : at + r.at // 8], 7, 8) == r.take(8)
        kind = r.take(8) >> 1
        if kind == 0:
            own = [r.signed(8)] * n
        elif kind == 1:
            own = [r.signed(8) for _ in range(n)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            own = [r.signed(8) for _ in range(order)]
            coefs, shift = flac.FIXED.get(order, ()), 0
            if kind >= 32:
                precision = r.take(4) + 1
                shift = r.take(5)
                coefs = [r.signed(precision) for _ in range(order)]
            wide = 5 if r.take(2) else 4
            split = r.take(4)
            for p in range(1 << split):
                k = r.take(wide)
                raw = r.take(5) if k == (1 << wide) - 1 else None
                for _ in range((n >> split) - (order if p == 0 else 0)):
                    if raw is None:
                        u = r.unary() << k | r.take(k)
                        e = u >> 1 ^ -(u & 1)
                    else:
                        e = r.signed(raw)
                    own.append(e + (sum(c * own[-1 - i] for i, c in enumerate(coefs)) >> shift))
        r.at += -r.at % 8
        assert _crc(media[at : at + r.at // 8], 0x8005, 16) == r.take(16)
        out += own
        at += r.at // 8
    return bytes(x + 128 for x in out)


def _payloads():
    rng = random.Random(1)
    out = [b"\0" * 64, b"a" * 1280, rng.randbytes(3008), b"hello world, this is text. " * 200, b"\0" * 64 + b"\xff" + b"\0" * 63, bytes(i * i % 256 for i in range(2112))]
    out += [bytes(int(128 + 100 * np.sin(i / 9) + rng.random() * 3) for i in range(4160)), ("Straße und Öl " * 90).encode()]
    return [p + b"\0" * (-len(p) % 64) for p in out]


def test_streams_are_standard_and_lossless():
    payloads = _payloads()
    media = flac.encode(payloads)
    for p, m, d in zip(payloads, media, flac.decode(media), strict=True):
        assert d.pcm == p == _plain_decode(m)
        assert [b[0] for b in d.blocks] == list(range(0, len(p), flac.BLOCK))
        for first, at, n in d.blocks:  # each block can be sought
            samples, sizes, _ = flac.decode_frames(np.frombuffer(m, np.uint8), np.array([at]))
            assert sizes.tolist() == [n] and bytes((samples + 128).astype(np.uint8)) == p[first : first + n]
    assert flac.encode(payloads[::-1])[::-1] == media  # whatever stands beside


def _written(bits):
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def _frame(samples, order, k, wide=4, split=0, escape=None, number=0, coefs=None, shift=0):
    """One frame as bytes, with the coding asked for."""
    f = lambda v, n: f"{v & ((1 << n) - 1):0{n}b}" if n else ""
    n = len(samples)
    head = bytes([0xFF, 0xF8, 7 << 4 | 4, 2, number]) + (n - 1).to_bytes(2, "big")
    head += bytes([_crc(head, 7, 8)])
    bits = f((31 + order if coefs else 8 + order) << 1, 8) + "".join(f(s, 8) for s in samples[:order])
    if coefs:
        bits += f(14, 4) + f(shift, 5) + "".join(f(c, 15) for c in coefs)
    used = coefs or flac.FIXED[order]
    res = [samples[i] - (sum(c * samples[i - 1 - j] for j, c in enumerate(used)) >> shift) for i in range(order, n)]
    bits += f(wide - 4, 2) + f(split, 4)
    at = 0
    for p in range(1 << split):
        m = (n >> split) - (order if p == 0 else 0)
        if escape is not None and p % 2 == 0:
            bits += f((1 << wide) - 1, wide) + f(escape, 5) + "".join(f(e, escape) for e in res[at : at + m])
        else:
            bits += f(k, wide)
            for e in res[at : at + m]:
                u = 2 * e if e >= 0 else -2 * e - 1
                bits += "0" * (u >> k) + "1" + f(u, k)
        at += m
    body = head + _written(bits)
    return body + _crc(body, 0x8005, 16).to_bytes(2, "big")


@pytest.mark.parametrize("seek", [True, False])
def test_reader_knows_every_coding(seek):
    rng, x, frames = random.Random(3), [], []
    kinds = [(o, k, w, s, e, None, 0) for o in range(5) for k, w, s, e in ((0, 4, 0, None), (3, 5, 2, None), (17, 5, 1, None), (2, 4, 3, 12), (1, 5, 1, 13))]
    kinds += [(32, 4, 4, 0, None, [rng.randrange(-300, 300) for _ in range(32)], 9), (12, 3, 4, 1, 14, [rng.randrange(-900, 900) for _ in range(12)], 10), (1, 4, 4, 0, None, [16383], 14)]
    for i, (o, k, w, s, e, c, sh) in enumerate(kinds):
        own = [max(-128, min(127, int(rng.gauss(0, 40)))) for _ in range(rng.choice([96, 192, 320]))]
        x += own
        frames.append((len(own), _frame(own, o, k, w, s, e, i, c, sh)))
    signed = bytes(v & 255 for v in x)
    info = (16).to_bytes(2, "big") + (320).to_bytes(2, "big") + bytes(6) + (8000 << 44 | 7 << 36 | len(x)).to_bytes(8, "big") + hashlib.md5(signed).digest()
    points, at, first = b"", 0, 0
    for n, f in frames:
        points += first.to_bytes(8, "big") + at.to_bytes(8, "big") + n.to_bytes(2, "big")
        at, first = at + len(f), first + n
    media = b"fLaC" + (b"\x00" if seek else b"\x80") + (34).to_bytes(3, "big") + info
    if seek:
        media += b"\x83" + len(points).to_bytes(3, "big") + points
    media += b"".join(f for _, f in frames)
    assert flac.decode([media])[0].pcm == bytes(v + 128 for v in x)


def test_damage_is_noticed():
    media = flac.encode([b"some words in a row " * 160])[0]
    first = flac.metadata(media).first
    for at in [0, first, first + 5, first + 30, len(media) - 1, first - 40]:
        broken = bytearray(media)
        broken[at] ^= 0x41
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(broken)])
    with pytest.raises(flac.FlacError):
        flac.decode([media[:-200]])


def test_documents(spark, make_docs, odd_texts):
    texts = [*odd_texts, "copy of a text", "copy of a text", "long " * 60000]
    docs = make_docs(texts, extra=["media", "n_bytes", "feature"]).repartition(3)
    stored = flac.encode_texts(docs)
    rows = {r["doc_id"]: r for r in flac.read_back(stored).collect()}
    for i, t in enumerate(texts):
        p, n = flac.payload(t)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len({(rows[i]["media_sha256"], rows[i]["feature"]) for i in (len(texts) - 3, len(texts) - 2)}) == 1
    blocks = {}
    for r in flac.pcm_blocks(stored).collect():
        blocks.setdefault(r["doc_id"], {})[r["sample_offset"]] = r["pcm"]
    for i, t in enumerate(texts):
        assert b"".join(b for _, b in sorted(blocks[i].items())) == flac.payload(t)[0]


def test_empty_table_and_null_id(make_docs):
    assert flac.read_back(flac.encode_texts(make_docs([]))).collect() == []
    assert flac.read_back(flac.encode_texts(make_docs(["x"], ids=[None]))).first()["doc_id"] is None
