"""Words of many texts as 64-bit hashes, all at once in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = pow(int(_P), -1, 1 << 64)
_SPAN = 1 << 18
_WINDOW = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    out, width = np.ones(1, np.uint64), 1
    while width < n:
        out = np.concatenate([out, out * np.uint64(pow(base, width, 1 << 64))])
        width *= 2
    return out[:n]


_UP = _powers(int(_P), _SPAN + 1)
_DOWN = _powers(_INVERSE, _SPAN + 1)


def _power(table: np.ndarray, base: int, at: np.ndarray) -> np.ndarray:
    """base ** at, for places of any size."""
    high = at // _SPAN
    if not high.any():
        return table[at]
    far = np.array([pow(base, int(h) * _SPAN, 1 << 64) for h in range(int(high.max()) + 1)], np.uint64)
    return table[at % _SPAN] * far[high]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins (one more: the end); null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return np.where((raw >= 65) & (raw <= 90), raw | np.uint8(32), raw)


def words(raw: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of every run of bytes where ``inside`` holds, not across texts.

    ``starts``: where texts begin, and the end.
    """
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.empty(len(raw), bool)
    first[0], first[1:] = inside[0], inside[1:] & ~inside[:-1]
    edges = starts[1:-1]
    edges = edges[edges < len(raw)]
    first[edges] = inside[edges]
    last = np.empty(len(raw), bool)
    last[-1], last[:-1] = inside[-1], inside[:-1] & (~inside[1:] | first[1:])
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


def hashes(raw: np.ndarray, begin: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """For each of ``ends``, a hash of each span of bytes that depends on its bytes only; ``ends[0]`` is the widest.

    Polynomial modulo 2**64, then spread. Works through windows of the bytes, so that memory follows the words.
    """
    out = [np.empty(len(begin), np.uint64) for _ in ends]
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + _WINDOW)))
        at = begin[i]
        own = raw[at : ends[0][j - 1]]
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum((own.astype(np.uint64) + np.uint64(1)) * _power(_UP, int(_P), np.arange(len(own))), out=sums[1:])
        b = begin[i:j] - at
        down = _power(_DOWN, _INVERSE, b)
        for h, end in zip(out, ends, strict=True):
            e = end[i:j] - at
            h[i:j] = mixed((sums[e] - sums[b]) * down + np.uint64(0x632BE59BD9B4E019) * (e - b).astype(np.uint64))
        i = j
    return out
