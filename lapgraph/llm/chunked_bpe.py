"""BPE encoding with content-defined chunks, and decoding.

A rolling hash over the bytes of a text cuts it where its content says, so that a passage which many documents share is
cut alike in each. A chunk is encoded once per worker and looked up from then on. A cut may fall inside a word:
the ids at both ends of a chunk that belong to the words at the cut are taken off again, after they have been found
equal to the encoding of these words alone, and the words on both sides are joined and re-encoded. White space ends
whatever the tokenizer merges, so the outcome is the encoding of the whole text.

Scale: rows stay where they are; nothing is shuffled. Both memories of a worker are bounded and emptied when full, which
changes speed only. Copies and shared passages cost a lookup.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from lapgraph.llm.texts import slices

VOCABULARY = "word_bpe_49k.json"
#: Rolling hash: window in bytes (a power of two), mean distance of cuts, least and greatest length of a chunk.
WINDOW, MEAN, LEAST, GREATEST = 16, 512, 64, 8192
#: Words and chunks that a worker remembers at most.
WORDS_KEPT, CHUNKS_KEPT = 400_000, 40_000

_SPACE = " \t\n\r"
_LETTERS = "".join(c for c in map(chr, range(0xC0, 0x250)) if unicodedata.category(c)[0] == "L" and len(c.lower()) == 1)
#: Characters for which Python's classes and the vocabulary's pattern surely agree and normalisation changes nothing.
_OTHER = re.compile(f"[^\t\n\r\x20-\x7e{re.escape(_LETTERS)}]|<\\|")
_FIRST_SPACE = re.compile(f"[{_SPACE}]")
#: The vocabulary's own pattern for these characters.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data`` (UTF-8); never inside a character."""
    n = len(data)
    if n <= LEAST:
        return [n]
    raw = np.frombuffer(data, np.uint8)
    h, width, p = raw.astype(np.uint32) * np.uint32(0x9E3779B1), 1, np.uint32(0x01000193)
    while width < WINDOW and len(h) > width:
        h = h[:-width] * p + h[width:]
        p, width = np.uint32(int(p) * int(p) & 0xFFFFFFFF), width * 2
    h ^= h >> np.uint32(15)
    ends = np.flatnonzero((h & np.uint32(MEAN - 1)) == 0) + width
    out, last = [], 0
    for e in [*ends.tolist(), n]:
        while e - last > GREATEST:
            last = _whole(raw, last + GREATEST)
            out.append(last)
        if e == n or e - last >= LEAST:
            e = _whole(raw, e)
            if e > last:
                out.append(e)
                last = e
    return out if out[-1] == n else [*out, n]


def _whole(raw: np.ndarray, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


class ChunkedEncoder:
    """Encodes texts as little-endian unsigned 32-bit ids."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.library.no_truncation()
        self.library.no_padding()
        self.words: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}
        self.tokens = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]
        self.chunks: dict[bytes, tuple] = {}
        self.encoded_chunks = self.seen_chunks = 0

    def plain(self, text: str) -> bytes:
        """The library's ids; what stands between white space, of common characters, is looked up once it is known."""
        if _OTHER.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        pieces = text.lower().split()
        try:
            return b"".join(map(self.words.__getitem__, pieces))
        except KeyError:
            self._learn(pieces)
        return b"".join(map(self.words.__getitem__, pieces))

    def learn(self, texts: list[str]) -> None:
        """Look up what is new in ``texts`` together, which is faster than text by text."""
        new: set[str] = set()
        for text in texts:
            if not _OTHER.search(text):
                new.update(text.lower().split())
        self._learn(new)

    def _learn(self, pieces: Iterable[str]) -> None:
        """Ids of ``pieces``: of those that are several words, by their words. What was not used since the memory was last full is forgotten."""
        if len(self.words) > WORDS_KEPT:
            self.words, self.former = {}, self.words
        new = set(pieces).difference(self.words)
        known = [p for p in new if p in self.former]
        self.words.update((p, self.former[p]) for p in known)
        new.difference_update(known)
        several = {p: _WORD.findall(p) for p in new if not p.isalpha()}
        words = list(new.difference(several).union(*several.values()).difference(self.words))
        for w, e in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False), strict=True):
            ids = e.ids
            self.words[w] = pack(f"<{len(ids)}I", *ids)
        for p, parts in several.items():
            self.words[p] = b"".join(map(self.words.__getitem__, parts))

    def _entry(self, text: str) -> tuple:
        """(head, ids between, tail), or (text, None, "") where no white space parts head and tail.

        head and tail: what the neighbours may continue, up to white space. They grow until their own encodings are
        found at the ends of the chunk's.
        """
        ids, i, j = self.plain(text), -1, len(text)
        while True:
            found = _FIRST_SPACE.search(text, i + 1)
            i, j = found.start() if found else len(text), max(text.rfind(c, 0, j) for c in _SPACE)
            if j < i:
                return text, None, ""
            head, tail = text[:i], text[j + 1 :]
            a, b = self.plain(head), self.plain(tail)
            if ids.startswith(a) and ids.endswith(b) and len(a) + len(b) <= len(ids):
                return head, ids[len(a) : len(ids) - len(b)], tail

    def encode(self, text: str) -> bytes:
        data = text.encode()
        out, pending, start = [], "", 0
        for end in cuts(data):
            key = data[start:end]
            start = end
            self.seen_chunks += 1
            entry = self.chunks.get(key)
            if entry is None:
                if len(self.chunks) >= CHUNKS_KEPT:
                    self.chunks.clear()
                entry = self.chunks[key] = self._entry(key.decode())
                self.encoded_chunks += 1
            head, between, tail = entry
            pending += head
            if between is not None:
                if pending:
                    out.append(self.plain(pending))
                out.append(between)
                pending = tail
        if pending:
            out.append(self.plain(pending))
        return b"".join(out)

    def decode(self, ids: list[bytes]) -> list[str]:
        """The tokens, parted by blanks: the vocabulary names no decoder."""
        return [" ".join(map(self.tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids]


@cache
def _encoder(path: str | None) -> ChunkedEncoder:
    return ChunkedEncoder(path)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded`` of every document: ids as little-endian unsigned 32-bit integers, and their decoding.

    A null text counts as empty: no ids, an empty decoding. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for piece in slices(batch, "text", 2_000_000):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                encoder.learn(texts)
                ids = list(map(encoder.encode, texts))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(ids, pa.binary()), pa.array(encoder.decode(ids), pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")
