"""Packing by concatenating and cutting.

Documents are encoded once; the ids are written with each document's place in its partition. Running sums over the
partitions' totals give every document its place in the one long row of all ids, and windows of fixed length cut that
row. A document that crosses a boundary yields a record for each side. Only the last sequence can be short.

Scale: no row is shuffled. The one table that a single task sees has a row per input partition. Ids are written once in
two bytes each (a vocabulary of more than 65,536 raises an error); a lost executor costs the partitions it was encoding.
Where a document lies follows from how the input is split into partitions: another split packs as tightly, in another order.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapgraph.llm.texts import slices, small_batches
from lapgraph.storage import materialize

VOCABULARY = "byte_bpe_50k"
#: Characters on which the two libraries' patterns surely agree: printable ASCII, usual white space, Latin letters.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-ɏ]")


class ByteEncoder:
    """ids as the tokenizers library gives them for a byte-level BPE vocabulary, special tokens in texts included.

    Texts of common characters go through tiktoken with the same vocabulary as ranks, which is several times faster and
    gives the same ids; others go through tokenizers itself.
    """

    def __init__(self, vocabulary: str = VOCABULARY, folder: str | None = None):
        import tiktoken
        from tokenizers import Tokenizer

        path = (lambda n: f"{folder}/{n}") if folder else public_tokenizers.path
        self.whole = Tokenizer.from_file(path(f"{vocabulary}.json"))
        self.whole.no_truncation()
        self.whole.no_padding()
        special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        with open(path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> list[int]:
        if _OTHER.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all", disallowed_special=())


@cache
def _encoder(vocabulary: str, folder: str | None) -> ByteEncoder:
    return ByteEncoder(vocabulary, folder)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """``doc_id, part, start, n, ids``: each document's ids and the end id, as little-endian unsigned 16-bit integers.

    ``start`` counts the ids before it in its partition ``part``. Both hold for one evaluation only: write the
    result before use. A null text counts as empty. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = _encoder(vocabulary, folder), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text"):
                ids = [np.array([*encoder.encode(t or ""), end_id], "<u2") for t in piece.column("text").to_pylist()]
                n = np.array([len(x) for x in ids], "i8")
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.full(len(n), part, "i4")), pa.array(starts), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["doc_id", "part", "start", "n", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, part int, start long, n long, ids binary")


def place(encoded: DataFrame) -> DataFrame:
    """``encoded`` (written) with ``at``: how many ids of all documents stand before its own."""
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    along = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = totals.select("part", (F.sum("total").over(along) - F.col("total")).alias("offset"))
    # a row of two numbers for each partition of the input
    return encoded.join(F.broadcast(offsets), "part").withColumn("at", F.col("offset") + F.col("start"))


def cut(placed: DataFrame, length: int = 1024, digest: bool = False) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``; ids as in ``placed``.

    ``digest``: ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) in place of ``ids``.
    """
    name, kept = ("ids_crc32", "long") if digest else ("ids", "binary")
    made = (lambda parts: pa.array([_crc32(x) for x in parts], "int64")) if digest else (lambda parts: pa.array(parts, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "ids"):
                at, n = (piece.column(c).to_numpy() for c in ("at", "n"))
                first = at // length
                count = (at + n - 1) // length - first + 1
                doc = np.repeat(np.arange(len(n)), count)
                sequence = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                begin = np.maximum(sequence * length, at[doc])
                end = np.minimum((sequence + 1) * length, at[doc] + n[doc])
                start = begin - at[doc]
                ids, size = piece.column("ids").to_pylist(), end - begin
                parts = [ids[d][2 * a : 2 * (a + m)] for d, a, m in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
                columns = [piece.column("doc_id").take(pa.array(doc)), *map(pa.array, (start, size)), made(parts), *map(pa.array, (n[doc], sequence, begin - sequence * length))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", name, "doc_tokens", "sequence_id", "offset"])

    kind = placed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, {name} {kept}, doc_tokens long, sequence_id long, offset long"
    return placed.select("doc_id", "at", "n", "ids").mapInArrow(run, schema)


def _crc32(ids: bytes) -> int:
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def checksum(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) in place of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [_crc32(x) for x in batch.column("ids").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids_crc32", pa.array(sums, "int64"))

    schema = ", ".join(f"{c if c != 'ids' else 'ids_crc32'} {t if c != 'ids' else 'long'}" for c, t in pieces.dtypes)
    return pieces.mapInArrow(run, schema)


def pack(docs: DataFrame, length: int = 1024, vocabulary: str = VOCABULARY, folder: str | None = None, digest: bool = False) -> DataFrame:
    """The pieces of all documents, packed into sequences of ``length`` ids.

    ``digest``: as in ``cut``. Each id lies in one piece; equal rows are packed as often as they occur; an empty table gives no pieces.
    """
    if length < 1:
        raise ValueError("length must be positive")
    small_batches(docs.sparkSession)
    return cut(place(materialize(encode_documents(docs, vocabulary, folder))), length, digest)
