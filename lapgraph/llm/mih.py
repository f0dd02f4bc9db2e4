"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: signs after rotations learned by alternating least squares on a bounded sample (iterative
quantization). A code is split into substrings, and each substring is indexed. Two codes that differ in at most r bits
differ in few bits in at least one substring (the generalised pigeonhole principle), so probing each index around the
query's substring retrieves every code within radius r; codes in the radius are reranked by the exact inner product.

The radius is calibrated on a bounded set of queries held against all rows, so that it grows or shrinks with how
near the neighbours lie. Queries for which too few rows are found are run again with a radius that holds all.

Substrings have one byte or two, whichever is cheaper at that radius. Of two bytes, an index keeps the rows in order of the
substring, and all values around the query's are looked up: little is touched where neighbours are near (vectors in
clusters). At a wide radius (vectors without structure, where neighbours differ in nearly half of all bits) these values
are too many, and tables of one byte say by bitmaps which rows are around each value; then most rows are probed.

Scale: every row is coded once and written with its code; each task indexes what it reads in blocks of bounded size.
Vectors are never shuffled. Queries travel to the blocks in groups of bounded size, and each block answers with its few best. Equal vectors of a block
are one entry with its smallest ids, of which no query can want more, so a vector that a third of all rows share costs
one comparison a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lapgraph.llm.texts import hashed_sample
from lapgraph.storage import materialize

SAMPLE = 8192  #: vectors from which the rotations are learned, at most
CALIBRATION = 128  #: queries by which the radius is chosen, about and at most twice as many
QUERIES = 131_072  #: queries of one group, about; each group is a pass over the coded rows
BLOCK = 65_536  #: rows of an index block, at most
PAIRS = 1 << 19  #: pairs of a query and a row that are looked at together, about
SCORES = 1 << 14  #: pairs whose vectors are held side by side
BITS = 8  #: bits of a byte of a code
#: Costs of a candidate, of looking up a value in an index of two bytes, and of a row in the bitmaps of one byte.
CANDIDATE, LOOKUP, BITMAP = 3.0, 2.0, 0.1


@dataclass(frozen=True)
class Codes:
    """``planes`` (dimension + 1, bits): the last row is for the component that makes all norms ``norm``."""

    mean: np.ndarray
    planes: np.ndarray
    norm: float

    def of(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Packed codes, a byte per substring."""
        x = x.astype("f8")
        size = np.linalg.norm(x, axis=1)
        if query:  # only its direction matters
            full = np.column_stack([x * (self.norm / size)[:, None], np.zeros(len(x))])
        else:
            full = np.column_stack([x, np.sqrt(np.maximum(self.norm**2 - size**2, 0))])
        return np.packbits((full - self.mean) @ self.planes > 0, axis=1)


def usable(v: Column, dimension: int | None = None) -> Column:
    """Whether a vector takes part: not null nor zero, all components finite, of the dimension."""
    real = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(real if dimension is None else real & (F.size(v) == dimension), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def learn(sample: np.ndarray, norm: float, rotations: int = 2, steps: int = 40, seed: int = 0) -> Codes:
    """Rotations of the sample (with the component for equal norms) that bring it near the corners of a cube."""
    rng, x = np.random.default_rng(seed), sample.astype("f8")
    full = np.column_stack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))])
    mean = full.mean(0)
    centred = full - mean
    width = max(BITS, -(-sample.shape[1] // BITS) * BITS)
    planes = []
    for _ in range(rotations):
        start = rng.normal(size=(full.shape[1], max(width, full.shape[1])))
        turn = np.linalg.svd(start, full_matrices=False)
        r = turn[0] @ turn[2]
        for _ in range(steps):
            u, _, vt = np.linalg.svd(centred.T @ np.sign(centred @ r), full_matrices=False)
            r = u @ vt
        planes.append(r[:, :width])
    return Codes(mean, np.column_stack(planes), norm)


def probe_radii(radius: int, substrings: int) -> np.ndarray:
    """Radius to probe in each substring (-1: none) so that no code within ``radius`` in all is missed."""
    whole, rest = divmod(radius, substrings)
    return np.where(np.arange(substrings) <= rest, whole, whole - 1)


def distinct(ids: np.ndarray, x: np.ndarray, keep: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct rows of ``x``; of each, the ``keep`` smallest ids in order, and where in ``x`` it stands."""
    to = np.argsort(ids, kind="stable")
    ids, x = ids[to], np.ascontiguousarray(x[to])
    _, first, of = np.unique(x.view([("", x.dtype)] * x.shape[1]).ravel(), return_index=True, return_inverse=True)
    by = np.argsort(of, kind="stable")
    groups = np.split(ids[by], np.flatnonzero(np.diff(of[by])) + 1)
    return x[first], [np.unique(g)[:keep] for g in groups], to[first]


def probed(code: np.ndarray, query_code: np.ndarray, radius: int, width: int) -> np.ndarray:
    """(queries, rows): whether a row is probed for a query with substrings of ``width`` bytes."""
    apart = np.bitwise_count(query_code[:, None, :] ^ code[None, :, :])
    apart = apart.reshape(*apart.shape[:2], -1, width).sum(3)
    return (apart <= probe_radii(radius, apart.shape[2])).any(2)


def values_around(radius: int) -> np.ndarray:
    """All 16-bit values with ``radius`` bits set at most."""
    every = np.arange(65536, dtype=np.uint16)
    return every[np.bitwise_count(every) <= radius]


def cheaper_width(code: np.ndarray, query_code: np.ndarray, radius: int, rows: int) -> int:
    """Bytes of a substring, 1 or 2, with which blocks of ``rows`` rows are searched at less cost; ``code``: of a sample."""
    share = lambda width: float(np.mean([probed(code, query_code[i : i + 1], radius, width).mean() for i in range(min(64, len(query_code)))]))
    lookups = sum(len(values_around(int(r))) for r in probe_radii(radius, code.shape[1] // 2) if r >= 0)
    one = rows * (BITMAP + CANDIDATE * share(1))
    return 2 if LOOKUP * lookups + rows * CANDIDATE * share(2) < one else 1


class Block:
    """Rows with an index for each substring of their codes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, code: np.ndarray, radius: int, width: int, keep: int):
        self.rows, self.members, first = distinct(ids, x, keep)
        self.code, self.width = np.ascontiguousarray(code[first]), width
        self.least = np.array([m[0] for m in self.members])
        self.radii = probe_radii(radius, self.code.shape[1] // width)
        self.live = np.flatnonzero(self.radii >= 0)
        if width == 2:
            part = self.code.view(">u2").astype(np.int64)
            self.order = [np.argsort(part[:, j], kind="stable") for j in self.live]
            self.starts = [np.searchsorted(part[o, j], np.arange(65537)).astype(np.int32) for j, o in zip(self.live, self.order, strict=True)]
            self.around = {int(r): values_around(int(r)).astype(np.int64) for r in set(self.radii[self.live].tolist())}
        else:
            values = np.arange(256, dtype=np.uint8)
            self.near = [np.packbits(np.bitwise_count(values[:, None] ^ self.code[None, :, j]) <= self.radii[j], axis=1) for j in self.live]

    def candidates(self, query_code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of every row that is probed."""
        n = len(self.rows)
        if self.width == 1:
            found = np.zeros((len(query_code), self.near[0].shape[1]), np.uint8)
            for j, table in zip(self.live, self.near, strict=True):
                found |= table[query_code[:, j]]
            return np.nonzero(np.unpackbits(found, axis=1, count=n))
        part = np.ascontiguousarray(query_code).view(">u2").astype(np.int64)
        keys = []
        for j, order, starts in zip(self.live, self.order, self.starts, strict=True):
            value = part[:, j, None] ^ self.around[int(self.radii[j])]
            lo = starts[value]
            size = starts[value + 1] - lo
            q, v = np.nonzero(size)
            lo, size = lo[q, v].astype(np.int64), size[q, v].astype(np.int64)
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - lo, size)
            keys.append(np.repeat(q, size) * n + order[at])
        key = np.unique(np.concatenate(keys))
        return key // n, key % n


def search_block(block: Block, queries: np.ndarray, query_codes: np.ndarray, radius: int, keep: int):
    """For each query the ``keep`` best rows of the block among those within ``radius``: query number, id, score, distance."""
    whole = block.code.shape[1] % 8 == 0
    code = block.code.view("u8") if whole else block.code
    out, rows8 = [], block.rows.astype("f8")
    step = max(1, PAIRS // max(1, len(block.rows)))
    for start in range(0, len(queries), step):
        qc = query_codes[start : start + step]
        q, r = block.candidates(qc)
        a = np.ascontiguousarray(qc).view("u8") if whole else qc
        apart = np.zeros(len(q), np.int64)
        for w in range(a.shape[1]):
            apart += np.bitwise_count(a[q, w] ^ code[r, w])
        inside = apart <= radius
        q, r, apart = q[inside], r[inside], apart[inside]
        score = np.empty(len(q))
        for at in range(0, len(q), SCORES):  # pair by pair, so that equal vectors score alike in every block
            some = slice(at, at + SCORES)
            score[some] = np.einsum("ij,ij->i", queries[start + q[some]].astype("f8"), rows8[r[some]])
        order = np.lexsort((block.least[r], -score, q))
        q, r, apart, score = q[order], r[order], apart[order], score[order]
        first = np.searchsorted(q, np.arange(len(qc)))
        top = np.arange(len(q)) - first[q] < keep
        for i, k, d, s in zip(q[top].tolist(), r[top].tolist(), apart[top].tolist(), score[top].tolist(), strict=True):
            out.extend((start + i, m, s, d) for m in block.members[k].tolist())
    return out


def code_rows(index: DataFrame, codes: Codes) -> DataFrame:
    """``index`` (vec_id, v, ...) with ``code``, the packed code of each vector."""
    sent = index.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = sent.value.of(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in found], pa.binary())], [*batch.schema.names, "code"])

    return index.mapInArrow(run, StructType([*index.schema.fields, StructField("code", BinaryType())]))


def _scan(index: DataFrame, codes: Codes, ids: np.ndarray, queries: np.ndarray, radius: int, keep: int, width: int = 1) -> DataFrame:
    """The ``keep`` best of all blocks for each query: query_id, rank, vec_id, score, apart."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast((ids, queries, codes.of(queries, True)))  # a group of bounded size

    def answer(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, query_codes = sent.value
        table = pa.Table.from_batches(rows).combine_chunks()
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        block = Block(table.column("vec_id").to_numpy(), _matrix(table.column("v").chunk(0)), code, radius, width, keep)
        found = search_block(block, queries, query_codes, radius, keep)
        if found:
            q, m, s, d = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids[np.array(q)]), pa.array(m, "int64"), pa.array(s, "float64"), pa.array(d, "int32")], ["query_id", "vec_id", "score", "apart"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                if n and n + piece.num_rows > BLOCK:
                    yield from answer(held)
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if held:
            yield from answer(held)

    found = index.mapInArrow(run, "query_id long, vec_id long, score double, apart int")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.dense_rank().over(best)).where(F.col("rank") <= keep)
    return ranked.dropDuplicates(["query_id", "rank"])  # rows that repeat in several blocks; dealt by query_id already


def _gather(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a bounded frame."""
    rows = df.select("vec_id", "v").toArrow().combine_chunks()
    if not rows.num_rows:
        return np.zeros(0, "i8"), np.zeros((0, 0), "f4")
    return rows.column("vec_id").to_numpy(), _matrix(rows.column("v").combine_chunks() if isinstance(rows.column("v"), pa.ChunkedArray) else rows.column("v"))


def search(vectors: DataFrame, is_query: Column, k: int = 20, column: str = "embedding", recall: float = 0.97, seed: int = 0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest inner product found for each row where ``is_query``.

    Rows with the query's own vec_id are left out; ties go to the smaller vec_id. Rows without a vec_id or a usable vector
    (null, zero, with null or non-finite components, not of the usual dimension) take no part. Rows that repeat a vec_id
    and its vector count once. Other columns are ignored.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.withColumn("_q", F.coalesce(is_query, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("v"), "_q")
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    dimension = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dimension is None:
        return empty
    index = rows.where(F.size("v") == dimension["d"])
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    stats = index.agg(F.max(length).alias("norm"), F.sum(F.col("_q").cast("long")).alias("queries"), F.count(F.lit(1)).alias("rows")).first()
    if not stats["queries"]:
        return empty
    _, sample = _gather(hashed_sample(index, SAMPLE, stats["rows"], "vec_id"))
    codes = learn(sample, stats["norm"], seed=seed)
    bits = codes.planes.shape[1]
    index = materialize(code_rows(index, codes))

    def queries_where(condition: Column) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
        """Distinct query vectors of one group: the smallest id, the vector, and all ids by the smallest."""
        ids, x = _gather(index.where("_q").where(condition))
        if not len(ids):
            return ids, x, {}
        own, members, _ = distinct(ids, x, len(ids))
        return np.array([m[0] for m in members]), own, {int(m[0]): m.tolist() for m in members}

    dealt = F.xxhash64("vec_id", F.lit(seed + 1))
    share = max(1, stats["queries"] // CALIBRATION)
    ids, x, _ = queries_where(F.pmod(dealt, F.lit(share)) == 0)
    radius, width = bits, 1
    if len(ids):
        near = _scan(index, codes, ids[: 2 * CALIBRATION], x[: 2 * CALIBRATION], bits, k + 1).where("vec_id != query_id")
        apart = np.array([r[0] for r in near.select("apart").collect()])
        radius = int(np.quantile(apart, recall, method="higher")) if len(apart) else bits
        width = cheaper_width(codes.of(sample), codes.of(x, True), radius, min(BLOCK, stats["rows"]))
    groups, out = -(-stats["queries"] // QUERIES), None
    for g in range(groups):
        ids, x, members = queries_where(F.pmod(dealt, F.lit(groups)) == g)
        if not len(ids):
            continue
        part = _answers(index, codes, ids, x, members, radius, k, width)
        out = part if out is None else out.unionByName(part)
    return empty if out is None else out


def _answers(index: DataFrame, codes: Codes, ids: np.ndarray, x: np.ndarray, members: dict[int, list[int]], radius: int, k: int, width: int) -> DataFrame:
    spark, bits = index.sparkSession, codes.planes.shape[1]
    best = materialize(_scan(index, codes, ids, x, radius, k + 1, width))
    if radius < bits:
        full = {r[0] for r in best.groupBy("query_id").count().where(F.col("count") > k).select("query_id").collect()}
        short = np.array([i not in full for i in ids.tolist()])
        if short.any():
            again = _scan(index, codes, ids[short], x[short], bits, k + 1)
            kept = best.where(~F.col("query_id").isin(ids[short].tolist())) if short.sum() <= 1000 else best.join(spark.createDataFrame([(i,) for i in ids[short].tolist()], "query_id long"), "query_id", "left_anti")
            best = kept.unionByName(again)
    pairs = spark.createDataFrame(pa.table({"first": [f for f, m in members.items() for _ in m], "query_id": [i for m in members.values() for i in m]}))
    named = best.withColumnRenamed("query_id", "first").join(F.broadcast(pairs), "first").where("vec_id != query_id")  # ids of one group
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
