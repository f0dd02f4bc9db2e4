"""What the operators in Python share: Arrow batches of texts in bounded slices."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapgraph.storage import materialize

#: Bytes of text (or one row, if longer) and rows that a slice of a batch holds at most.
SLICE_BYTES, SLICE_ROWS = 2_000_000, 4096


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy() -> None:
    """Give memory that is free back to the machine: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """``batch`` in consecutive pieces whose ``column`` holds about ``limit`` bytes at most."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > limit or i - start >= rows):
            yield batch.slice(start, i - start)
            start = i
            total = 0
        total += int(n)
    if len(sizes) > start:
        yield batch.slice(start)
    tidy()


#: Bytes of an Arrow batch on its way to Python, about, where memory is scarce.
BATCH_BYTES = 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold about BATCH_BYTES: a batch of 10,000 rows of texts lies in memory four times a task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def hashed_sample(df: DataFrame, n: int, total: int, *key: str | Column) -> DataFrame:
    """The n rows of least hash of ``key`` (all, if there are no more), the same on every call.

    Rows whose hash is surely too great are filtered where they lie, so that the last sort sees little more than n rows
    at any size of the table of ``total`` rows.
    """
    h = F.xxhash64(*key)
    share = (n + 6 * math.sqrt(n) + 10) / max(1, total)
    some = df if share >= 0.9 else df.where(h < F.lit(int(-(2**63) + share * 2**64)).cast("long"))
    return some.orderBy(h, *key).limit(n)


#: Share of the rows of ``spread_join``'s left side that one key may bring to one task, and rows below which nothing is split.
SPREAD_SHARE, SPREAD_LEAST = 100_000, 500


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left.join(right, key, how)`` (inner or left) for a ``right`` with one row a key, though a third of ``left`` has one key.

    Rows of a key that holds more than 1 / SPREAD_SHARE of ``left`` are dealt over as many copies of its row as it needs.
    There are fewer than SPREAD_SHARE such keys at any size, so their list is broadcast. ``left`` should be written: it is
    read twice, and its rows are numbered by their place.
    """
    total = left.count()
    limit = max(SPREAD_LEAST, total // SPREAD_SHARE)
    sizes = left.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
    hot = materialize(sizes.select(key, F.ceil(F.col("_rows") / limit).cast("int").alias("_parts")))
    if hot.isEmpty():
        return left.join(right, key, how)
    hot = F.broadcast(hot)  # SPREAD_SHARE rows at most
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("_parts")
    copies = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [key, "_part"], how).drop("_part")
