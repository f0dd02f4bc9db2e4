"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get gapless numbers 0..N-1 that depend on their values alone; a seeded permutation of 0..N-1
then deals them out: ``shard = p mod shards`` and ``slot = p div shards``. Shards differ by one row at most, and the
place of any row follows from (row number, N, shards, seed) without looking at other rows.

Scale: one pass reads the rows; what is shuffled, and written once, is the narrow key columns, pre-aggregated. Equal rows (a
null id on a third of the table, say) travel as one row with a count, which becomes rows again SPAN at a time, dealt over
the tasks. Numbers are made in BUCKETS hash buckets, whose totals are the only thing that one task sees together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapgraph.functions.expressions import let
from lapgraph.storage import materialize

#: Hash buckets in which rows are numbered; the table of their totals has so many rows at most, at any size.
BUCKETS = 4096
#: Equal rows that are made from one row at most.
SPAN = 65_536
ROUNDS = 6
#: Steps of cycle walking. The domain a*b has fewer than a = ceil(sqrt(N)) surplus points: for N <= 4096 no walk
#: is longer, and beyond the chance of a longer one is under N * (1/64)**64. A longer one raises an error.
WALK = 64


def feistel(x: Column, a: Column, b: Column, seed: int) -> Column:
    """One pass of the network over 0..a*b-1: halves in Z_a and Z_b, changed in turn by a hash of the other."""
    halves = F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left = (s["l"] + F.pmod(F.xxhash64(F.lit(seed).cast("long"), i, s["r"]), a)) % a
        right = (s["r"] + F.pmod(F.xxhash64(F.lit(seed).cast("long"), i, s["l"]), b)) % b
        even = i % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

    rounds = F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long"))
    return F.aggregate(rounds, halves, turn, lambda s: s["l"] * b + s["r"])


def permute(x: Column, n: Column, a: Column, b: Column, seed: int) -> Column:
    """The permutation of 0..n-1: the network, applied again while the value lies outside."""
    walked = let(
        feistel(x, a, b, seed),
        lambda p: F.when(p < n, p).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), p, lambda q, _: F.when(q < n, q).otherwise(feistel(q, a, b, seed)))
        ),
    )
    return let(walked, lambda p: F.when(p < n, p).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long")))


def number_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with ``row_number`` (0..n-1, gapless) and ``n_rows``.

    Numbers depend on the values of ``rows`` only, not on files, partitions or order. Equal rows get consecutive
    numbers. Nulls are values like others. An empty table gives an empty table. Any names of columns will do.
    """
    own = [f"c{i}" for i in range(len(rows.columns))]  # names that clash with none below
    groups = rows.toDF(*own).groupBy(*own).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", F.pmod(F.xxhash64(*own), F.lit(BUCKETS)))
    within = Window.partitionBy("_bucket").orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)
    groups = materialize(groups.withColumn("_start", F.coalesce(F.sum("_n").over(within), F.lit(0).cast("long"))))
    totals = groups.groupBy("_bucket").agg(F.max(F.col("_start") + F.col("_n")).alias("_t"))
    whole = Window.partitionBy(F.lit(0))
    offsets = totals.select(
        "_bucket",
        (F.sum("_t").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")).alias("_offset"),
        F.sum("_t").over(whole).alias("n_rows"),
    )
    placed = groups.join(F.broadcast(offsets), "_bucket").withColumn("_start", F.col("_offset") + F.col("_start"))  # BUCKETS rows at most
    zero = F.lit(0).cast("long")
    part = F.col("_part") * SPAN
    small = placed.where(F.col("_n") <= SPAN).withColumn("_part", zero)
    large = placed.where(F.col("_n") > SPAN).withColumn("_part", F.explode(F.sequence(zero, F.floor((F.col("_n") - 1) / SPAN)))).repartition("_start", "_part")
    each = F.explode(F.sequence(part, F.least(part + SPAN, F.col("_n")) - 1))
    out = small.unionByName(large).withColumn("_i", each)
    return out.select(*own, (F.col("_start") + F.col("_i")), "n_rows").toDF(*rows.columns, "row_number", "n_rows")


def shard_rows(rows: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """``rows`` with ``row_number``, ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Columns of these names (and ``n_rows``) in ``rows`` are replaced; others keep their names and values.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    names = [c for c in rows.columns if c not in {"row_number", "n_rows", "shard", "slot"}]
    own = [f"c{i}" for i in range(len(names))]
    numbered = number_rows(rows.select(*names).toDF(*own))
    a = F.ceil(F.sqrt(F.col("n_rows"))).cast("long")
    numbered = numbered.withColumn("_a", a).withColumn("_b", F.floor((F.col("n_rows") + F.col("_a") - 1) / F.col("_a")).cast("long"))
    p = permute(F.col("row_number"), F.col("n_rows"), F.col("_a"), F.col("_b"), seed)
    out = numbered.withColumn("_p", p).select(*own, "row_number", (F.col("_p") % n_shards).cast("int"), F.floor(F.col("_p") / n_shards).cast("long"))
    return out.toDF(*names, "row_number", "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 0) -> DataFrame:
    """``doc_id, size, text_crc32, row_number, shard, slot`` of every document; other columns are ignored.

    A null text counts as empty (size 16, checksum 0); a null doc_id is kept.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(rows, n_shards, seed)
