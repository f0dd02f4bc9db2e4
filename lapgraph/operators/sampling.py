"""Stars as tables: merging, ordering, fractions, expected cliques, and sampling for all stars in one job."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapgraph.model import Config
from lapgraph.operators.kernels import uniform


def merge(entries: DataFrame, k: int = 1) -> DataFrame:
    """``pivot, neighbor, weight, copies, dropped``: parallel edges merged, copies capped at k."""
    merged = entries.groupBy("pivot", "neighbor").agg(F.sum("weight").alias("weight"), F.sum("copies").alias("c"))
    kept = F.least("c", F.lit(max(1, k)))
    return merged.select("pivot", "neighbor", "weight", kept.alias("copies"), (F.col("c") - kept).alias("dropped"))


def _order(pivot: str) -> Window:
    return Window.partitionBy(pivot).orderBy(F.col("weight") / F.col("copies"), "neighbor")


def order(stars: DataFrame) -> DataFrame:
    """``stars`` with ``place``, from 0: ascending weight per copy, then neighbour."""
    return stars.withColumn("place", F.row_number().over(_order("pivot")) - 1)


def fractions(stars: DataFrame) -> DataFrame:
    """``stars`` with ``total``, ``suffix``, ``fraction`` (weight of its suffix) and ``fill`` (weight of one sampled edge)."""
    # suffixes are taken downwards: Spark starts a frame that ends at the last row anew at every row
    down = Window.partitionBy("pivot").orderBy(F.desc(F.col("weight") / F.col("copies")), F.desc("neighbor"))
    later = F.coalesce(F.sum("weight").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = stars.withColumn("later", later).withColumn("total", F.sum("weight").over(Window.partitionBy("pivot")))
    out = out.withColumn("suffix", F.col("weight") + F.col("later")).withColumn("fraction", F.col("weight") / F.col("suffix"))
    return out.withColumn("fill", F.col("weight") * (F.col("later") / F.col("total")) / F.col("copies")).drop("later")


def expected_clique(stars: DataFrame, most: int = 4096) -> DataFrame:
    """``pivot, lo, hi, weight``: the edges that exact elimination of the pivot would leave, w_i * w_j / W.

    The result has a row per pair. A star of more than ``most`` neighbours is cut in groups, and each pair of groups is
    joined by itself, so that a task has ``most`` by ``most`` pairs at a time.
    """
    totals = stars.groupBy("pivot").agg(F.sum("weight").alias("total"), F.ceil(F.count(F.lit(1)) / most).cast("int").alias("groups"))
    own = stars.join(totals, "pivot").withColumn("group", F.pmod(F.xxhash64("neighbor"), "groups").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    a = own.select("pivot", F.col("neighbor").alias("lo"), F.col("weight").alias("a"), "total", F.col("group").alias("ga"), every.alias("gb"))
    b = own.select("pivot", F.col("neighbor").alias("hi"), F.col("weight").alias("b"), F.col("group").alias("gb"), every.alias("ga"))
    pairs = a.join(b, ["pivot", "ga", "gb"]).where("lo < hi")
    return pairs.select("pivot", "lo", "hi", (F.col("a") * F.col("b") / F.col("total")).alias("weight"))


def expected_weight(stars: DataFrame, factor: Column) -> DataFrame:
    """``w``: the sum over ``expected_clique`` of weight times ``factor`` (of ``lo``), by suffix sums instead of pairs."""
    merged = stars.groupBy("pivot", F.col("neighbor").alias("lo")).agg(F.sum("weight").alias("weight"))
    above = Window.partitionBy("pivot").orderBy(F.desc("lo")).rowsBetween(Window.unboundedPreceding, -1)
    own = merged.withColumn("later", F.coalesce(F.sum("weight").over(above), F.lit(0.0)))
    totals = stars.groupBy("pivot").agg(F.sum("weight").alias("total"))
    return own.join(totals, "pivot").agg(F.sum(F.col("weight") * F.col("later") / F.col("total") * factor).alias("w"))


def sample_stars(stars: DataFrame, seed: int = 0, k: int = 1) -> DataFrame:
    """``index, lo, hi, weight``: the sampled edges of every star of ``stars`` (index, neighbor, weight).

    Entry i (ascending) meets k later entries, drawn by weight; the draw is a hash of (seed, index, neighbour, copy), so a star's
    edges do not depend on other stars, their order or partitions. Stars without a positive finite total give no edges.
    Entries are sorted once and drawn from as they stream by; no draw is ever sorted or shuffled.
    """
    k = max(1, k)
    own = stars.where("weight is not null and neighbor is not null")
    own = own.select("index", F.col("neighbor").cast("long").alias("neighbor"), F.col("weight").cast("double").alias("weight"))
    # a star's entries follow each other from the greatest: the later entries of each one have passed before it
    own = own.repartition("index").sortWithinPartitions("index", F.desc("weight"), F.desc("neighbor"))
    own = own.withColumn("total", F.sum("weight").over(Window.partitionBy("index")))
    met = own.where((F.col("total") > 0) & (F.col("total") < float("inf")) & ~F.isnan("total")).withColumn("key", F.xxhash64(F.lit(seed), "index", "neighbor"))
    kind = stars.schema["index"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, passed = object(), Passed()
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column("index").dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            at = pa.array(np.array(cuts[:-1]))
            names = batch.column("index").take(at).to_pylist()
            if names[0] != last:
                passed = Passed()
            neighbor, weight, total = (batch.column(c).to_numpy() for c in ("neighbor", "weight", "total"))
            key = batch.column("key").to_numpy().astype(np.uint64)
            passed, of, to, fill = passed.draw(np.array(cuts), neighbor, weight, total, key, k)
            last = names[-1]
            for x in range(0, len(of), DRAWS):
                a, b = neighbor[of[x : x + DRAWS]], to[x : x + DRAWS]
                index = batch.column("index").take(pa.array(of[x : x + DRAWS]))
                yield pa.RecordBatch.from_arrays([index, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(fill[x : x + DRAWS])], ["index", "lo", "hi", "weight"])

    return met.mapInArrow(run, f"index {kind}, lo long, hi long, weight double")


#: Draws that leave a task's Python at once.
DRAWS = 65_536


class Passed:
    """The entries of a star that have gone by, from the greatest: neighbours and running sums of weights (16 bytes each)."""

    def __init__(self, neighbors: list[np.ndarray] | None = None, sums: list[np.ndarray] | None = None):
        self.neighbors, self.sums = neighbors or [], sums or []

    def draw(self, cuts: np.ndarray, neighbor: np.ndarray, weight: np.ndarray, total: np.ndarray, key: np.ndarray, k: int):
        """Entries of a batch, star by star between ``cuts``; the first star continues this one.

        What has passed of the last star; and of every drawn edge the entry, the later entry's name and the weight.
        """
        before = float(self.sums[-1][-1]) if self.sums else 0.0
        start = np.repeat(cuts[:-1], np.diff(cuts))
        sums = _running(weight, start)
        first = slice(0, int(cuts[1]))
        sums[first] += before
        at = np.arange(len(weight))
        later = np.where(at > start, sums[np.maximum(at - 1, 0)], 0.0)
        if before:
            later[0] = before
        fill = weight * (later / total) / k
        of = np.repeat(np.flatnonzero((later > 0) & (fill > 0)), k)
        copy = np.tile(np.arange(k), len(of) // k)
        r = later[of] * (1.0 - uniform(0, key[of], copy))
        # the first entry, from the greatest, by which the running sum reaches r
        low, high = start[of], of - 1
        if self.sums:  # the first star's draws may go to entries of earlier batches
            mine = np.flatnonzero(of < cuts[1])
            old = mine[r[mine] <= before]
        else:
            old = np.zeros(0, np.int64)
        high = np.maximum(high, low)
        while (low < high).any():
            mid = (low + high) // 2
            reaches = sums[mid] >= r
            high = np.where(reaches, mid, high)
            low = np.where(reaches, low, np.minimum(mid + 1, high))
        to = neighbor[low]
        if len(old):
            self._joined()
            to[old] = self.neighbors[0][np.minimum(np.searchsorted(self.sums[0], r[old], side="left"), len(self.sums[0]) - 1)]
        tail = slice(int(cuts[-2]), len(weight))
        if len(cuts) == 2:
            own = Passed([*self.neighbors, neighbor[tail].copy()], [*self.sums, sums[tail].copy()])
        else:
            own = Passed([neighbor[tail].copy()], [sums[tail].copy()])
        loop = to == neighbor[of]  # a neighbour that stands twice in its star
        return own, of[~loop], to[~loop], fill[of][~loop]

    def _joined(self) -> None:
        if len(self.sums) > 1:
            self.neighbors, self.sums = [np.concatenate(self.neighbors)], [np.concatenate(self.sums)]


def _running(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running sums of runs, each begun at ``start``; doubled spans keep them accurate."""
    s, at, d = x.copy(), np.arange(len(x)), 1
    span = int((at - start).max()) + 1 if len(x) else 0
    while d < span:
        inside = at - d >= start
        s[inside] += s[at[inside] - d].copy()
        d *= 2
    return s


@dataclass(frozen=True)
class StarSampler:
    """``sample_stars`` with what a configuration asks for; ``copies`` is how often edges are split in effect."""

    seed: int = 0
    copies: int = 1

    @staticmethod
    def of(config: Config) -> StarSampler:
        return StarSampler(config.seed, config.copies)

    def sample(self, stars: DataFrame) -> DataFrame:
        return sample_stars(stars, self.seed, self.copies)
