"""Elimination in rounds, for blocks that no single task can hold.

A round eliminates an independent set of vertices of low degree (each is the least of its neighbourhood by degree, then
by a hash), all stars in one job: pivots that do not touch each other commute. Stars are sampled as in the sequential
kernel, so the expectation of what is left is the exact Schur complement. A solve takes a join and an aggregation per
round, down and up; a round hands on only what later rounds still need, so that the whole is a small multiple of the first.
What is left in the end may be factored block by block, if a task can hold it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapgraph.operators import vectors
from lapgraph.operators.ingest import Graph
from lapgraph.operators.sampling import sample_stars
from lapgraph.storage import materialize, release

#: Pivots of degree 1 and 2 are taken alone while there is one for so many edges.
FEW = 50


@dataclass
class RoundFactor:
    """``steps`` by round: tables (vertex, inverse, to, share), one row per neighbour.

    ``rest``: the factor table of what the rounds left, blocks without a ground; None if they ended with a vertex a block.
    """

    graph: Graph
    steps: list[DataFrame]
    rest: DataFrame | None = None

    @property
    def n_steps(self) -> int:
        own = self.rest.agg(F.coalesce(F.sum(F.col("dim") - 1), F.lit(0))).first()[0] if self.rest is not None else 0
        return own + sum(s.select("vertex").distinct().count() for s in self.steps)

    def solve(self, rhs: DataFrame, gauge: str = "canonical") -> DataFrame:
        """``vertex, value``: the solution for ``rhs`` (vertex, value)."""
        one = rhs.select("vertex", "value", F.lit(0).alias("system"))
        return self._solve(one, self.graph.vertices.select("vertex", "block", F.lit(0).alias("system")), gauge).select("vertex", "value")

    def solve_named(self, rhs: DataFrame, gauge: str = "canonical") -> DataFrame:
        """``system_id, vertex, value``: solutions for ``rhs`` (system_id, vertex, value), in the blocks that each right side touches."""
        # a key without nulls, for joins
        own = rhs.select("vertex", "value", F.coalesce(F.concat(F.lit("="), F.col("system_id").cast("string")), F.lit("")).alias("system"))
        touched = own.join(self.graph.vertices, "vertex").select("block", "system").distinct()
        places = self.graph.vertices.select("vertex", "block").join(touched, "block").select("vertex", "block", "system")
        name = F.when(F.col("system") != "", F.expr("substring(system, 2)"))
        return self._solve(own, places, gauge).select(name.alias("system_id"), "vertex", "value")

    def _solve(self, rhs: DataFrame, places: DataFrame, gauge: str) -> DataFrame:
        """``system, vertex, value`` for ``rhs`` (vertex, value, system); ``places`` (vertex, block, system): what is asked for."""
        asked = materialize(vectors.prepare_systems(places, rhs, self.graph.n))
        y, mine = asked.select("vertex", "system", "value"), []
        for s in self.steps:
            pivots = s.select("vertex").distinct().withColumn("pivot", F.lit(True))
            marked = materialize(y.join(pivots, "vertex", "left").select("vertex", "system", "value", F.col("pivot").isNotNull().alias("pivot")))
            mine.append(marked.where("pivot").drop("pivot"))
            sent = s.join(mine[-1], "vertex").select(F.col("to").alias("vertex"), "system", (F.col("share") * F.col("value")).alias("value"))
            y = marked.where("not pivot").drop("pivot").unionByName(sent).groupBy("vertex", "system").agg(F.sum("value").alias("value"))
        parts = [self._end(y)] if self.rest is not None else []
        for s, own in zip(reversed(self.steps), reversed(mine), strict=True):
            if parts:
                known = reduce(DataFrame.unionByName, parts).select(F.col("vertex").alias("to"), "system", F.col("value").alias("known"))
                back = s.join(known, "to").groupBy("vertex", "system").agg(F.sum(F.col("share") * F.col("known")).alias("back"))
                # inverse is the same in all rows of a vertex
                value = F.col("value") * F.col("inverse") + F.coalesce("back", F.lit(0.0))
                met = own.join(s.groupBy("vertex").agg(F.first("inverse").alias("inverse")), "vertex").join(back, ["vertex", "system"], "left")
            else:
                value, met = F.col("value") * F.col("inverse"), own.join(s.groupBy("vertex").agg(F.first("inverse").alias("inverse")), "vertex")
            parts.append(materialize(met.select("vertex", "system", value.alias("value"))))
        x = reduce(DataFrame.unionByName, parts) if parts else y.where(F.lit(False))
        return vectors.recover_systems(asked, x, self.graph.n, gauge)

    def _end(self, y: DataFrame) -> DataFrame:
        """``vertex, system, value``: the rest solved for what the rounds sent to it."""
        from lapgraph.model import Config
        from lapgraph.operators.factor import Factor

        kind = y.schema["system"].dataType
        found = Factor(self.rest, self.graph.n + 1, Config()).solve(y.select("vertex", "value", F.col("system").cast("string").alias("system_id")))
        return materialize(found.select("vertex", F.col("system_id").cast(kind).alias("system"), "value"))

    def save(self, path: str) -> None:
        """Write the graph and the steps as Parquet tables."""
        self.graph.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
        self.graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
        for i, s in enumerate(self.steps):
            s.write.mode("overwrite").parquet(f"{path}/steps-{i}")
        if self.rest is not None:
            self.rest.write.mode("overwrite").parquet(f"{path}/rest")

    def fault(self) -> str | None:
        """The first broken rule of the steps."""
        real = lambda x: ~(F.isnan(x) | (F.abs(x) == float("inf")))
        steps = self.graph.vertices.sparkSession.createDataFrame([], "vertex long, inverse double, to long, share double, turn int")
        for i, s in enumerate(self.steps):
            steps = steps.unionByName(s.select("vertex", "inverse", "to", "share", F.lit(i).alias("turn")))
        steps = materialize(steps)
        sound = real(F.col("inverse")) & real(F.col("share")) & F.col("share").between(0, 1)
        if not steps.where(~F.coalesce(sound, F.lit(False))).isEmpty():
            return "a value of a step"
        pivots = steps.select("vertex", "turn").distinct()
        if not pivots.groupBy("vertex").count().where("count > 1").isEmpty():
            return "a vertex eliminated twice"
        blocks = self.graph.vertices.select("vertex", "block")
        ends = steps.join(blocks, "vertex").join(blocks.toDF("to", "to_block"), "to", "left").join(pivots.toDF("to", "to_turn"), "to", "left")
        if not ends.where(~F.coalesce(F.col("block") == F.col("to_block"), F.lit(False)) | (F.col("to_turn") <= F.col("turn"))).isEmpty():
            return "a vertex out of bounds"
        left = blocks.join(pivots, "vertex", "left").where("turn is null").select("vertex", "block")
        if self.rest is None:
            return None if left.groupBy("block").count().where("count != 1").isEmpty() and left.count() == blocks.select("block").distinct().count() else "number of steps"
        from lapgraph.operators.factor import faults

        if (fault := faults(self.rest).orderBy("block", "kind").first()) is not None:
            return fault["kind"]
        held = self.rest.select("block", F.explode("vertices").alias("vertex"))
        both = left.withColumn("n", F.lit(1)).unionByName(held.withColumn("n", F.lit(-1))).groupBy("vertex", "block").agg(F.sum("n").alias("n"))
        return None if both.where("n != 0").isEmpty() else "number of steps"


def load(spark: SparkSession, path: str, turns: int, n: int, grounded: bool, rest: str | None = None) -> RoundFactor:
    """What ``save`` wrote; ``rest``: the schema of the rest, if there is one."""
    graph = Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), n, grounded)
    return RoundFactor(graph, [spark.read.parquet(f"{path}/steps-{i}") for i in range(turns)], spark.read.schema(rest).parquet(f"{path}/rest") if rest else None)


def _ranked(edges: DataFrame, turn: int) -> DataFrame:
    """``early, late, degree, w, c`` of edges (u, v, w): the end that goes first by degree, then by a hash, and its degree."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("du"))
    both = edges.join(ends, "u").join(ends.toDF("v", "dv"), "v")
    rank = lambda x, d: F.struct(F.col(d), F.xxhash64(x, F.lit(turn)).alias("h"), F.col(x).alias("x"))
    first = rank("u", "du") < rank("v", "dv")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return both.select(pick("u", "v").alias("early"), pick("v", "u").alias("late"), pick("du", "dv").cast("int").alias("degree"), "w")


def eliminate(graph: Graph, seed: int = 0, copies: int = 1, cap: int = 64, most: int = 10_000, finish: Callable[[Graph], DataFrame] | None = None, left: int = 0) -> RoundFactor:
    """Eliminate all vertices but one of each block.

    ``cap``: greatest degree of a pivot, doubled when none is lower. While enough pivots have one or two neighbours, only
    these are taken, so that nothing is sampled on forests and cycles. ``finish``: the factor table of a graph, by which
    the rest is eliminated once it has ``left`` edges or fewer.
    """
    edges, steps, turn = materialize(graph.edges.select("u", "v", "w").where("w > 0")), [], 0
    while (count := edges.count()) > left:
        if turn >= most:
            raise RuntimeError(f"elimination did not end in {most} rounds")
        ranked = materialize(_ranked(edges, turn))
        # who never comes late is a pivot: its edges are those where it comes early
        beaten = ranked.select(F.col("late").alias("early")).distinct().withColumn("beaten", F.lit(True))
        marked = materialize(ranked.join(beaten, "early", "left").select("early", "late", "degree", "w", F.col("beaten").isNull().alias("free")))
        release(ranked)
        tally = marked.where("free").agg(F.min("degree"), F.coalesce(F.sum(F.when(F.col("degree") <= 2, 1)), F.lit(0))).first()
        while cap < tally[0]:
            cap *= 2
        most_near = 2 if tally[1] * FEW >= count else cap
        own = F.col("free") & (F.col("degree") <= most_near)
        stars = marked.where(own).select(F.col("early").alias("p"), F.col("late").alias("q"), "w")
        whole = stars.withColumn("total", F.sum("w").over(Window.partitionBy("p")))
        steps.append(materialize(whole.select(F.col("p").alias("vertex"), (1 / F.col("total")).alias("inverse"), F.col("q").alias("to"), (F.col("w") / F.col("total")).alias("share"))))
        fill = sample_stars(stars.select(F.col("p").alias("index"), F.col("q").alias("neighbor"), F.col("w").alias("weight")), seed + turn, copies)
        kept = marked.where(~own).select(F.least("early", "late").alias("u"), F.greatest("early", "late").alias("v"), "w")
        grown = kept.unionByName(fill.select(F.col("lo").alias("u"), F.col("hi").alias("v"), F.col("weight").alias("w")))
        before, edges = edges, materialize(grown.groupBy("u", "v").agg(F.sum("w").alias("w")))
        release(before, marked)
        turn += 1
    if finish is None or not count:
        return RoundFactor(graph, steps)
    return RoundFactor(graph, steps, finish(_remainder(graph, edges, steps)))


def _remainder(graph: Graph, edges: DataFrame, steps: list[DataFrame]) -> Graph:
    """What no step has eliminated, as a graph of its own without a ground."""
    names = graph.vertices.select("vertex", "block")
    if steps:
        gone = reduce(DataFrame.unionByName, [s.select("vertex") for s in steps])
        names = names.join(gone, "vertex", "left_anti")
    ends = edges.select(F.explode(F.array("u", "v")).alias("vertex"), "w").groupBy("vertex").agg(F.sum("w").alias("diagonal"))
    vertices = materialize(names.join(ends, "vertex", "left").select("vertex", F.coalesce("diagonal", F.lit(0.0)).alias("diagonal"), "block"))
    own = materialize(edges.join(vertices.select(F.col("vertex").alias("u"), "block"), "u").select("u", "v", "w", "block"))
    return Graph(vertices, own, graph.n + 1, False)
