"""Right sides and solutions as tables, block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapgraph.operators.ingest import Graph


def _full(graph: Graph, rhs: DataFrame) -> DataFrame:
    own = rhs.groupBy("vertex").agg(F.sum("value").alias("value"))
    return graph.vertices.select("vertex", "block").join(own, "vertex", "left").fillna(0.0, ["value"])


def prepare(graph: Graph, rhs: DataFrame) -> DataFrame:
    """``vertex, block, value`` of all vertices: floating blocks lose their mean, the ground gets minus the sum of its block."""
    full = _full(graph, rhs)
    sums = full.groupBy("block").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("dim"), F.max("vertex").alias("last"))
    met = full.join(sums, "block")
    grounded = F.col("last") == graph.n
    value = F.when(~grounded, F.col("value") - F.col("total") / F.col("dim")).when(F.col("vertex") == graph.n, -F.col("total")).otherwise(F.col("value"))
    return met.select("vertex", "block", value.alias("value"))


def recover(graph: Graph, x: DataFrame, gauge: str = "canonical") -> DataFrame:
    """``vertex, value`` of the matrix's rows: the last vertex of each block at 0, floating blocks centred if canonical."""
    met = graph.vertices.select("vertex", "block").join(x.select("vertex", "value"), "vertex", "left").fillna(0.0, ["value"])
    ends = met.groupBy("block").agg(F.max_by("value", "vertex").alias("pin"), F.avg("value").alias("mean"), F.max("vertex").alias("last"))
    shift = F.when((F.col("last") == graph.n) | F.lit(gauge != "canonical"), F.col("pin")).otherwise(F.col("mean"))
    return met.join(ends, "block").where(F.col("vertex") < graph.n).select("vertex", (F.col("value") - shift).alias("value"))


def prepare_systems(places: DataFrame, rhs: DataFrame, n: int) -> DataFrame:
    """``prepare`` for many right sides: ``vertex, block, system, value`` of all ``places`` (vertex, block, system)."""
    own = rhs.groupBy("vertex", "system").agg(F.sum("value").alias("value"))
    full = places.join(own, ["vertex", "system"], "left").fillna(0.0, ["value"])
    sums = full.groupBy("block", "system").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("dim"), F.max("vertex").alias("last"))
    value = F.when(F.col("last") != n, F.col("value") - F.col("total") / F.col("dim")).when(F.col("vertex") == n, -F.col("total")).otherwise(F.col("value"))
    return full.join(sums, ["block", "system"]).select("vertex", "block", "system", value.alias("value"))


def recover_systems(places: DataFrame, x: DataFrame, n: int, gauge: str = "canonical") -> DataFrame:
    """``recover`` for many solutions ``x`` (vertex, system, value): ``system, vertex, value`` of ``places`` (vertex, block, system)."""
    met = places.select("vertex", "block", "system").join(x, ["vertex", "system"], "left").fillna(0.0, ["value"])
    ends = met.groupBy("block", "system").agg(F.max_by("value", "vertex").alias("pin"), F.avg("value").alias("mean"), F.max("vertex").alias("last"))
    shift = F.when((F.col("last") == n) | F.lit(gauge != "canonical"), F.col("pin")).otherwise(F.col("mean"))
    return met.join(ends, ["block", "system"]).where(F.col("vertex") < n).select("system", "vertex", (F.col("value") - shift).alias("value"))


def degree_bucket(degree: Column, base: int) -> Column:
    """The bucket of a degree: its own up to base, shared ones beyond, 2 * base the last."""
    return F.when(degree <= base, degree).otherwise(F.least(F.lit(base) + F.floor(degree / base), F.lit(2 * base))).cast("long")
