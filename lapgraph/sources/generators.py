"""Graphs by rule, as edge DataFrames (u, v, w) made where they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(max(0, n - 1)).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("w"))


def grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    cells = spark.range(rows * cols)
    right = cells.where(F.col("id") % cols < cols - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    down = cells.where(F.col("id") < (rows - 1) * cols).select(F.col("id").alias("u"), (F.col("id") + cols).alias("v"))
    return right.unionByName(down).withColumn("w", F.lit(1.0))


def banded(spark: SparkSession, n: int, half_bandwidth: int) -> DataFrame:
    near = spark.range(n).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(1), F.lit(half_bandwidth))).alias("k"))
    return near.select("u", (F.col("u") + F.col("k")).alias("v"), F.lit(1.0).alias("w")).where(F.col("v") < n)


def complete(spark: SparkSession, n: int) -> DataFrame:
    ends = spark.range(max(0, n - 1)).select(F.col("id").alias("u"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1))).alias("v"))
    return ends.select("u", "v", F.lit(1.0).alias("w"))


def interleaved_paths(spark: SparkSession, n: int, k: int) -> DataFrame:
    """k paths; vertex v lies on path v mod k."""
    return spark.range(max(0, n - k)).select(F.col("id").alias("u"), (F.col("id") + k).alias("v"), F.lit(1.0).alias("w"))


def preferential(spark: SparkSession, n: int, m: int, seed: int = 0) -> DataFrame:
    """A graph with a heavy-tailed degree: each vertex links to m earlier ones, early ones more likely."""
    draw = F.pmod(F.xxhash64("id", "k", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    ends = spark.range(1, n).select("id", F.explode(F.sequence(F.lit(1), F.lit(m))).alias("k"))
    return ends.select(F.col("id").alias("u"), F.floor(F.col("id") * draw * draw).alias("v")).distinct().withColumn("w", F.lit(1.0))
