"""Connected components: pieces within tasks, then large-star and small-star contraction of the pieces.

Each task joins what its own edges join, a piece. One aggregation by vertex finds the vertices that lie in several pieces;
only the links between these pieces are left. If they are few (counted, not guessed), one task joins them; otherwise rounds
do, each of which links every piece to the least one it knows, first among all neighbours, then among the smaller ones.
Edges that come in an order that keeps neighbours together leave few links. Rounds are logarithmic in the number of
vertices on the graphs that occur, long paths included. Only least and greatest values are aggregated (partially before
the shuffle), so no neighbourhood meets in one task; joins on a hot vertex can be split by AQE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapgraph.storage import materialize, release

#: Edges that a task joins at once, and edges up to which one task joins what is left (16 bytes each).
CHUNK, FINISH = 500_000, 1_000_000


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges and the least vertex that each is joined to."""
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(names))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return names, names[root]


def with_pieces(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v[, w]) with ``piece``: the least vertex that each edge is joined to by the edges of its chunk."""
    weighted = "w" in edges.columns
    names = ["u", "v", "w"] if weighted else ["u", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
            found, roots = least_labels(u, v)
            piece, at = roots[np.searchsorted(found, u)], 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(piece[at : at + b.num_rows])], [*names, "piece"])
                at += b.num_rows

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= CHUNK:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return edges.select(*names).mapInArrow(run, "u long, v long, w double, piece long" if weighted else "u long, v long, piece long")


def placed(pieces: DataFrame, own: DataFrame, finish: int = FINISH, rounds: int = 64) -> DataFrame | None:
    """``piece, component`` of the pieces that belong to another; None if there are none.

    ``own`` has the least and the greatest piece of each vertex: ``vertex, piece, last``.
    """
    shared = own.where("piece < last").select("vertex", F.col("piece").alias("least"))
    ends = pieces.select(F.explode(F.array("u", "v")).alias("vertex"), "piece")
    links = materialize(ends.join(shared, "vertex").where("piece != least").select(F.col("piece").alias("u"), F.col("least").alias("v")).distinct())
    count = links.count()
    if count == 0:
        release(links)
        return None
    found = _finished(links) if count <= finish else _settled(links, rounds)
    moved = materialize(found.where("vertex != component").select(F.col("vertex").alias("piece"), "component"))
    release(links)
    return moved


def _finished(edges: DataFrame) -> DataFrame:
    """``vertex, component`` of the vertices of few edges (u, v), joined in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            names, roots = least_labels(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")))
            for at in range(0, len(names), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65_536]) for x in (names, roots)], ["vertex", "component"])

    return edges.coalesce(1).mapInArrow(run, "vertex long, component long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 64, finish: int = FINISH) -> DataFrame:
    """``vertex, component`` of every vertex that has an edge to another; the component is its least vertex.

    Edges with a null end and loops are ignored, repeated edges count once. ``finish``: links left up to which one task
    ends the work; the result does not depend on it.
    """
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u != v")
    pieces = materialize(with_pieces(e))
    if pieces.count() <= finish:
        return _finished(pieces)
    ends = pieces.select(F.explode(F.array("u", "v")).alias("vertex"), "piece")
    own = materialize(ends.groupBy("vertex").agg(F.min("piece").alias("piece"), F.max("piece").alias("last")))
    moved = placed(pieces, own, finish, rounds)
    release(pieces)
    if moved is None:
        return own.select("vertex", F.col("piece").alias("component"))
    return own.join(moved, "piece", "left").select("vertex", F.coalesce("component", "piece").alias("component"))


def _settled(edges: DataFrame, rounds: int) -> DataFrame:
    """``vertex, component`` by rounds of contraction."""
    e, state = edges, None
    for _ in range(rounds):
        before, e = e, materialize(_small_star(_large_star(e)))
        if before is not edges:
            release(before)
        row = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (row[0], row[1]) == state:
            roots = e.select(F.col("v").alias("vertex")).distinct()
            return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots.select("vertex", F.col("vertex").alias("component")))
        state = (row[0], row[1])
    raise RuntimeError(f"components did not settle in {rounds} rounds")
