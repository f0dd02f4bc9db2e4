"""The factor of a matrix: a table with a row per block, and what can be done with it.

Blocks are independent: they are factored and solved in parallel, a batch of blocks per Arrow batch. Blocks of one size
on the exact arm are handled together. A block of up to LOCAL vertices and edges is the work of one task; greater ones are
eliminated in ``rounds``, each a job over all of them, until a task can hold what is left.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapgraph.model import Backend, Config, CsrError, DenseFactorizationFailed, DenseFailure, ExactFailure, FactorError, Fallback, SolveError
from lapgraph.operators import kernels, rounds
from lapgraph.operators.ingest import Graph, ingest
from lapgraph.sources.matrix import Matrix, from_any, from_csr
from lapgraph.storage import materialize

FORMAT_VERSION = 1
STEPS = "steps array<struct<vertex: bigint, inverse: double, to: array<bigint>, share: array<double>>>"
SCHEMA = f"block long, dim long, anchor string, arm string, vertices array<long>, lower array<double>, {STEPS}, uneliminated long, fallback string, fallback_vertex long, failure string"
#: Scalars of a packed triangle beyond which a block is not factored exactly.
MOST_SCALARS = 200_000_000
#: Vertices and edges up to which a block is factored in one task, in about 150 bytes each.
LOCAL = 2_000_000
#: Vertices and rows of a piece of a batch that is worked on at once, scalars of matrices stacked at once, and systems
#: whose right sides meet a block at once.
SLICE, SLICE_ROWS, STACK, SYSTEMS = 500_000, 2048, 16_000_000, 32


def _gathered(graph: Graph) -> DataFrame:
    """A row per block: ``block, vertices, diagonal, u, v, w``, vertices ascending."""
    own = graph.vertices.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("vertex", "diagonal"))).alias("vs"))
    edges = graph.edges.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("u", "v", "w"))).alias("es"))
    both = own.join(edges, "block", "left")
    part = lambda c, f: F.transform(c, lambda x: x[f]).alias(f)
    return both.select("block", F.transform("vs", lambda x: x["vertex"]).alias("vertices"), part("vs", "diagonal"), part("es", "u"), part("es", "v"), part("es", "w"))


def _lists(column: pa.ListArray):
    """The values of a row of a list column, by row, without Python objects."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return lambda i: flat[offsets[i] : offsets[i + 1]]


def _slices(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces that hold about SLICE values of list columns, and SLICE_ROWS rows at most."""
    total = np.cumsum(sum(np.diff(batch.column(c).offsets.to_numpy()).astype(np.int64) for c in columns))
    piece = np.maximum(total // SLICE, np.arange(len(total)) // SLICE_ROWS)
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(total)]
    yield from (batch.slice(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False) if y > x)


def _stacks(rows: list, scalars: int) -> Iterator[list]:
    """``rows`` in runs that may be stacked: STACK scalars in all at most, or one row."""
    size = max(1, STACK // max(1, scalars))
    yield from (rows[i : i + size] for i in range(0, len(rows), size))


def _factor_rows(batch: pa.RecordBatch, config: Config, n: int) -> pa.RecordBatch:
    names, get = batch.column("block").to_pylist(), {c: _lists(batch.column(c)) for c in ("vertices", "diagonal", "u", "v", "w")}
    out, exact = [], {}
    for i, block in enumerate(names):
        vertices = get["vertices"](i)
        dim, solved = len(vertices), len(vertices) - 1
        graph = (get["diagonal"](i), np.searchsorted(vertices, get["u"](i)), np.searchsorted(vertices, get["v"](i)), get["w"](i))
        row = {"block": block, "dim": dim, "anchor": "ground" if vertices[-1] == n else "floating", "vertices": vertices, "graph": graph, "arm": "approximate"}
        out.append(row)
        if config.backend.routes_exact(solved):
            if solved * (solved + 1) // 2 > MOST_SCALARS:
                row["fallback"] = "will_not_fit"
            else:
                exact.setdefault(solved, []).append(row)
    for solved, rows in exact.items():
        for same in _stacks(rows, solved * solved):
            low, failed, infinite = kernels.cholesky(np.stack([kernels.dense(*r["graph"]) for r in same]))
            for r, own, at, inf in zip(same, low, failed.tolist(), infinite.tolist(), strict=True):
                if at < 0:
                    r["arm"], r["lower"] = "exact", kernels.pack(own)
                else:
                    r["fallback"], r["fallback_vertex"], r["failure"] = "invalid_pivot", int(r["vertices"][at]), kernels.failure_kind(inf).value
    for r in out:
        if r["arm"] == "approximate":
            r["steps"] = kernels.eliminate(*r["graph"], config.seed, int(r["vertices"][0]), config.copies)
            r["uneliminated"] = int(r["vertices"][r["steps"].uneliminated])
    return _as_batch(out)


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _as_batch(rows: list[dict]) -> pa.RecordBatch:
    def joined(parts: list, kind: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *(np.asarray(x, kind) for x in parts)])

    def listed(parts: list, values: pa.Array, sizes: list[int]) -> pa.Array:
        return pa.ListArray.from_arrays(_offsets(sizes), values, mask=pa.array([x is None for x in parts]))

    lower, steps = ([r.get(c) for r in rows] for c in ("lower", "steps"))
    made = [(s, r["vertices"]) for s, r in zip(steps, rows, strict=True) if s is not None]
    inner = _offsets(joined([np.diff(s.ends, prepend=0) for s, _ in made], "i4"))
    step = pa.StructArray.from_arrays(
        [
            pa.array(joined([at[np.asarray(s.pivots, "i8")] for s, at in made], "i8")),
            pa.array(joined([s.inverse for s, _ in made], "f8")),
            pa.ListArray.from_arrays(inner, pa.array(joined([at[np.asarray(s.to, "i8")] for s, at in made], "i8"))),
            pa.ListArray.from_arrays(inner, pa.array(joined([s.share for s, _ in made], "f8"))),
        ],
        ["vertex", "inverse", "to", "share"],
    )
    plain = lambda c, kind: pa.array([r.get(c) for r in rows], kind)
    columns = {
        "block": plain("block", pa.int64()), "dim": plain("dim", pa.int64()), "anchor": plain("anchor", pa.string()), "arm": plain("arm", pa.string()),
        "vertices": pa.ListArray.from_arrays(_offsets([r["dim"] for r in rows]), pa.array(joined([r["vertices"] for r in rows], "i8"))),
        "lower": listed(lower, pa.array(joined([x for x in lower if x is not None], "f8")), [0 if x is None else len(x) for x in lower]),
        "steps": listed(steps, step, [0 if s is None else len(s.pivots) for s in steps]),
        "uneliminated": plain("uneliminated", pa.int64()), "fallback": plain("fallback", pa.string()),
        "fallback_vertex": plain("fallback_vertex", pa.int64()), "failure": plain("failure", pa.string()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def factor_blocks(graph: Graph, config: Config) -> DataFrame:
    """The factor table of a graph, a row per block."""
    n = graph.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch, "vertices", "u"):
                yield _factor_rows(piece, config, n)

    return _gathered(graph).mapInArrow(run, SCHEMA)


def _solve_rows(batch: pa.RecordBatch, canonical: bool) -> Iterator[tuple[str | None, np.ndarray, np.ndarray]]:
    """(system, vertices, values) of each block and system."""
    anchor, arm, left = (batch.column(c).to_pylist() for c in ("anchor", "arm", "uneliminated"))
    vertices_of, lower_of = _lists(batch.column("vertices")), _lists(batch.column("lower"))
    span, step = batch.column("steps").offsets.to_numpy(), batch.column("steps").values
    pivot, inverse = (step.field(c).to_numpy(zero_copy_only=False) for c in ("vertex", "inverse"))
    ends, to, share = step.field("to").offsets.to_numpy(), step.field("to").values.to_numpy(), step.field("share").values.to_numpy()
    asked, right = batch.column("rhs").offsets.to_numpy(), batch.column("rhs").values
    system, at_vertex, value = (right.field(c).to_numpy(zero_copy_only=False) for c in ("system", "vertex", "value"))
    exact: dict[tuple, list] = {}
    for i in range(batch.num_rows):
        vertices, own = vertices_of(i), slice(asked[i], asked[i + 1])
        systems, column = [None], np.zeros(own.stop - own.start, np.int64)
        if len(column) and any(x is not None for x in system[own]):
            systems = list(dict.fromkeys(system[own].tolist()))
            number = {x: k for k, x in enumerate(systems)}
            column = np.array([number[x] for x in system[own]])
        y = np.zeros((len(vertices), len(systems)))
        np.add.at(y, (np.searchsorted(vertices, at_vertex[own]), column), value[own])
        grounded = anchor[i] == "ground"
        y = kernels.prepared(y, grounded)
        if arm[i] == "exact":
            exact.setdefault((len(vertices), y.shape[1]), []).append((i, vertices, systems, y, grounded))
            continue
        a, b = span[i], span[i + 1]
        lo, hi = ends[a], ends[b]
        find = lambda names, among=vertices: np.searchsorted(among, names)
        steps = (find(pivot[a:b]), inverse[a:b], (ends[a + 1 : b + 1] - lo).astype(np.int64), find(to[lo:hi]), share[lo:hi], int(find(left[i])))
        if y.shape[1] == 1 and hi - lo > kernels.WIDE:
            x = kernels.Levels(*steps, len(vertices)).solve(y[:, 0])[:, None]
        else:
            x = kernels.approximate_solve(*steps, y)
        yield from _named(systems, vertices, kernels.recovered(x, grounded, canonical))
    for (dim, width), rows in exact.items():
        for same in _stacks(rows, dim * (dim + width)):
            low = np.stack([kernels.unpack(lower_of(i), dim - 1) for i, *_ in same])
            for (_, vertices, systems, _, grounded), x in zip(same, kernels.exact_solve(low, np.stack([y for *_, y, _ in same])), strict=True):
                yield from _named(systems, vertices, kernels.recovered(x, grounded, canonical))


def _gradient_rows(batch: pa.RecordBatch, tolerance: float, most: int) -> pa.RecordBatch:
    """Conjugate gradients on each block of ``batch``, with its factor as preconditioner."""
    anchor, arm, left = (batch.column(c).to_pylist() for c in ("anchor", "arm", "uneliminated"))
    get = {c: _lists(batch.column(c)) for c in ("vertices", "diagonal", "u", "v", "w", "lower")}
    span, step = batch.column("steps").offsets.to_numpy(), batch.column("steps").values
    pivot, inverse = (step.field(c).to_numpy(zero_copy_only=False) for c in ("vertex", "inverse"))
    ends, to, share = step.field("to").offsets.to_numpy(), step.field("to").values.to_numpy(), step.field("share").values.to_numpy()
    asked, right = batch.column("rhs").offsets.to_numpy(), batch.column("rhs").values
    at_vertex, value = (right.field(c).to_numpy(zero_copy_only=False) for c in ("vertex", "value"))
    out = []
    for i in range(batch.num_rows):
        vertices, grounded = get["vertices"](i), anchor[i] == "ground"
        find = lambda names, among=vertices: np.searchsorted(among, names)
        own = slice(asked[i], asked[i + 1])
        b = np.bincount(find(at_vertex[own]), value[own], len(vertices)) if own.stop > own.start else np.zeros(len(vertices))
        if arm[i] == "exact":
            low = kernels.unpack(get["lower"](i), len(vertices) - 1)[None]
            solve = lambda y, low=low: kernels.exact_solve(low, y[None, :, None])[0, :, 0]
        else:
            x, y = span[i], span[i + 1]
            lo, hi = ends[x], ends[y]
            solve = kernels.Levels(find(pivot[x:y]), inverse[x:y], (ends[x + 1 : y + 1] - lo).astype(np.int64), find(to[lo:hi]), share[lo:hi], int(find(left[i])), len(vertices)).solve
        apply = lambda r, solve=solve, grounded=grounded: kernels.recovered(solve(kernels.prepared(r[:, None], grounded)[:, 0]), grounded)
        out.append(kernels.gradients((get["diagonal"](i), find(get["u"](i)), find(get["v"](i)), get["w"](i)), grounded, apply, b, tolerance, most))
    xs = [x for x, *_ in out]
    flat = pa.ListArray.from_arrays(_offsets([len(x) for x in xs]), pa.array(np.concatenate([np.zeros(0), *xs])))
    plain = [pa.array([r[k] for r in out], kind) for k, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()))]
    return pa.RecordBatch.from_arrays([batch.column("vertices"), flat, *plain], ["vertices", "x", "iterations", "remains", "size"])


def _named(systems: list, vertices: np.ndarray, x: np.ndarray):
    for s, column in zip(systems, x.T, strict=True):
        yield s, vertices, column


@dataclass
class Factor:
    """``blocks``: the factor table. ``original_n``: rows of the matrix; with a ground there is one variable more.

    ``large``: the factor of the blocks that no single task holds, if there are any. ``single``: whether solutions are
    rounded to single precision. ``matrix`` and ``graph``: what was factored, unless the factor was loaded; the graph is
    that of the blocks in ``blocks``.
    """

    blocks: DataFrame
    original_n: int
    config: Config
    large: rounds.RoundFactor | None = None
    single: bool = False
    matrix: Matrix | None = None
    graph: Graph | None = None

    @property
    def spark(self) -> SparkSession:
        return self.blocks.sparkSession

    @property
    def n(self) -> int:
        own = self.blocks.where("anchor = 'ground'").count()
        return self.original_n + own + (self.large.graph.vertices.where(F.col("vertex") == self.original_n).count() if self.large else 0)

    @property
    def shape(self) -> tuple[int, int]:
        return (self.original_n, self.original_n)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(np.float32 if self.single else np.float64)

    @property
    def n_steps(self) -> int:
        return self.blocks.agg(F.coalesce(F.sum(F.col("dim") - 1), F.lit(0))).first()[0] + (self.large.n_steps if self.large else 0)

    def fallbacks(self) -> list[Fallback]:
        rows = self.blocks.where("fallback is not null").select("block", "fallback", "fallback_vertex", "failure", "dim").orderBy("block").collect()
        return [Fallback(r["fallback"], r["fallback_vertex"], DenseFailure(r["failure"]) if r["failure"] else None, r["dim"] if r["fallback"] == "will_not_fit" else None) for r in rows]

    def __repr__(self) -> str:
        return f"Factor(original_n={self.original_n}, seed={self.config.seed}, copies={self.config.copies}, dtype={self.dtype.name})"

    def solve(self, rhs: DataFrame, gauge: str = "canonical") -> DataFrame:
        """``system_id, vertex, value``: solutions for ``rhs`` (vertex, value[, system_id]).

        Absent values are 0. For one system without a name, all vertices are returned; named systems get the blocks
        that their right sides touch, as all others are 0. gauge: ``canonical`` centres floating blocks, ``anchored``
        pins the last vertex of each block at 0.
        """
        found = self._solve(rhs, gauge)
        return found.withColumn("value", F.col("value").cast("float")) if self.single else found

    def _solve(self, rhs: DataFrame, gauge: str) -> DataFrame:
        canonical, n, named = gauge == "canonical", self.original_n, "system_id" in rhs.columns
        system = F.col("system_id").cast("string") if named else F.lit(None).cast("string")
        own = rhs.select(F.col("vertex").cast("long").alias("vertex"), F.col("value").cast("double").alias("value"), system.alias("system"))
        outside = F.max(F.when(~F.col("vertex").between(0, n - 1), F.col("vertex")))
        found = own.agg(outside.alias("outside"), F.approx_count_distinct("system").alias("systems")).first()
        if found["outside"] is not None:
            beyond = found["outside"]
            raise SolveError(f"rhs length {beyond + 1} exceeds original matrix dimension {n}", rhs_len=beyond + 1, factor_dim=n)
        # a block meets the right sides of about SYSTEMS systems in one row
        lots = -(-found["systems"] // SYSTEMS)
        lot = F.pmod(F.xxhash64("system"), F.lit(lots)) if lots > 1 else F.lit(0).cast("long")
        place = self.blocks.select("block", F.explode("vertices").alias("vertex"))
        met = own.join(place, "vertex").groupBy("block", lot.alias("lot")).agg(F.collect_list(F.struct("system", "vertex", "value")).alias("rhs")).drop("lot")
        work = self.blocks.select("block", "anchor", "arm", "vertices", "lower", "steps", "uneliminated").join(met, "block", "inner" if named else "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in _slices(batch, "vertices"):
                    found = list(_solve_rows(piece, canonical))
                    if found:
                        names = pa.array(np.repeat(np.arange(len(found)), [len(v) for _, v, _ in found]))
                        systems = pa.array([s for s, _, _ in found], pa.string()).take(names)
                        yield pa.RecordBatch.from_arrays([systems, pa.array(np.concatenate([v for _, v, _ in found])), pa.array(np.concatenate([x for *_, x in found]))], ["system_id", "vertex", "value"])

        found = work.mapInArrow(run, "system_id string, vertex long, value double").where(F.col("vertex") < n)
        if self.large is None:
            return found
        if named:
            return found.unionByName(self.large.solve_named(own.withColumnRenamed("system", "system_id"), gauge))
        other = self.large.solve(own.select("vertex", "value").join(self.large.graph.vertices.select("vertex"), "vertex", "left_semi"), gauge)
        return found.unionByName(other.select(F.lit(None).cast("string").alias("system_id"), "vertex", "value"))

    solve_named = solve

    def gradients(self, rhs: DataFrame, tolerance: float, most: int) -> DataFrame:
        """``vertices, x, iterations, remains, size`` by block: conjugate gradients for ``rhs`` (vertex, value), each block by itself.

        ``remains`` and ``size`` are the squares of the residual and of the right side.
        """
        own = rhs.select(F.col("vertex").cast("long").alias("vertex"), F.col("value").cast("double").alias("value"))
        met = own.join(self.graph.vertices.select("vertex", "block"), "vertex").groupBy("block").agg(F.collect_list(F.struct("vertex", "value")).alias("rhs"))
        work = _gathered(self.graph).join(self.blocks.select("block", "anchor", "arm", "lower", "steps", "uneliminated"), "block").join(met, "block", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in _slices(batch, "vertices", "u"):
                    yield _gradient_rows(piece, tolerance, most)

        return work.mapInArrow(run, "vertices array<long>, x array<double>, iterations long, remains double, size double")

    def solve_array(self, b, gauge: str = "canonical") -> np.ndarray:
        """The solution for an array of up to ``original_n`` values, on the driver."""
        b = np.asarray(b, np.float64)
        if b.ndim != 1 or len(b) > self.original_n:
            raise SolveError(f"rhs length {len(b)} exceeds original matrix dimension {self.original_n}", rhs_len=len(b), factor_dim=self.original_n)
        table = pa.table({"vertex": np.arange(len(b), dtype=np.int64), "value": b})
        rhs = self.spark.createDataFrame(table) if len(b) else self.spark.createDataFrame([], "vertex long, value double")
        found = self.solve(rhs, gauge).toArrow()
        out = np.zeros(self.original_n, self.dtype)
        if found.num_rows:
            out[found.column("vertex").to_numpy()] = found.column("value").to_numpy()
        return out

    matvec = rmatvec = solve_array

    def solve_into(self, b, out: np.ndarray, gauge: str = "canonical") -> None:
        """Write the solution to ``out``, which must be writeable, long enough and apart from ``b``."""
        if len(out) < self.original_n:
            raise SolveError(f"out length {len(out)} is less than {self.original_n}", out_len=len(out), factor_dim=self.original_n)
        if isinstance(b, np.ndarray) and np.shares_memory(b, out):
            raise SolveError("b and out must not overlap")
        if not out.flags.writeable:
            raise SolveError("out must be writeable")
        out[: self.original_n] = self.solve_array(b, gauge)

    def save(self, path: str) -> None:
        """Write the factor as Parquet tables, with the steps and the graph of blocks eliminated in rounds."""
        large = None
        if self.large is not None:
            self.large.save(f"{path}/large")
            large = {"turns": len(self.large.steps), "grounded": self.large.graph.grounded, "rest": self.large.rest is not None}
        meta = json.dumps({"format_version": FORMAT_VERSION, "original_n": self.original_n, "config": self.config.to_json(), "large": large, "single": self.single})
        self.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        self.spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Factor:
    """A stored factor, checked: its version first, then every block."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
    if meta["format_version"] != FORMAT_VERSION:
        raise FactorError(f"unsupported factor format version {meta['format_version']} (supported: {FORMAT_VERSION})", found=meta["format_version"], supported=FORMAT_VERSION)
    large = rounds.load(spark, f"{path}/large", meta["large"]["turns"], meta["original_n"], meta["large"]["grounded"], SCHEMA if meta["large"].get("rest") else None) if meta.get("large") else None
    factor = Factor(spark.read.schema(SCHEMA).parquet(f"{path}/blocks"), meta["original_n"], Config.from_json(meta["config"]), large, meta.get("single", False))
    check(factor)
    return factor


def check(factor: Factor) -> None:
    """Raise the first fault of the factor's tables."""
    fault = faults(factor.blocks).orderBy("block", "kind").first()
    if fault is not None:
        raise FactorError(f"block {fault['block']}: {fault['kind']}", block=fault["block"], kind=fault["kind"])
    if factor.large is not None and (kind := factor.large.fault()):
        raise FactorError(f"blocks eliminated in rounds: {kind}", kind=kind)
    vertices = factor.blocks.select(F.explode("vertices").alias("v"))
    grounded = factor.blocks.where("anchor = 'ground'").count()
    if factor.large is not None:
        own = factor.large.graph.vertices.select(F.col("vertex").alias("v"))
        grounded, vertices = grounded + own.where(F.col("v") == factor.original_n).count(), vertices.unionByName(own)
    if grounded > 1:
        raise FactorError(f"{grounded} ground blocks", grounded=grounded)
    # distinct vertices are counted as bits, which are joined before the shuffle
    part = vertices.groupBy(F.bitmap_bucket_number("v").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("v"))).alias("d"), F.max("v").alias("most"), F.min("v").alias("least"))
    spread = part.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("d"), F.lit(0)), F.max("most"), F.min("least")).first()
    if spread[0] != spread[1] or spread[0] != factor.original_n + grounded or (spread[0] and (spread[2] != spread[0] - 1 or spread[3] != 0)):
        raise FactorError("vertices are no permutation of the matrix's rows")


def faults(blocks: DataFrame) -> DataFrame:
    """``block, kind`` of every broken rule of a single block."""
    real = lambda x: ~(F.isnan(x) | (F.abs(x) == float("inf")))
    m = F.col("dim") - 1
    exact, pivots = F.col("arm") == "exact", F.transform("steps", lambda s: s["vertex"])
    inside = lambda v: F.array_contains("vertices", v)
    # by a hash of the vertices, as a search for each end takes the square of a block's size
    strays = lambda found: F.size(F.array_except(found, "vertices")) > 0
    ends = F.flatten(F.transform("steps", lambda s: s["to"]))
    diagonal = F.transform(F.sequence(F.lit(1), F.greatest(m.cast("int"), F.lit(1))), lambda i: F.element_at("lower", (i * (i + 1) / 2).cast("int")))
    rules = {
        "dimension": F.size("vertices") != F.col("dim"),
        "order of vertices": F.array_sort("vertices") != F.col("vertices"),
        "length of the triangle": exact & (F.size("lower") != m * (m + 1) / 2),
        "a value of the triangle": exact & F.exists("lower", lambda x: ~real(x)),
        "a pivot of the triangle": exact & (m > 0) & (F.size("lower") == m * (m + 1) / 2) & F.exists(diagonal, lambda x: ~(x > 0)),
        "number of steps": ~exact & (F.size("steps") != m),
        "a vertex out of bounds": ~exact & (strays(pivots) | strays(ends)),
        "a vertex eliminated twice": ~exact & (F.size(F.array_distinct(pivots)) != F.size(pivots)),
        "a value of a step": ~exact & F.exists("steps", lambda s: ~real(s["inverse"]) | (F.size(s["to"]) != F.size(s["share"])) | F.exists(s["share"], lambda x: ~((x >= 0) & (x <= 1)))),
        "the uneliminated vertex": ~exact & (F.col("uneliminated").isNull() | ~inside(F.col("uneliminated")) | F.array_contains(pivots, F.col("uneliminated"))),
    }
    kinds = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(kind)) for kind, rule in rules.items()]), lambda k: k.isNotNull())
    return blocks.select("block", F.explode(kinds).alias("kind"))


def _part(graph: Graph, blocks: DataFrame) -> Graph:
    """The part of a graph that lies in some blocks."""
    own = lambda df: materialize(df.join(blocks, "block", "left_semi"))
    return Graph(own(graph.vertices), own(graph.edges), graph.n, graph.grounded)


def factorize(source, config: Config | None = None, spark: SparkSession | None = None, checked: bool = True, local: int = LOCAL) -> Factor:
    """The factor of a Matrix, or of anything ``from_any`` reads (then a session is needed).

    Blocks of more than ``local`` vertices and edges are eliminated in rounds, whatever arm the configuration names, until no
    more than ``local`` edges are left of them.
    """
    config = config or Config()
    matrix = source if isinstance(source, Matrix) else from_any(spark or SparkSession.getActiveSession(), source)
    graph, large = ingest(matrix, checked), None
    if graph.n + graph.edges.count() > local:
        dims, edges = (df.groupBy("block").count() for df in (graph.vertices, graph.edges))
        held = F.col("count") + F.coalesce(F.col("edges"), F.lit(0))
        sizes = materialize(dims.join(edges.toDF("block", "edges"), "block", "left").select("block", (held > local).alias("large")))
        if not (big := materialize(sizes.where("large").select("block"))).isEmpty():
            finish = lambda g: materialize(factor_blocks(g, Config(config.seed, config.split, Backend.approximate())))
            large = rounds.eliminate(_part(graph, big), config.seed, config.copies, finish=finish, left=local)
            graph = _part(graph, sizes.where("not large").select("block"))
    blocks = materialize(factor_blocks(graph, config))
    factor = Factor(blocks, matrix.n, config, large, matrix.single, matrix, graph)
    found = factor.fallbacks() if config.backend.max_dim else []
    broken = [f for f in found if f.kind == "invalid_pivot"]
    if broken and config.backend.on_failure is ExactFailure.ERROR:
        raise DenseFactorizationFailed(broken[0].vertex, broken[0].failure)
    if found:
        warnings.warn(f"{len(found)} block(s) routed to exact Cholesky were factored approximately", RuntimeWarning, stacklevel=2)
    return factor


def factorize_raw(spark: SparkSession, row_ptrs, col_indices, values, n: int, config: Config | None = None) -> Factor:
    """The factor of a matrix given as CSR arrays; numpy arrays must be contiguous."""
    for name, given in (("row_ptrs", row_ptrs), ("col_indices", col_indices), ("values", values)):
        if isinstance(given, np.ndarray) and given.ndim == 1 and not given.flags.c_contiguous:
            raise CsrError(f"{name} must be contiguous", name=name)
    return factorize(from_csr(spark, row_ptrs, col_indices, values, n), config)
