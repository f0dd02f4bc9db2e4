"""Matrices as DataFrames of entries, from arrays, CSR-like objects, DataFrames and Parquet."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapgraph.model import EPS, EPS_SINGLE, U32_MAX, CsrError
from lapgraph.storage import materialize

SCHEMA = "row long, col long, pos long, value double"


@dataclass(frozen=True)
class Matrix:
    """``entries`` (row, col, pos, value) of a square matrix of ``n`` rows.

    ``pos`` numbers the stored entries; it orders sums of duplicates and names places in errors. ``ordered``: whether sums
    follow the stored order to the last bit, which gathers the entries of a row in one task; without it they are plain
    sums, combined before the shuffle, which is what a table with hub rows wants.

    ``single``: values, and sums of duplicates, are rounded to single precision, rows are judged by its roundings, and
    solutions are single; what lies between is reckoned in double precision. ``numbered``: whether ``pos`` are places;
    otherwise it only sorts by row and column, and errors count the entries before the one they name.

    ``edges``: of a Laplacian without a shift, the weighted edges (u, v, w) that the entries stand for, all in bounds and
    with finite weights of 0 or more; its graph is made from them.
    """

    entries: DataFrame
    n: int
    ordered: bool = True
    single: bool = False
    numbered: bool = True
    edges: DataFrame | None = None

    @property
    def eps(self) -> float:
        return EPS_SINGLE if self.single else EPS

    def rounded(self, x: Column) -> Column:
        return x.cast("float").cast("double") if self.single else x

    def place(self, pos: int | None) -> int | None:
        """The place of the entry with ``pos`` among the stored ones."""
        return pos if self.numbered or pos is None else self.entries.where(F.col("pos") < pos).count()

    @property
    def vertices(self) -> DataFrame:
        return self.entries.sparkSession.range(self.n).select(F.col("id").alias("vertex"))

    def nnz(self) -> int:
        return self.entries.count()


def _column(values: Any, name: str, kinds: str, wanted: str) -> np.ndarray:
    found = np.asarray(values)
    if found.ndim != 1:
        raise CsrError(f"{name} must be a 1-D array", name=name)
    if found.dtype.kind not in kinds:
        raise CsrError(f"{name} must have {wanted} dtype", name=name)
    return found


def _indices(values: Any, name: str) -> np.ndarray:
    found = _column(values, name, "iu", "an integer")
    if found.size and int(found.min()) < 0:
        raise CsrError(f"{name} must be non-negative", name=name)
    if found.size and int(found.max()) > U32_MAX:
        raise CsrError(f"{name} exceeds u32::MAX", name=name)
    return found.astype(np.int64)


def from_csr(spark: SparkSession, row_ptrs: Any, col_indices: Any, values: Any, n: int, single: bool = False) -> Matrix:
    """A matrix from CSR arrays; the first structural fault is raised."""
    return _checked(spark, _indices(row_ptrs, "row_ptrs"), _indices(col_indices, "col_indices"), _values(values, "values", single), n, single)


def _values(values: Any, name: str, single: bool) -> np.ndarray:
    found = _column(values, name, "iuf", "an integer or floating-point")
    with np.errstate(over="ignore"):
        return (found.astype(np.float32) if single else found).astype(np.float64)


def _checked(spark: SparkSession, ptrs: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int, single: bool) -> Matrix:
    if not 0 <= n <= U32_MAX:
        raise CsrError("matrix dimension exceeds u32::MAX", n=n)
    if len(ptrs) != n + 1:
        raise CsrError(f"row_ptrs length != n + 1 (expected {n + 1}, got {len(ptrs)})", expected=n + 1, got=len(ptrs))
    if len(cols) != len(vals):
        raise CsrError(f"col_indices and values have different lengths ({len(cols)} != {len(vals)})", col_indices=len(cols), values=len(vals))
    if ptrs[0] != 0:
        raise CsrError(f"row_ptrs[0] must be 0 (got {ptrs[0]})", got=int(ptrs[0]))
    if ptrs[-1] != len(cols):
        raise CsrError(f"row_ptrs[n] must equal nnz ({ptrs[-1]} != {len(cols)})", end=int(ptrs[-1]), nnz=len(cols))
    falls = np.flatnonzero(np.diff(ptrs) < 0)
    if len(falls):
        r = int(falls[0])
        raise CsrError(f"row_ptrs is not non-decreasing at row {r}: {ptrs[r]} > {ptrs[r + 1]}", row=r)
    outside = np.flatnonzero(cols >= n)
    if len(outside):
        p = int(outside[0])
        raise CsrError(f"column index out of bounds at position {p}: {cols[p]} >= {n}", position=p, col=int(cols[p]), n=n)
    rows = np.repeat(np.arange(n, dtype=np.int64), np.diff(ptrs))
    table = pa.table({"row": rows, "col": cols, "pos": np.arange(len(cols), dtype=np.int64), "value": vals})
    return Matrix(spark.createDataFrame(table, SCHEMA) if len(cols) else spark.createDataFrame([], SCHEMA), n, single=single)


def from_csr_like(spark: SparkSession, matrix: Any, single: bool = False) -> Matrix:
    """A matrix from an object with ``indptr, indices, data, shape``, as scipy's CSR classes have."""
    if getattr(matrix, "format", "csr") != "csr":
        raise CsrError(f"expected CSR matrix, got {matrix.format.upper()}")
    rows, cols = matrix.shape
    if rows != cols:
        raise CsrError(f"expected square matrix (got {rows}x{cols})", rows=rows, cols=cols)
    if rows > U32_MAX:
        raise CsrError("matrix dimension exceeds u32::MAX", n=rows)
    return _checked(spark, _indices(matrix.indptr, "indptr"), _indices(matrix.indices, "indices"), _values(matrix.data, "data", single), rows, single)


def from_any(spark: SparkSession, source: Any) -> Matrix:
    """A matrix from a Matrix, a CSR-like object, or whatever has ``to_matrix(spark)``; its failures become CsrError."""
    if isinstance(source, Matrix):
        return source
    if hasattr(source, "to_matrix"):
        try:
            return source.to_matrix(spark)
        except CsrError:
            raise
        except Exception as e:
            raise CsrError("input conversion panicked") from e
    return from_csr_like(spark, source)


def _placed(entries: DataFrame, single: bool = False) -> DataFrame:
    """``row, col, pos, value`` of entries (row, col, value[, pos])."""
    value = F.col("value").cast("float").cast("double") if single else F.col("value").cast("double")
    names = [F.col(c).cast("long").alias(c) for c in ("row", "col")]
    pos = F.col("pos").cast("long") if "pos" in entries.columns else F.shiftleft(F.col("row").cast("long") - 2**31, 32) + F.col("col").cast("long")
    return entries.select(*names, pos.alias("pos"), value.alias("value"))


def from_entries(entries: DataFrame, n: int, ordered: bool = False, single: bool = False) -> Matrix:
    """A matrix from rows (row, col, value[, pos]); indices outside 0..n-1 are raised, the first by position.

    Without ``pos`` entries count as stored by row and column.
    """
    numbered = "pos" in entries.columns
    entries = _placed(entries, single)
    bad = entries.where(~(F.col("row").between(0, n - 1) & F.col("col").between(0, n - 1)) | F.col("row").isNull() | F.col("col").isNull())
    place = F.struct("pos" if numbered else "row", "col")
    first = bad.agg(F.min(F.struct(place.alias("place"), "col", "pos")), F.count(F.lit(1))).first()
    if first[1]:
        found = first[0]
        at = found["pos"] if numbered else entries.where(place < F.struct(*[F.lit(x).cast("long") for x in found["place"]])).count()
        raise CsrError(f"column index out of bounds at position {at}: {found['col']} >= {n}", position=at, col=found["col"], n=n)
    return Matrix(entries, n, ordered, single, numbered)


def from_edges(edges: DataFrame, n: int, shift: DataFrame | None = None, single: bool = False) -> Matrix:
    """The Laplacian of weighted edges (u, v, w), plus a diagonal ``shift`` (vertex, value) if given.

    The edges are written once, in the order they come in.
    """
    off = materialize(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("w")))
    entries = off.select(F.col("u").alias("row"), F.col("v").alias("col"), (-F.col("w")).alias("value"))
    entries = entries.unionByName(off.select(F.col("v").alias("row"), F.col("u").alias("col"), (-F.col("w")).alias("value")))
    ends = off.select(F.explode(F.array("u", "v")).alias("row"), "w").groupBy("row").agg(F.sum("w").alias("value"))
    entries = entries.unionByName(ends.select("row", F.col("row").alias("col"), "value"))
    if shift is None and not single:
        inside = F.col("u").between(0, n - 1) & F.col("v").between(0, n - 1)
        sound = inside & (F.col("w") >= 0) & (F.col("w") < float("inf"))
        if off.where(~F.coalesce(sound, F.lit(False))).isEmpty():
            return Matrix(_placed(entries), n, False, numbered=False, edges=off)
    if shift is not None:
        entries = entries.unionByName(shift.select(F.col("vertex").alias("row"), F.col("vertex").alias("col"), "value"))
    return from_entries(entries, n, single=single)


def read_parquet(spark: SparkSession, path: str, n: int, ordered: bool = False, single: bool = False) -> Matrix:
    """A matrix from a Parquet table of entries (row, col, value[, pos])."""
    return from_entries(spark.read.parquet(path), n, ordered, single)


def rows(matrix: Matrix) -> DataFrame:
    """``row, cols, values`` of every row in the stored order, empty rows too; a row is gathered in one task."""
    own = matrix.entries.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "col", "value"))).alias("own"))
    every = matrix.vertices.withColumnRenamed("vertex", "row").join(own, "row", "left")
    part = lambda c, kind: F.coalesce(F.transform("own", lambda x: x[c]), F.array().cast(f"array<{kind}>"))
    return every.select("row", part("col", "long").alias("cols"), part("value", "double").alias("values"))


def to_csr(matrix: Matrix, index: Any = np.int64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR arrays of a matrix that fits the driver, with indices of the type ``index``, which must hold them all."""
    kind = np.dtype(index)
    found = matrix.entries.orderBy("row", "pos").toArrow()
    if (most := max(matrix.n, found.num_rows)) > np.iinfo(kind).max:
        raise CsrError(f"{most} does not fit {kind.name} indices", most=most)
    row = found.column("row").to_numpy() if found.num_rows else np.zeros(0, np.int64)
    ptrs = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=matrix.n))])
    get = lambda c, t: (found.column(c).to_numpy() if found.num_rows else np.zeros(0)).astype(t)
    return ptrs.astype(kind), get("col", kind), get("value", np.float32 if matrix.single else np.float64)
