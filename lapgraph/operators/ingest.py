"""From entries to a validated graph: duplicates summed, mirrors compared, rows balanced, surplus grounded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapgraph.model import EPS, EPS_SINGLE, Asymmetric, NonFiniteRow, NonFiniteValue, NotDiagonallyDominant, PositiveOffDiagonal
from lapgraph.operators.components import placed, with_pieces
from lapgraph.sources.matrix import Matrix
from lapgraph.storage import materialize, release


def finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == float("inf")))


def ordered_sum(order: Column, value: Column) -> Column:
    """An aggregate: the sum of ``value`` in the order of ``order``, one addition after the other."""
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.aggregate(listed, F.lit(0.0), lambda a, x: a + x["v"])


def is_canonical(entries: DataFrame) -> bool:
    """Whether columns ascend strictly in every row, in the stored order."""
    from pyspark.sql import Window

    along = Window.partitionBy("row").orderBy("pos")
    return entries.select((F.lag("col").over(along) >= F.col("col")).alias("falls")).where("falls").isEmpty()


def coalesce(matrix: Matrix) -> DataFrame:
    """``row, col, value, pos, stored``: duplicates summed; pos is the first, stored how many."""
    total = ordered_sum(F.col("pos"), F.col("value")) if matrix.ordered else F.sum("value")
    return matrix.entries.groupBy("row", "col").agg(matrix.rounded(total).alias("value"), F.min("pos").alias("pos"), F.count(F.lit(1)).alias("stored"))


def mirrors(cells: DataFrame) -> DataFrame:
    """``row, col, upper, lower`` with row < col, of every pair with a cell other than zero; absent cells are 0.

    One aggregation by unordered pair does what a join of the matrix with its transpose would.
    """
    off = cells.where("row != col")
    side = lambda own: F.coalesce(F.max(F.when(own, F.col("value"))), F.lit(0.0))
    pairs = off.groupBy(F.least("row", "col").alias("lo"), F.greatest("row", "col").alias("hi")).agg(
        side(F.col("row") < F.col("col")).alias("upper"), side(F.col("row") > F.col("col")).alias("lower")
    )
    return pairs.where("upper != 0 or lower != 0").select(F.col("lo").alias("row"), F.col("hi").alias("col"), "upper", "lower")


def violations(pairs: DataFrame, eps: float = EPS) -> DataFrame:
    """``row, col, kind`` of pairs that are unequal (asymmetric) or above zero (positive)."""
    close = F.abs(F.col("upper") - F.col("lower")) <= 8 * eps * F.greatest(F.abs("upper"), F.abs("lower"))
    kind = F.when(~finite(F.col("upper")) | ~finite(F.col("lower")), "non_finite").when(~close, "asymmetric").when(F.col("upper") > 0, "positive")
    return pairs.withColumn("kind", kind).where("kind is not null").select("row", "col", "upper", "lower", "kind")


def balances(cells: DataFrame, terms: DataFrame, ordered: bool = True, single: bool = False) -> DataFrame:
    """``row, diagonal, excess, class, surplus`` of every row of ``terms`` (row, terms).

    class: non_finite, deficit, negligible or surplus, by an excess of a few roundings of the row's own size.
    """
    off = ordered_sum(F.col("col"), F.col("value")) if ordered else F.sum("value")
    diagonal = cells.where("row = col").select("row", F.col("value").alias("diagonal"))
    sums = cells.where("row != col").groupBy("row").agg(off.alias("off"))
    rows = terms.join(diagonal, "row", "left").join(sums, "row", "left").fillna(0.0, ["diagonal", "off"])
    rows = rows.withColumn("excess", F.col("diagonal") + F.col("off"))
    rows = rows.withColumn("scale", (F.abs("diagonal") - F.col("excess")) + F.col("diagonal")).withColumn("tolerance", (EPS_SINGLE if single else EPS) * F.col("scale") * F.col("terms"))
    kind = (
        F.when(~finite(F.col("scale").cast("float") if single else F.col("scale")), "non_finite")
        .when(F.col("excess") < -F.col("tolerance"), "deficit")
        .when(F.col("excess") <= F.col("tolerance"), "negligible")
        .otherwise("surplus")
    )
    rows = rows.withColumn("class", kind)
    return rows.select("row", "diagonal", "excess", "class", F.when(F.col("class") == "surplus", F.col("excess")).otherwise(0.0).alias("surplus"))


#: Ranges of blocks in which their places are summed.
RANGES = 4096


@dataclass(frozen=True)
class Graph:
    """``vertices`` (vertex, diagonal, block), ``edges`` (u, v, w, block) with u < v; a block is named by its least vertex.

    ``n`` vertices come from the matrix; vertex n, if ``grounded``, is the ground.
    """

    vertices: DataFrame
    edges: DataFrame
    n: int
    grounded: bool

    def layout(self) -> DataFrame:
        """``vertex, block, local, position``: places in a block and in the order by blocks."""
        from pyspark.sql import Window

        local = F.row_number().over(Window.partitionBy("block").orderBy("vertex")) - 1
        sizes = materialize(self.vertices.groupBy("block").count().withColumn("range", F.floor(F.col("block") * F.lit(RANGES) / F.lit(self.n + 1)).cast("int")))
        totals = sizes.groupBy("range").agg(F.sum("count").alias("total"))
        upto = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # RANGES rows at most
        offsets = totals.select("range", (F.sum("total").over(upto) - F.col("total")).alias("offset"))
        within = Window.partitionBy("range").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
        placed = sizes.withColumn("before", F.sum("count").over(within) - F.col("count")).join(F.broadcast(offsets), "range")
        starts = placed.select("block", (F.col("offset") + F.col("before")).alias("start"))
        return self.vertices.select("vertex", "block", local.alias("local")).join(starts, "block").select("vertex", "block", "local", (F.col("start") + F.col("local")).alias("position"))

    def blocks(self) -> DataFrame:
        """``block, dim, solved, anchor``."""
        anchor = F.when(F.max("vertex") == self.n, "ground").otherwise("floating")
        return self.vertices.groupBy("block").agg(F.count(F.lit(1)).alias("dim"), anchor.alias("anchor")).select("block", "dim", (F.col("dim") - 1).alias("solved"), "anchor")


def ground(balance: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Edges of the ground (u, v, w) and its vertex row (vertex, diagonal); both empty without surplus."""
    rows = balance.where("surplus > 0")
    edges = rows.select(F.col("row").alias("u"), F.lit(n).cast("long").alias("v"), F.col("surplus").alias("w"))
    total = rows.agg(F.sum("surplus").alias("diagonal")).where("diagonal is not null")
    return edges, total.select(F.lit(n).cast("long").alias("vertex"), "diagonal")


def _raise_non_finite(matrix: Matrix) -> None:
    first = matrix.entries.where(~finite(F.col("value"))).agg(F.min("pos")).first()[0]
    if first is not None:
        raise NonFiniteValue(matrix.place(first))


def _raise_first(bad: DataFrame, pairs: DataFrame, cells: DataFrame, matrix: Matrix) -> None:
    """Raise the violation that a walk over the rows meets first."""
    # a lower entry without its mirror is met when the next upper entry of its row's column is claimed, or at its row
    lone = bad.where("upper = 0").select(F.col("row").alias("lo"), F.col("col").alias("hi"))
    claims = pairs.where("upper != 0").select(F.col("row").alias("claim"), F.col("col").alias("hi"))
    met = lone.join(claims, "hi").where("claim > lo").groupBy("lo", "hi").agg(F.min("claim").alias("claim"))
    lone = lone.join(met, ["lo", "hi"], "left").select(F.coalesce("claim", "hi").alias("at"), F.when(F.col("claim").isNull(), 0).otherwise(1).alias("phase"), F.col("hi").alias("c"), F.col("lo").alias("r"), F.col("hi").alias("s"), F.lit("asymmetric").alias("kind"))
    others = bad.where("upper != 0").select(F.col("row").alias("at"), F.lit(1).alias("phase"), F.col("col").alias("c"), F.col("row").alias("r"), F.col("col").alias("s"), "kind")
    first = lone.unionByName(others).orderBy("at", "phase", "c", "r").first()
    if first is None:
        return
    if first["kind"] == "non_finite":
        own = cells.where(((F.col("row") == first["r"]) & (F.col("col") == first["s"])) | ((F.col("row") == first["s"]) & (F.col("col") == first["r"])))
        raise NonFiniteValue(matrix.place(own.where(~finite(F.col("value"))).agg(F.min("pos")).first()[0]))
    raise (PositiveOffDiagonal if first["kind"] == "positive" else Asymmetric)(first["r"], first["s"])


def ingest(matrix: Matrix, checked: bool = True) -> Graph:
    """The validated graph of ``matrix``; ``checked=False`` trusts it to be symmetric, finite and dominant.

    A Laplacian that is given by its edges is symmetric and balanced as it stands; only its sums can fail to be finite.
    """
    n = matrix.n
    if matrix.edges is not None:
        vertices, edges = _in_blocks(matrix.edges.where("u != v and w > 0"), matrix.vertices)
        if vertices.where(~finite(F.col("diagonal"))).isEmpty():
            return Graph(vertices, edges, n, False)
    cells = materialize(coalesce(matrix))
    pairs = materialize(mirrors(cells))
    stored = cells.groupBy("row").agg(F.sum("stored").alias("terms"))
    terms = matrix.vertices.withColumnRenamed("vertex", "row").join(stored, "row", "left").fillna(0, ["terms"])
    balance = materialize(balances(cells, terms, matrix.ordered, matrix.single))
    if checked:
        if not cells.where(~finite(F.col("value"))).isEmpty():
            if not is_canonical(matrix.entries):
                _raise_non_finite(matrix)
                over = cells.where(~finite(F.col("value"))).agg(F.min("row")).first()[0]
                raise NonFiniteRow(over)
            diagonal = cells.where(~finite(F.col("value")) & (F.col("row") == F.col("col"))).agg(F.min("pos")).first()[0]
            bad = violations(pairs, matrix.eps)
            if diagonal is not None and bad.isEmpty():
                raise NonFiniteValue(matrix.place(diagonal))
            if bad.isEmpty():
                _raise_non_finite(matrix)
        bad = violations(pairs, matrix.eps)
        if not bad.isEmpty():
            _raise_first(materialize(bad), pairs, cells, matrix)
        worst = balance.where("class in ('non_finite', 'deficit')").agg(F.min(F.struct("row", "class"))).first()[0]
        if worst is not None:
            raise (NonFiniteRow if worst["class"] == "non_finite" else NotDiagonallyDominant)(worst["row"])
    to_ground, ground_row = ground(balance, n)
    edges = pairs.where("upper != 0").select(F.col("row").alias("u"), F.col("col").alias("v"), (-F.col("upper")).alias("w")).unionByName(to_ground)
    diagonals = balance.select(F.col("row").alias("vertex"), "diagonal").unionByName(ground_row)
    vertices, edges = _in_blocks(edges, diagonals.select("vertex"), diagonals)
    grounded = not to_ground.isEmpty()
    release(cells, pairs, balance)
    return Graph(vertices, edges, n, grounded)


def _in_blocks(edges: DataFrame, every: DataFrame, diagonals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``vertex, diagonal, block`` of ``every`` vertex, and ``u, v, w, block`` with u < v, parallel edges merged.

    Without ``diagonals`` (vertex, diagonal) they are the sums of the edges' weights. Edges know the piece that their
    task joined them to, so that no join by vertex is needed to find their blocks.
    """
    pieces = materialize(with_pieces(edges))
    ends = pieces.select(F.explode(F.array("u", "v")).alias("vertex"), "piece", "w")
    ends = ends.unionByName(every.select("vertex", F.lit(None).cast("long").alias("piece"), F.lit(0.0).alias("w")))
    own = materialize(ends.groupBy("vertex").agg(F.sum("w").alias("diagonal"), F.min("piece").alias("piece"), F.max("piece").alias("last")))
    moved = placed(pieces, own)
    merged = pieces.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("w").alias("w"), F.min("piece").alias("piece"))
    block = F.coalesce("piece", "vertex")
    if moved is not None:
        own, merged = (df.join(moved, "piece", "left").withColumn("piece", F.coalesce("component", "piece")) for df in (own, merged))
    own = own.select("vertex", "diagonal", block.alias("block"))
    vertices = materialize(own if diagonals is None else own.select("vertex", "block").join(diagonals, "vertex").select("vertex", "diagonal", "block"))
    merged = materialize(merged.select("u", "v", "w", F.col("piece").alias("block")))
    release(pieces, *([moved] if moved is not None else []))
    return vertices, merged
