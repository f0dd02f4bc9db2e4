"""Literal matrices, rejections, thresholds, persistence and properties."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapgraph.model import (
    EPS,
    Asymmetric,
    Backend,
    Config,
    CsrError,
    DenseFactorizationFailed,
    DenseFailure,
    ExactFailure,
    FactorError,
    Fallback,
    NonFiniteRow,
    NonFiniteValue,
    NotDiagonallyDominant,
    PositiveOffDiagonal,
    SolveError,
)
from lapgraph.operators import ingest as ing
from lapgraph.operators import kernels, pcg, rounds, sampling, vectors
from lapgraph.operators.components import connected_components
from lapgraph.operators.factor import check, FORMAT_VERSION, factorize, factorize_raw, faults, load
from lapgraph.sources import generators
from lapgraph.sources.matrix import Matrix, from_any, from_csr, from_csr_like, from_edges, from_entries, rows, to_csr

APPROX = Config(backend=Backend.approximate())
BIG = np.finfo(float).max


def _dense(matrix):
    ptr, col, val = to_csr(matrix)
    a = np.zeros((matrix.n, matrix.n))
    for r in range(matrix.n):
        for i in range(ptr[r], ptr[r + 1]):
            a[r, col[i]] += val[i]
    return a


@pytest.mark.parametrize(
    ("arrays", "error", "fields"),
    [
        (([0, 2, 4], [0, 1, 0, 1], [5, 1, 1, 4]), PositiveOffDiagonal, {"row": 0, "col": 1}),
        (([0, 2, 3], [0, 1, 1], [1, -1, 1]), Asymmetric, {"row": 0, "col": 1}),
        (([0, 1, 3], [0, 0, 1], [1, -1, 1]), Asymmetric, {"row": 0, "col": 1}),
        (([0, 2, 4], [0, 1, 0, 1], [1, -1, -2, 2]), Asymmetric, {"row": 0, "col": 1}),
        (([0, 2, 4], [0, 1, 0, 1], [1, -3, -3, 1]), NotDiagonallyDominant, {"row": 0}),
        (([0, 1], [0], [math.nan]), NonFiniteValue, {"position": 0}),
        (([0, 2, 5, 7], [1, 0, 2, 1, 0, 2, 1], [-1, 1, -1, 2, math.nan, 1, -1]), NonFiniteValue, {"position": 4}),
        (([0, 3, 6], [0, 1, 1, 0, 0, 1], [BIG, -BIG, -BIG, -BIG, -BIG, BIG]), NonFiniteRow, {"row": 0}),
        (([0, 3, 5, 7], [0, 1, 2, 0, 1, 0, 2], [0, -BIG, -BIG, -BIG, BIG, -BIG, BIG]), NonFiniteRow, {"row": 0}),
        (([0, 2], [0, 0], [BIG, BIG]), NonFiniteRow, {"row": 0}),
    ],
)
def test_rejections(spark, arrays, error, fields):
    with pytest.raises(error) as e:
        ing.ingest(from_csr(spark, *arrays, len(arrays[0]) - 1))
    assert e.value.fields == fields


@pytest.mark.parametrize(
    ("arrays", "n", "text"),
    [
        (([0, 2], [0, 1, 0, 1], [1.0] * 4), 2, "row_ptrs length"),
        (([0, 2, 4], [0, 1, 0], [1.0] * 4), 2, "different lengths"),
        (([1, 2, 4], [0, 1, 0, 1], [1.0] * 4), 2, "must be 0"),
        (([0, 2, 3], [0, 1, 0, 1], [1.0] * 4), 2, "must equal nnz"),
        (([0, 5, 4], [0, 1, 0, 1], [1.0] * 4), 2, "not non-decreasing at row 1"),
        (([0, 2, 4], [0, 1, 0, 7], [1.0] * 4), 2, "out of bounds at position 3"),
        (([0, 2, 4], [0, -1, 0, 1], [1.0] * 4), 2, "col_indices must be non-negative"),
        (([0, 2, 4], [0, 2**32 + 1, 0, 1], [1.0] * 4), 2, "col_indices exceeds u32::MAX"),
        (([0.0, 2.0, 4.0], [0, 1, 0, 1], [1.0] * 4), 2, "row_ptrs must have an integer dtype"),
        (([0, 2, 4], [0, 1, 0, 1], [1j] * 4), 2, "values must have an integer or floating-point dtype"),
        (([0, 2, 4], [[0, 1], [0, 1]], [1.0] * 4), 2, "col_indices must be a 1-D array"),
    ],
)
def test_structure(spark, arrays, n, text):
    with pytest.raises(CsrError, match=text):
        from_csr(spark, *arrays, n)


class _Like:
    def __init__(self, shape, **more):
        self.indptr, self.indices, self.data, self.shape = np.array([0, 2, 4]), np.array([0, 1, 0, 1]), np.array([2.0, -1, -1, 2]), shape
        self.__dict__.update(more)


def test_adapters(spark):
    assert from_csr_like(spark, _Like((2, 2))).nnz() == 4
    with pytest.raises(CsrError, match="got CSC"):
        from_csr_like(spark, _Like((2, 2), format="csc"))
    with pytest.raises(CsrError, match="square"):
        from_csr_like(spark, _Like((2, 3)))
    with pytest.raises(CsrError, match="exceeds u32::MAX"):
        from_csr_like(spark, _Like((2**32 + 1, 2**32 + 1)))

    class Broken:
        def to_matrix(self, spark):
            raise RuntimeError

    with pytest.raises(CsrError, match="conversion"):
        from_any(spark, Broken())
    with pytest.raises(CsrError, match="out of bounds"):
        from_entries(spark.createDataFrame([(0, 5, 1.0)], "row long, col long, value double"), 2)


@pytest.mark.parametrize(
    ("rows", "grounded"),
    [
        ([[1e-6 + 6e-18, -1e-6], [-1e-6, 1e-6 + 6e-18]], True),
        ([[1e-6 + 6e-22, -1e-6], [-1e-6, 1e-6 + 6e-22]], False),
        ([[1 + EPS, -1], [-1, 1 + EPS]], False),
        ([[1 - EPS, -1], [-1, 1 - EPS]], False),
        ([[1 + 5e-11, -1], [-1, 1 + 5e-11]], True),
    ],
)
def test_what_counts_as_surplus(spark, rows, grounded):
    n = len(rows)
    m = from_csr(spark, list(range(0, n * n + 1, n)), list(range(n)) * n, [x for r in rows for x in r], n)
    assert ing.ingest(m).grounded is grounded


@pytest.mark.parametrize(
    ("arrays", "b", "x"),
    [
        (([0, 2, 4, 6, 8], [0, 2, 1, 3, 0, 2, 1, 3], [1, -1, 1, -1, -1, 1, -1, 1]), [3, 5, -1, -2], [1, 1.75, -1, -1.75]),
        (([0, 1, 3, 5], [0, 1, 2, 1, 2], [2, 1, -1, -1, 1]), [4, 1, -1], [2, 0.5, -0.5]),
        (([0, 1, 2, 3], [0, 1, 2], [2, 3, 5]), [1, -2, 4], [0.5, -2 / 3, 0.8]),
        (([0, 4, 7, 9], [1, 0, 1, 0, 2, 0, 1, 2, 1], [-0.5, 0.25, -0.5, 0.75, -1, -1, 2, 1, -1]), [1, 0, -1], [1, 0, -1]),
        (([0], [], []), [], []),
        (([0, 1], [0], [0.0]), [7], [0]),
        (([0, 1], [0], [2.0]), [7], [3.5]),
        (([0, 1], [0], [BIG]), [BIG], [1]),
        ((list([0] * 9), [], []), [1] * 8, [0] * 8),
        (([0, 2, 5, 7, 9, 12, 14], [0, 1, 0, 1, 2, 1, 2, 3, 4, 3, 4, 5, 4, 5], [1, -1, -1, 2, -1, -1, 1] * 2), [1, 0, -1] * 2, [1, 0, -1] * 2),
    ],
)
@pytest.mark.parametrize("config", [Config(), APPROX, Config(split=3, backend=Backend.approximate())])
def test_literal_solutions(spark, arrays, b, x, config):
    values = [float(v) for v in arrays[2]]
    f = factorize_raw(spark, np.array(arrays[0]), np.array(arrays[1], np.int64), np.array(values), len(arrays[0]) - 1, config)
    assert f.solve_array(b) == pytest.approx(x, abs=1e-12)


def test_grounded_gauge_lengths_and_facade(spark):
    f = factorize_raw(spark, [0, 2, 4], [0, 1, 0, 1], [2.0, -1, -1, 2], 2)
    assert (f.n, f.shape, f.n_steps, f.dtype) == (3, (2, 2), 2, np.float64)
    want = np.linalg.solve([[2, -1], [-1, 2]], [1, -2])
    for gauge in ("canonical", "anchored"):
        assert f.solve_array([1, -2], gauge) == pytest.approx(want)
    assert f.matvec([1]) == pytest.approx(np.linalg.solve([[2, -1], [-1, 2]], [1, 0]))
    with pytest.raises(SolveError, match="rhs length"):
        f.solve_array([1, 2, 3])
    with pytest.raises(SolveError, match="rhs length"):
        f.solve(spark.createDataFrame([(2, 1.0)], "vertex long, value double"))
    out = np.zeros(4)
    f.solve_into([1, -2], out)
    assert out[:2] == pytest.approx(want)
    with pytest.raises(SolveError, match="out length"):
        f.solve_into([1.0], np.zeros(1))
    base = np.zeros(3)
    with pytest.raises(SolveError, match="overlap"):
        f.solve_into(base[:-1], base[1:])


def test_grid_arms_and_conjugate_gradients(spark):
    m = from_edges(generators.grid(spark, 10, 10), 100)
    a, b = _dense(m), np.zeros(100)
    b[0], b[-1] = 1, -1
    exact = factorize(m, Config(backend=Backend(100))).solve_array(b)
    assert np.abs(a @ exact - b).max() < 1e-12
    f = factorize(m, APPROX)
    rough = f.solve_array(b)
    assert 1e-3 < np.linalg.norm(a @ rough - b) / np.linalg.norm(b) < 1
    again = factorize(Matrix(m.entries.repartition(7), m.n, m.ordered), APPROX).solve_array(b)
    assert (rough == again).all()
    rhs = spark.createDataFrame([(0, 1.0), (99, -1.0)], "vertex long, value double")
    helped, plain = (pcg.conjugate_gradients(m, rhs, g, most=60) for g in (f, None))
    assert helped.converged and helped.iterations < plain.iterations
    assert pcg.dot(r := pcg.residual(m, helped.x, rhs), r) ** 0.5 < 1e-7


def test_rounds_on_grid_and_grounded_tree(spark):
    m = from_edges(generators.grid(spark, 8, 8), 64)
    b = np.zeros(64)
    b[0], b[-1] = 1, -1
    rhs = spark.createDataFrame([(0, 1.0), (63, -1.0)], "vertex long, value double")
    f = rounds.eliminate(ing.ingest(m), copies=2)
    assert f.n_steps == 63
    x = np.zeros(64)
    for r in f.solve(rhs).collect():
        x[r["vertex"]] = r["value"]
    assert np.linalg.norm(_dense(m) @ x - b) / np.linalg.norm(b) < 1
    shift = spark.createDataFrame([(0, 2.0)], "vertex long, value double")
    tree = from_edges(generators.path(spark, 9), 9, shift)
    got = {r["vertex"]: r["value"] for r in rounds.eliminate(ing.ingest(tree)).solve(spark.createDataFrame([(4, 3.0)], "vertex long, value double")).collect()}
    e = np.zeros(9)
    e[4] = 3
    assert [got[i] for i in range(9)] == pytest.approx(np.linalg.solve(_dense(tree), e))


def test_large_blocks_are_eliminated_in_rounds(spark):
    edges = generators.path(spark, 30).unionByName(generators.path(spark, 5).select((F.col("u") + 30).alias("u"), (F.col("v") + 30).alias("v"), "w"))
    m = from_edges(edges, 35)
    b = np.arange(35) % 5 - 2.0
    f = factorize(m, local=10)
    assert f.large is not None and f.blocks.count() == 1 and (f.n, f.n_steps) == (35, 33)
    for gauge in ("canonical", "anchored"):
        assert f.solve_array(b, gauge) == pytest.approx(factorize(m).solve_array(b, gauge), abs=1e-9)
    rhs = spark.createDataFrame([(f"s{k}", (7 * k) % 35, 1.0 + k) for k in range(100)], "system_id string, vertex long, value double")
    table = lambda x: {(r["system_id"], r["vertex"]): r["value"] for r in x.collect()}
    assert table(f.solve(rhs)) == pytest.approx(table(factorize(m).solve(rhs)), abs=1e-9)


def test_fallback_policies(spark):
    big, small = 2.0**500, 2.0**-500
    arrays = ([0, 2, 5, 7], [0, 1, 0, 1, 2, 1, 2], [big, -big, -big, big + small, -small, -small, small], 3)
    with pytest.warns(RuntimeWarning):
        f = factorize_raw(spark, *arrays)
    assert f.fallbacks() == [Fallback("invalid_pivot", 1, DenseFailure.NON_POSITIVE)]
    with pytest.raises(DenseFactorizationFailed) as e:
        factorize_raw(spark, *arrays, Config(backend=Backend(24, ExactFailure.ERROR)))
    assert e.value.fields["vertex"] == 1
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        factorize_raw(spark, [0, 2, 5, 7], [0, 1, 0, 1, 2, 1, 2], [1e200, -1e200, -1e200, 2e200, -1e200, -1e200, 1e200], 3)


def test_saved_factors_are_checked(spark, tmp_path):
    m = from_edges(generators.interleaved_paths(spark, 60, 2), 60)
    f = factorize(m, Config(seed=-3, split=2, backend=Backend(5)))
    f.save(f"{tmp_path}/f")
    g = load(spark, f"{tmp_path}/f")
    b = np.arange(60) % 7 - 3.0
    assert (g.solve_array(b) == f.solve_array(b)).all() and g.config == f.config
    spark.createDataFrame([(f'{{"format_version": {FORMAT_VERSION + 1}}}',)], "meta string").write.mode("overwrite").parquet(f"{tmp_path}/f/meta")
    with pytest.raises(FactorError, match="version"):
        load(spark, f"{tmp_path}/f")
    blocks = f.blocks
    broken = {
        "the uneliminated vertex": blocks.withColumn("uneliminated", F.lit(999).cast("long")),
        "number of steps": blocks.withColumn("steps", F.slice("steps", 1, 3)),
        "a value of a step": blocks.withColumn("steps", F.transform("steps", lambda s: s.withField("share", F.transform(s["share"], lambda x: x + 1)))),
        "a vertex eliminated twice": blocks.withColumn("steps", F.transform("steps", lambda s: s.withField("vertex", F.element_at("vertices", 1)))),
        "dimension": blocks.withColumn("dim", F.col("dim") + 1),
    }
    assert faults(blocks).isEmpty()
    for kind, table in broken.items():
        assert kind in {r["kind"] for r in faults(table).collect()}


def test_configuration():
    assert [Config(split=k).copies for k in (None, 0, 1, 2, 7)] == [1, 1, 1, 2, 7]
    c = Config(5, 3, Backend(7, ExactFailure.ERROR))
    assert Config.from_json(c.to_json()) == c and Config.from_json('{"seed": 1}').backend == Backend()
    assert [Backend(24).routes_exact(s) for s in (0, 1, 24, 25)] == [False, True, True, False]


def test_star_tables(spark):
    rows = [(0, 2, 3.0, 2), (0, 0, 1.0, 1), (0, 2, 0.5, 3), (0, 1, 4.0, 2), (0, 0, 0.25, 1)]
    table = spark.createDataFrame(rows, "pivot long, neighbor long, weight double, copies int")
    merged = sampling.order(sampling.merge(table, 4)).orderBy("place").collect()
    assert [(r["neighbor"], r["weight"], r["copies"], r["dropped"]) for r in merged] == [(0, 1.25, 2, 0), (2, 3.5, 4, 1), (1, 4.0, 2, 0)]
    ac = sampling.merge(table.withColumn("copies", F.lit(1)), 1).orderBy("neighbor").collect()
    assert [(r["neighbor"], r["weight"], r["dropped"]) for r in ac] == [(0, 1.25, 1), (1, 4.0, 0), (2, 3.5, 1)]


def test_sampling_follows_weights(spark):
    stars = spark.range(4000).select(F.col("id").alias("index"), F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.lit(w).alias("w")) for i, w in enumerate((1.0, 2.0, 3.0, 4.0))])).alias("x"))
    stars = stars.select("index", F.col("x.n").cast("long").alias("neighbor"), F.col("x.w").alias("weight"))
    got = {(r["lo"], r["hi"]): r["s"] / 4000 for r in sampling.sample_stars(stars, 3, 2).groupBy("lo", "hi").agg(F.sum("weight").alias("s")).collect()}
    for i in range(4):
        for j in range(i + 1, 4):
            assert got[i, j] == pytest.approx((i + 1) * (j + 1) / 10, rel=0.1)
    few = sampling.sample_stars(stars.where("index < 5").repartition(3), 3, 2).orderBy("index", "lo", "hi", "weight").collect()
    assert few == sampling.sample_stars(stars, 3, 2).where("index < 5").orderBy("index", "lo", "hi", "weight").collect()
    odd = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0), (2, 0, float("nan")), (2, 1, 1.0), (3, 0, float("inf")), (3, 1, 1.0), (4, 0, -1.0), (4, 1, -2.0)], "index long, neighbor long, weight double")
    assert sampling.sample_stars(odd).collect() == []
    edges = kernels.star_edges(np.array([1.0, 2.0, 3.0, 4.0]), np.array([500] * 4), 1, 0, 0)
    seen = np.bincount([j for i, j, _ in edges if i == 0], minlength=4)[1:]
    assert seen / seen.sum() == pytest.approx([2 / 9, 3 / 9, 4 / 9], abs=0.08)


def test_layouts_and_buckets(spark):
    edges = spark.createDataFrame([(0, 3, 1.0)], "u long, v long, w double")
    rows = ing.ingest(from_edges(edges, 4)).layout().orderBy("position").collect()
    assert [(r["vertex"], r["block"], r["local"]) for r in rows] == [(0, 0, 0), (3, 0, 1), (1, 1, 0), (2, 2, 0)]
    assert [kernels.degree_bucket(d, 10) for d in (0, 5, 10, 15, 20, 10000)] == [0, 5, 10, 11, 12, 20]
    table = spark.createDataFrame([(d,) for d in (0, 5, 10, 15, 20, 10000)], "d long")
    assert [r[0] for r in table.select(vectors.degree_bucket(F.col("d"), 10)).collect()] == [0, 5, 10, 11, 12, 20]


def test_components_of_a_long_path_and_odd_edges(spark):
    edges = generators.path(spark, 3000).select("u", "v").unionByName(spark.createDataFrame([(None, 1), (5000, 5000), (4001, 4000), (4000, 4001)], "u long, v long"))
    for finish in (0, 10**6):  # by rounds, and in one task
        got = {r["vertex"]: r["component"] for r in connected_components(edges, finish=finish).collect()}
        assert got == {**{i: 0 for i in range(3000)}, 4000: 4000, 4001: 4000}
    assert connected_components(edges.where("false")).collect() == []


def test_random_graphs_in_both_arms(spark):
    rng = np.random.default_rng(5)
    for n in (5, 8):
        w = np.triu(rng.integers(0, 5, (n, n)), 1).astype(float)
        surplus = rng.integers(0, 3, n).astype(float)
        rows = [(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)]
        m = from_edges(spark.createDataFrame(rows, "u long, v long, w double"), n, spark.createDataFrame([(i, float(s)) for i, s in enumerate(surplus)], "vertex long, value double"))
        a, b = _dense(m), rng.normal(size=n)
        x = factorize(m).solve_array(b)
        want = np.linalg.pinv(a) @ b
        if np.linalg.matrix_rank(a) == n:
            assert x == pytest.approx(want)
        y = factorize(m, APPROX).solve_array(b)
        assert np.isfinite(y).all()


def test_large_blocks_take_named_systems_and_are_saved(spark, tmp_path):
    edges = generators.path(spark, 30).unionByName(generators.path(spark, 5).select((F.col("u") + 30).alias("u"), (F.col("v") + 30).alias("v"), "w"))
    m = from_edges(edges, 35)
    f = factorize(m, local=10)
    rhs = spark.createDataFrame([("a", 1, 1.0), ("a", 31, 2.0), ("b", 29, 3.0), ("c", 32, 1.0), (None, 4, 5.0)], "system_id string, vertex long, value double")
    table = lambda x: {(r["system_id"], r["vertex"]): r["value"] for r in x.collect()}
    f.save(f"{tmp_path}/f")
    g = load(spark, f"{tmp_path}/f")
    for gauge in ("canonical", "anchored"):
        want = table(factorize(m).solve(rhs, gauge))
        assert len(want) == 35 + 30 + 5 + 30
        assert table(f.solve(rhs, gauge)) == pytest.approx(want, abs=1e-9)
        assert table(g.solve(rhs, gauge)) == pytest.approx(want, abs=1e-9)
    g.large.steps.pop()
    with pytest.raises(FactorError, match="number of steps"):
        check(g)


def test_a_star_of_any_width(spark):
    wide = spark.range(5000).select(F.lit(0).alias("pivot"), F.col("id").alias("neighbor"), F.pow(F.lit(2.0), F.col("id") % 4).alias("weight"))
    small = spark.range(50).select((1 + F.col("id") % 3).alias("pivot"), F.col("id").alias("neighbor"), (1.0 + F.col("id") % 2).alias("weight"))
    whole = F.sum(F.col("weight") * (1 + F.col("lo") % 5))
    for stars in (small, wide.unionByName(small)):
        got = sampling.expected_clique(stars)
        pairs, total = got.agg(F.count(F.lit(1)), whole).first()
        assert pairs == sum(n * (n - 1) // 2 for n in (r["count"] for r in stars.groupBy("pivot").count().collect()))
        assert sampling.expected_weight(stars, 1 + F.col("lo") % 5).first()[0] == pytest.approx(total, rel=1e-9)
    table = lambda x: sorted(tuple(r) for r in x.collect())
    assert table(sampling.expected_clique(small, most=4)) == table(sampling.expected_clique(small))


def test_a_hub_star_takes_linear_time(spark):
    """Frames that Spark extends row by row: four times the neighbours are far from 16 times the work."""
    import time

    from lapgraph.storage import materialize

    def took(n, work):
        stars = materialize(spark.range(n).selectExpr("7L as pivot", "id as neighbor", "pow(2.0, id % 4) as weight", "1 as copies").coalesce(1))
        work(stars).count()
        began = time.time()
        work(stars).write.format("noop").mode("overwrite").save()
        return time.time() - began

    for work in (sampling.fractions, lambda s: sampling.sample_stars(s.withColumnRenamed("pivot", "index"))):
        assert took(80_000, work) < 6 * took(20_000, work) + 2


def test_written_tables_can_go(spark):
    from lapgraph.storage import materialize, release

    df = materialize(spark.range(3))
    path = df._written_to
    release(df, spark.range(2))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|No such file"):
        spark.read.parquet(path).count()


def test_many_systems_on_one_block_meet_it_in_lots(spark, monkeypatch):
    from lapgraph.operators import factor

    m = from_edges(generators.path(spark, 12), 12)
    rhs = spark.createDataFrame([(f"s{k}", k % 12, float(k)) for k in range(300)], "system_id string, vertex long, value double")
    table = lambda x: {(r["system_id"], r["vertex"]): r["value"] for r in x.collect()}
    want = table(factorize(m).solve(rhs))
    monkeypatch.setattr(factor, "SYSTEMS", 4)
    monkeypatch.setattr(factor, "STACK", 200)
    assert len(want) == 3600 and table(factorize(m).solve(rhs)) == pytest.approx(want, abs=1e-9)
    assert table(factorize(m, APPROX).solve(rhs)) == pytest.approx(want, abs=1e-9)


def test_single_precision(spark, tmp_path):
    w = np.float32(0.1)
    edges = spark.createDataFrame([(i, j, float(w * np.float32(1 + i))) for i in range(6) for j in range(i + 1, 6)], "u long, v long, w double")
    ptr, col, val = to_csr(from_edges(edges, 6, single=True))
    assert val.dtype == np.float32
    assert not ing.ingest(from_csr(spark, ptr, col, val, 6, single=True)).grounded
    far = val.astype(float)
    far[0] *= 1 - 1e-5
    with pytest.raises(NotDiagonallyDominant):
        ing.ingest(from_csr(spark, ptr, col, far, 6, single=True))
    b = np.array([1, 1, 1, -1, -1, -1])
    for config in (Config(), Config(seed=7, split=2, backend=Backend(0))):
        f = factorize(from_csr(spark, ptr, col, val, 6, single=True), config)
        x = f.solve_array(b)
        assert x.dtype == f.dtype == np.float32 and np.isfinite(x).all()
        assert repr(f) == f"Factor(original_n=6, seed={config.seed}, copies={config.copies}, dtype=float32)"
    f.save(str(tmp_path / "f"))
    again = load(spark, str(tmp_path / "f"))
    assert again.dtype == np.float32 and (again.solve_array(b) == x).all()
    with pytest.raises(NonFiniteValue):
        ing.ingest(from_csr(spark, [0, 1], [0], [1e39], 1, single=True))
    top = float(np.finfo(np.float32).max)
    with pytest.raises(NonFiniteRow):
        ing.ingest(from_csr(spark, [0, 2], [0, 0], [top, top], 1, single=True))


def test_rows_narrow_indices_and_sampler(spark):
    m = from_csr(spark, [0, 3, 3, 5], [2, 0, 2, 0, 2], [-1.0, 2, -1, -2, 2], 3)
    found = {r["row"]: (r["cols"], r["values"]) for r in rows(m).collect()}
    assert found == {0: ([2, 0, 2], [-1.0, 2.0, -1.0]), 1: ([], []), 2: ([0, 2], [-2.0, 2.0])}
    ptr, col, val = to_csr(m, np.uint32)
    assert (ptr.dtype, col.dtype, val.dtype) == (np.uint32, np.uint32, np.float64)
    assert ptr.tolist() == [0, 3, 3, 5] and col.tolist() == [2, 0, 2, 0, 2]
    wide = from_entries(spark.createDataFrame([(0, 0, 0.0)], "row long, col long, value double"), 300)
    with pytest.raises(CsrError, match="uint8"):
        to_csr(wide, np.uint8)
    assert repr(sampling.StarSampler.of(Config(seed=3, split=1))) == "StarSampler(seed=3, copies=1)"
    with pytest.raises(CsrError, match="values must be contiguous"):
        factorize_raw(spark, [0, 1, 2], [0, 1], np.ones(4)[::2], 2)


def test_places_of_entries_without_positions(spark):
    own = lambda *r: spark.createDataFrame(list(r), "row long, col long, value double").repartition(3)
    with pytest.raises(NonFiniteValue) as e:
        ing.ingest(from_entries(own((1, 1, 1.0), (1, 0, -1.0), (0, 1, -1.0), (0, 0, 1.0), (2, 2, math.nan)), 3))
    assert e.value.fields == {"position": 4}
    with pytest.raises(CsrError) as e:
        from_entries(own((1, 1, 1.0), (1, 7, -1.0), (0, 0, 1.0)), 2)
    assert e.value.fields == {"position": 2, "col": 7, "n": 2}


def _random_edges(spark, n, seed, scale=1.0, order=None):
    rng = np.random.default_rng(seed)
    order = np.arange(n) if order is None else order
    pairs = [(i, i + 1) for i in range(n - 1)] + [tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(2 * n)]
    found = [(int(order[i]), int(order[j]), float(scale * w)) for (i, j), w in zip(pairs, rng.uniform(0.5, 2, len(pairs)), strict=True)]
    return spark.createDataFrame(found, "u long, v long, w double")


@pytest.mark.parametrize("config", [Config(backend=Backend(30)), APPROX, Config(seed=3, split=2, backend=Backend(0))])
def test_scaling_a_matrix_scales_its_solutions(spark, config):
    b = np.zeros(30)
    b[0], b[-1] = 1, -1
    base = factorize(from_edges(_random_edges(spark, 30, 5), 30), config).solve_array(b)
    for power in (-600, 400):
        x = factorize(from_edges(_random_edges(spark, 30, 5, 2.0**power), 30), config).solve_array(b)
        np.testing.assert_allclose(x * 2.0**power, base, rtol=1e-9, atol=1e-12)


def test_renaming_vertices_renames_exact_solutions(spark):
    order = np.random.default_rng(8).permutation(30)
    b = np.random.default_rng(9).normal(size=30)
    config = Config(backend=Backend(30))
    x = factorize(from_edges(_random_edges(spark, 30, 5), 30), config).solve_array(b - b.mean())
    moved = np.zeros(30)
    moved[order] = b - b.mean()
    y = factorize(from_edges(_random_edges(spark, 30, 5, order=order), 30), config).solve_array(moved)
    np.testing.assert_allclose(y[order], x, rtol=1e-10, atol=1e-12)


def test_rough_solutions_of_many_seeds(spark):
    m = from_edges(_random_edges(spark, 40, 11), 40)
    a, b = _dense(m), np.random.default_rng(2).normal(size=40)
    b -= b.mean()
    graph = ing.ingest(m)
    v, e = (np.array(df.collect(), float) for df in (graph.vertices.select("vertex", "diagonal").orderBy("vertex"), graph.edges.select("u", "v", "w").orderBy("u", "v")))
    left = {1: [], 3: []}
    for copies, found in left.items():
        for seed in range(96):
            s = kernels.eliminate(v[:, 1], e[:, 0].astype(int), e[:, 1].astype(int), e[:, 2], seed, 0, copies)
            x = kernels.approximate_solve(*(np.array(y) for y in (s.pivots, s.inverse, s.ends, s.to, s.share)), s.uneliminated, b[:, None])[:, 0]
            found.append(np.linalg.norm(a @ x - b) / np.linalg.norm(b))
    assert np.isfinite(left[1]).all() and np.median(left[1]) < 1
    assert np.mean(left[3]) < np.mean(left[1])


def test_edges_become_a_graph_without_a_matrix_between(spark, monkeypatch):
    rows = [(3, 1, 2.0), (1, 3, 4.0), (1, 2, 1.0), (5, 5, 9.0), (4, 2, 0.0), (6, 7, 1.0), (8, 7, 0.5), (2, 3, 8.0)]
    edges = spark.createDataFrame(rows, "u long, v long, w double").repartition(3)
    table = lambda g: (sorted(map(tuple, g.vertices.select("vertex", "diagonal", "block").collect())), sorted(map(tuple, g.edges.select("u", "v", "w", "block").collect())))
    plain = from_edges(edges, 10)
    want = table(ing.ingest(Matrix(plain.entries, 10, False, numbered=False)))
    monkeypatch.setattr(ing, "coalesce", None)
    assert table(ing.ingest(plain)) == want
    monkeypatch.undo()
    with pytest.raises(PositiveOffDiagonal):
        ing.ingest(from_edges(spark.createDataFrame([(0, 1, -1.0)], "u long, v long, w double"), 2))
    with pytest.raises(NonFiniteValue):
        ing.ingest(from_edges(spark.createDataFrame([(0, 1, math.nan)], "u long, v long, w double"), 2))


def test_conjugate_gradients_run_block_by_block(spark, monkeypatch):
    """A floating grid, a grounded path, an exact block and a lone vertex: no product by tables, the solution of the matrix."""
    edges = generators.grid(spark, 7, 7).unionByName(generators.path(spark, 40).select(F.col("u") + 49, F.col("v") + 49, "w").toDF("u", "v", "w"))
    edges = edges.unionByName(spark.createDataFrame([(89, 90, 2.0), (90, 91, 1.0)], "u long, v long, w double"))
    m = from_edges(edges, 93, spark.createDataFrame([(60, 1.0), (75, 0.5)], "vertex long, value double"))
    a, b = _dense(m), np.random.default_rng(3).normal(size=93)
    for lo, hi in ((0, 49), (89, 92)):
        b[lo:hi] -= b[lo:hi].mean()
    b[92] = 0.0
    rhs = spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], "vertex long, value double")
    f = factorize(m)
    monkeypatch.setattr(pcg, "multiply", None)
    found = pcg.conjugate_gradients(m, rhs, f, 1e-10)
    x = np.zeros(93)
    for r in found.x.collect():
        x[r["vertex"]] = r["value"]
    assert found.converged and found.iterations < 49
    assert np.linalg.norm(b - a @ x) <= 1e-8 * np.linalg.norm(b)


@pytest.mark.parametrize("copies", [1, 3])
@pytest.mark.parametrize("dense", [4, 2048])
def test_array_elimination(monkeypatch, copies, dense):
    """On a tree exact; on a grid and a crowded graph a permutation whose solve brings conjugate gradients home sooner."""
    monkeypatch.setattr(kernels, "WIDE", 0)
    monkeypatch.setattr(kernels, "DENSE", dense)
    rng = np.random.default_rng(2)
    tree = (np.arange(1, 300), rng.integers(0, np.arange(1, 300)), rng.uniform(0.1, 9, 299))
    at = np.arange(900)
    right, down = at[at % 30 < 29], at[:-30]
    grid = (np.r_[right, down], np.r_[right + 1, down + 30], np.ones(len(right) + len(down)))
    u, v = np.triu_indices(60, 1)
    crowd = (u, v, rng.uniform(0.5, 2, len(u)))
    for n, (u, v, w) in ((300, tree), (900, grid), (60, crowd)):
        diagonal = np.bincount(u, w, n) + np.bincount(v, w, n)
        s = kernels.eliminate(diagonal, u, v, w, 1, 0, copies)
        assert sorted([*np.asarray(s.pivots).tolist(), s.uneliminated]) == list(range(n))
        parts = (np.asarray(s.pivots), np.asarray(s.inverse), np.asarray(s.ends), np.asarray(s.to), np.asarray(s.share), s.uneliminated)
        levels = kernels.Levels(*parts, n)
        b = rng.normal(size=n)
        b -= b.mean()
        assert levels.solve(b) == pytest.approx(kernels.approximate_solve(*parts, b[:, None])[:, 0])
        apply = lambda r, levels=levels: kernels.recovered(levels.solve(r - r.mean())[:, None], False)[:, 0]
        x, helped, left, size = kernels.gradients((diagonal, u, v, w), False, apply, b, 1e-10, 500)
        assert left <= 1e-20 * size and helped < (2 if n == 300 else 60)
        assert diagonal * x - np.bincount(u, w * x[v], n) - np.bincount(v, w * x[u], n) == pytest.approx(b, abs=1e-7)


def test_sampled_stars_stream_by(spark, monkeypatch):
    """Stars longer than an Arrow batch, short ones and one without a name: as many draws as asked for, by weight, and none of them sorted."""
    stars = spark.range(700).select(F.when(F.col("id") % 7 < 5, 1).when(F.col("id") % 7 == 5, F.col("id")).cast("long").alias("index"), F.col("id").alias("neighbor"), F.pow(F.lit(2.0), F.col("id") % 4).alias("weight"))
    stars = stars.withColumn("index", F.when(F.col("index") > 1, F.col("index") % 35).otherwise(F.col("index")))
    sampled = sampling.sample_stars(stars, 1, 16)
    plan = sampled._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") <= 1
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    tables = []
    try:
        for rows in ("64", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            tables.append(sorted(map(tuple, sampling.sample_stars(stars, 1, 16).withColumn("index", F.coalesce("index", F.lit(-1))).collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [t[:3] for t in tables[0]] == [t[:3] for t in tables[1]]
    own = {}
    for r in stars.collect():
        own.setdefault(-1 if r["index"] is None else r["index"], []).append(r["weight"])
    for index, w in own.items():
        drawn = [t for t in tables[0] if t[0] == index]
        assert len(drawn) == 16 * (len(w) - 1)
        assert sum(t[3] for t in drawn) == pytest.approx((sum(w) ** 2 - sum(x * x for x in w)) / (2 * sum(w)))
        if len(w) > 100:
            share = sum(t[3] * (t[2] % 4 == 3) for t in drawn) / sum(t[3] for t in drawn)
            pairs = [(a, b) for a in range(len(w)) for b in range(a)]
            want = sum(w[a] * w[b] for a, b in pairs if w[a] == 8) / sum(w[a] * w[b] for a, b in pairs)
            assert share == pytest.approx(want, abs=0.05)


def test_rounds_hand_on_only_what_is_left(spark, monkeypatch, tmp_path):
    """On trees and cycles rounds stay exact; what they write in all is a small multiple of the graph; the rest may be factored in tasks."""
    rng = np.random.default_rng(4)
    edges = [(i, int(rng.integers(0, i)), float(rng.uniform(0.1, 5))) for i in range(1, 120)] + [(120 + i, 120 + (i + 1) % 9, 1.0 + i) for i in range(9)]
    m = from_edges(spark.createDataFrame(edges, "u long, v long, w double"), 129)
    graph, written = ing.ingest(m), []
    keep = rounds.materialize
    monkeypatch.setattr(rounds, "materialize", lambda df: written.append(out := keep(df)) or out)
    f = rounds.eliminate(graph)
    b = rng.normal(size=129)
    b[:120] -= b[:120].mean()
    b[120:] -= b[120:].mean()
    rhs = spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], "vertex long, value double")
    written.clear()
    found = {r["vertex"]: r["value"] for r in f.solve(rhs).collect()}
    assert _dense(m) @ np.array([found[i] for i in range(129)]) == pytest.approx(b, abs=1e-9)
    assert sum(t.count() for t in written) < 6 * 129
    monkeypatch.undo()
    g = factorize(m, APPROX, local=60)
    assert g.large.rest is not None and g.n_steps == 127
    g.save(f"{tmp_path}/g")
    for one in (g, load(spark, f"{tmp_path}/g")):
        assert _dense(m) @ one.solve_array(b) == pytest.approx(b, abs=1e-9)
    found = pcg.conjugate_gradients(m, rhs, g)
    assert found.converged and found.iterations <= 3
    hubs = from_edges(spark.range(50).select(F.col("id").alias("u"), F.lit(50).cast("long").alias("v"), F.lit(1.0).alias("w")).unionByName(generators.grid(spark, 5, 10)), 51)
    assert factorize(hubs, APPROX, local=100).large is not None  # 51 vertices, but 135 edges


def test_checks_of_a_factor_grow_with_its_size_alone(spark, monkeypatch):
    f = factorize(from_edges(generators.interleaved_paths(spark, 70_000, 7), 70_000), APPROX)
    monkeypatch.setattr(F, "countDistinct", None)
    check(f)
    for n, changed in ((70_001, f.blocks), (70_000, f.blocks.withColumn("vertices", F.when(F.col("block") == 3, F.transform("vertices", lambda v: v - 1)).otherwise(F.col("vertices"))))):
        with pytest.raises(FactorError):
            check(type(f)(changed, n, APPROX))
    plan = faults(f.blocks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_contains") <= plan.count("uneliminated") and "array_except" in plan
