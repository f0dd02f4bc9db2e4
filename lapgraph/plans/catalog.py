"""Named queries over the driver's tables, with the DuckDB SQL they are held against.

Every graph here has weights that are powers of two, so that assembled entries are exact; solutions are compared after
rounding to four places, off any tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapgraph.model import Backend, Config
from lapgraph.operators import ingest as ing
from lapgraph.operators import pcg, rounds, sampling, vectors
from lapgraph.operators.factor import Factor, factorize, load
from lapgraph.sources import generators
from lapgraph.sources.matrix import Matrix, from_edges, from_entries
from lapgraph.storage import materialize, shared_dir

FLAGSHIP = "q18_forest_potentials"
#: Keeps rounded values away from ties, which decimal fractions of block sizes would meet.
OFF = 3.17e-6
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(x: Column, digits: int = 4) -> Column:
    return F.round(x + OFF, digits) + F.lit(0.0)


def _sql_r(x: str, digits: int = 4) -> str:
    return f"round(({x}) + {OFF}, {digits}) + 0.0"


def _size(df: DataFrame, key: str) -> int:
    return (df.agg(F.max(key)).first()[0] or 0) + 1


# ---- graphs ---------------------------------------------------------------------------------------------------------


def _chain(df: DataFrame, block: str, vertex: str, order: list[str], weight: Column, closed: bool = False) -> DataFrame:
    """``u, v, w``: a path per block in the given order, or a cycle."""
    along = Window.partitionBy(block).orderBy(*order)
    edges = df.select(F.col(vertex).alias("u"), F.lead(vertex).over(along).alias("v"), weight.alias("w"), F.first(vertex).over(along).alias("f"), F.row_number().over(along).alias("i"))
    if closed:
        edges = edges.withColumn("v", F.coalesce("v", F.when(F.col("i") > 2, F.col("f"))))
    return edges.where("v is not null").select("u", "v", "w")


def _orders(spark, d):
    return _t(spark, d, "orders").withColumn("b", (F.round(F.col("o_totalprice") * 100) % 1000).cast("double"))


def _order_matrix(spark, d) -> Matrix:
    o = _orders(spark, d)
    return from_edges(_chain(o, "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"], F.pow(F.lit(2.0), F.col("o_orderkey") % 3)), _size(o, "o_orderkey"))


def _order_solution(spark, d, factor: Factor, gauge: str = "canonical") -> DataFrame:
    o = _orders(spark, d)
    x = factor.solve(o.select(F.col("o_orderkey").alias("vertex"), F.col("b").alias("value")), gauge)
    return o.select(F.col("o_custkey").alias("blk"), F.col("o_orderkey").alias("vertex")).join(x, "vertex").select("blk", F.col("vertex").alias("v"), _r(F.col("value")).alias("x"))


def _events(spark, d):
    return _t(spark, d, "events").withColumn("b", (F.round(F.abs("value") * 100) % 1000).cast("double"))


def _event_matrix(spark, d, closed: bool = False) -> Matrix:
    e = _events(spark, d)
    return from_edges(_chain(e, "user_id", "event_id", ["ts", "event_id"], F.pow(F.lit(2.0), F.col("event_id") % 3), closed), _size(e, "event_id"))


_PATH = """with p as (select {blk} blk, {v} v, cast(cast(round(abs({value})*100) as bigint) % 1000 as double) b, row_number() over w i, power(2.0, {v} % 3) wt
           from {table} window w as (partition by {blk} order by {order})),
 f as (select *, b - avg(b) over (partition by blk) bb from p),
 g as (select *, sum(bb) over (partition by blk order by i) fl from f),
 h as (select *, coalesce(-sum(fl/wt) over (partition by blk order by i rows between unbounded preceding and 1 preceding), 0) x0 from g)
"""
_ORDER_PATH = _PATH.format(blk="o_custkey", v="o_orderkey", value="o_totalprice", table="orders", order="o_orderdate, o_orderkey")
_EVENT_PATH = _PATH.format(blk="user_id", v="event_id", value="value", table="events", order="ts, event_id")
_CENTRED = f"select blk, v, {_sql_r('x0 - avg(x0) over (partition by blk)')} as x from h"


# ---- assembly and validation ----------------------------------------------------------------------------------------


def _part_supplier(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.pow(F.lit(2.0), F.col("l_linenumber") % 3).alias("value"))


@_query("q01_coalesce", 'select l_partkey as "row", l_suppkey as col, sum(power(2.0, l_linenumber % 3)) as value from lineitem group by 1, 2')
def q01(spark, d):
    rows = _part_supplier(spark, d)
    return ing.coalesce(from_entries(rows, max(_size(rows, "row"), _size(rows, "col")))).select("row", "col", "value")


_SHIFT = "(select max(l_partkey) + 1 from lineitem)"


@_query(
    "q02_laplacian",
    f"""with e as (select l_partkey u, l_suppkey + {_SHIFT} v, power(2.0, l_linenumber % 3) w from lineitem),
    c as (select u r, v c, -w x from e union all select v, u, -w from e union all select u, u, w from e union all select v, v, w from e)
    select r as "row", c as col, sum(x) as value from c group by 1, 2""",
)
def q02(spark, d):
    rows = _part_supplier(spark, d)
    parts = _size(rows, "row")
    edges = rows.select(F.col("row").alias("u"), (F.col("col") + parts).alias("v"), F.col("value").alias("w"))
    return ing.coalesce(from_edges(edges, parts + _size(rows, "col"))).select("row", "col", "value")


@_query(
    "q03_violations",
    """with c as (select l_partkey % 50 p, 50 + l_suppkey % 50 s, cast(count(*) as double) n from lineitem group by 1, 2),
    m as (select p, s, case when (p + s) % 13 = 0 then n else -n end up, case when (p + s) % 7 = 0 then 0 when (p + s) % 11 = 0 then -n - 1 when (p + s) % 13 = 0 then n else -n end low from c)
    select p as "row", s as col, case when up <> low then 'asymmetric' else 'positive' end as kind from m where up <> low or up > 0""",
)
def q03(spark, d):
    counts = _t(spark, d, "lineitem").groupBy((F.col("l_partkey") % 50).alias("p"), (50 + F.col("l_suppkey") % 50).alias("s")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    k, n = F.col("p") + F.col("s"), F.col("n")
    upper = counts.select(F.col("p").alias("row"), F.col("s").alias("col"), F.when(k % 13 == 0, n).otherwise(-n).alias("value"))
    lower = counts.select(F.col("s").alias("row"), F.col("p").alias("col"), F.when(k % 7 == 0, 0.0).when(k % 11 == 0, -n - 1).when(k % 13 == 0, n).otherwise(-n).alias("value"))
    return ing.violations(ing.mirrors(ing.coalesce(from_entries(upper.unionByName(lower), 100)))).select("row", "col", "kind")


def _customer_path(spark, d, shift: Column) -> Matrix:
    c = _t(spark, d, "customer")
    n = _size(c, "c_custkey")
    own = c.select(F.col("c_custkey").alias("vertex"), shift.alias("value"))
    return from_edges(generators.path(spark, n), n, own)


@_query(
    "q04_balance",
    """select c_custkey as "row", cast(((c_custkey % 4) - 1) * 0.5 as double) as excess, case when c_custkey % 4 = 0 then 'deficit' when c_custkey % 4 = 1 then 'negligible' else 'surplus' end as class,
    cast(greatest(((c_custkey % 4) - 1) * 0.5, 0.0) as double) as surplus from customer""",
)
def q04(spark, d):
    m = _customer_path(spark, d, ((F.col("c_custkey") % 4) - 1) * F.lit(0.5))
    terms = m.entries.groupBy("row").agg(F.count(F.lit(1)).alias("terms"))
    return ing.balances(ing.coalesce(m), terms, m.ordered).select("row", "excess", "class", "surplus")


@_query(
    "q05_grounding",
    """with s as (select c_custkey u, (c_custkey % 4) * 0.5 w from customer where c_custkey % 4 > 0), n as (select cast(max(c_custkey) + 1 as bigint) n from customer)
    select cast(u as bigint) as u, n as v, cast(w as double) as w from s, n union all select n, n, cast(sum(w) as double) from s, n group by n""",
)
def q05(spark, d):
    m = _customer_path(spark, d, (F.col("c_custkey") % 4) * F.lit(0.5))
    g = ing.ingest(m)
    edges = g.edges.where(F.col("v") == g.n).select("u", "v", "w")
    return edges.unionByName(g.vertices.where(F.col("vertex") == g.n).select(F.col("vertex").alias("u"), F.col("vertex").alias("v"), F.col("diagonal").alias("w")))


@_query("q06_components", "select event_id as vertex, min(event_id) over (partition by user_id % 10) as component from events")
def q06(spark, d):
    e = _events(spark, d)
    paths = _chain(e, "user_id", "event_id", ["ts", "event_id"], F.lit(1.0)).select("u", "v")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("u"))
    heads = first.select((F.col("user_id") % 10).alias("k"), "u").groupBy("k").agg(F.min("u").alias("v"))
    links = first.select((F.col("user_id") % 10).alias("k"), "u").join(heads, "k").select("u", "v")
    from lapgraph.operators.components import connected_components

    return connected_components(paths.unionByName(links))


@_query(
    "q07_layout",
    """with b as (select o_orderkey v, min(o_orderkey) over (partition by o_custkey) block from orders)
    select v as vertex, block, row_number() over (partition by block order by v) - 1 as local, row_number() over (order by block, v) - 1 as position from b""",
)
def q07(spark, d):
    return ing.ingest(_order_matrix(spark, d), checked=False).layout()


@_query(
    "q08_routing",
    """select min(o_orderkey) as block, count(*) as dim, count(*) - 1 as solved, 'floating' as anchor,
    case when count(*) - 1 between 1 and 24 then 'exact' else 'approximate' end as arm from orders group by o_custkey""",
)
def q08(spark, d):
    """The arm that the engine took."""
    return factorize(_order_matrix(spark, d)).blocks.select("block", "dim", (F.col("dim") - 1).alias("solved"), "anchor", "arm")


# ---- stars ----------------------------------------------------------------------------------------------------------


def _supplier_stars(spark, d, k: int) -> DataFrame:
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("pivot"), F.col("l_partkey").alias("neighbor"), F.pow(F.lit(2.0), F.col("l_linenumber") % 3).alias("weight"), F.lit(1).alias("copies"))
    return sampling.merge(rows, k)


_MERGED = """select l_suppkey as "pivot", l_partkey neighbor, sum(power(2.0, l_linenumber % 3)) weight, least(count(*), 3) copies, count(*) - least(count(*), 3) dropped from lineitem group by 1, 2"""


@_query("q09_star_merge", _MERGED)
def q09(spark, d):
    return _supplier_stars(spark, d, 3)


@_query("q10_star_order", f"with m as ({_MERGED}) select *, row_number() over (partition by \"pivot\" order by weight / copies, neighbor) - 1 as place from m")
def q10(spark, d):
    return sampling.order(_supplier_stars(spark, d, 3))


@_query(
    "q11_fractions",
    f"""with m as ({_MERGED}), s as (select *, sum(weight) over (partition by "pivot") total,
      sum(weight) over (partition by "pivot" order by weight / copies, neighbor rows between current row and unbounded following) suffix from m)
    select "pivot", neighbor, total, suffix, {_sql_r("weight / suffix", 9)} as fraction, {_sql_r("weight * ((suffix - weight) / total) / copies", 9)} as fill from s""",
)
def q11(spark, d):
    f = sampling.fractions(_supplier_stars(spark, d, 3))
    return f.select("pivot", "neighbor", "total", "suffix", _r(F.col("fraction"), 9).alias("fraction"), _r(F.col("fill"), 9).alias("fill"))


def _customer_stars(spark, d) -> DataFrame:
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("pivot"), F.col("o_orderkey").alias("neighbor"), F.pow(F.lit(2.0), F.col("o_orderkey") % 4).alias("weight"))


@_query(
    "q12_expected_clique",
    f"""with s as (select o_custkey p, o_orderkey n, power(2.0, o_orderkey % 4) w, sum(power(2.0, o_orderkey % 4)) over (partition by o_custkey) t from orders)
    select a.p as "pivot", a.n as lo, b.n as hi, {_sql_r("a.w * b.w / a.t", 9)} as weight from s a join s b on a.p = b.p and a.n < b.n""",
)
def q12(spark, d):
    return sampling.expected_clique(_customer_stars(spark, d)).withColumn("weight", _r(F.col("weight"), 9))


# ---- right sides ----------------------------------------------------------------------------------------------------


@_query(
    "q13_mean_projection",
    f"""with p as (select o_custkey blk, o_orderkey v, cast(cast(round(o_totalprice*100) as bigint) % 1000 as double) b from orders)
    select v as vertex, min(v) over (partition by blk) as block, {_sql_r("b - avg(b) over (partition by blk)")} as value from p""",
)
def q13(spark, d):
    rhs = _orders(spark, d).select(F.col("o_orderkey").alias("vertex"), F.col("b").alias("value"))
    return vectors.prepare(ing.ingest(_order_matrix(spark, d), checked=False), rhs).withColumn("value", _r(F.col("value")))


@_query(
    "q14_ground_rhs",
    """with c as (select c_custkey v, cast(cast(round(abs(c_acctbal)*100) as bigint) % 1000 as double) b from customer)
    select v as vertex, b as value from c union all select max(v) + 1, -sum(b) from c""",
)
def q14(spark, d):
    m = _customer_path(spark, d, F.lit(1.0) + F.col("c_custkey") % 2)
    return vectors.prepare(ing.ingest(m, checked=False), _customer_rhs(spark, d)).select("vertex", "value")


def _customer_rhs(spark, d) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("vertex"), (F.round(F.abs("c_acctbal") * 100) % 1000).cast("double").alias("value"))


# ---- solutions ------------------------------------------------------------------------------------------------------


@_query("q15_diagonal_solve", f"select c_custkey as vertex, {_sql_r('cast(cast(round(abs(c_acctbal)*100) as bigint) % 1000 as double) / (1 + c_custkey % 7)')} as x from customer")
def q15(spark, d):
    c = _t(spark, d, "customer")
    entries = c.select(F.col("c_custkey").alias("row"), F.col("c_custkey").alias("col"), (1.0 + F.col("c_custkey") % 7).alias("value"))
    x = factorize(from_entries(entries, _size(c, "c_custkey"))).solve(_customer_rhs(spark, d))
    return x.select("vertex", _r(F.col("value")).alias("x"))


@_query("q16_order_paths_exact", _ORDER_PATH + _CENTRED)
def q16(spark, d):
    return _order_solution(spark, d, factorize(_order_matrix(spark, d), Config(backend=Backend(10_000))))


@_query("q17_event_paths_approximate", _EVENT_PATH + _CENTRED)
def q17(spark, d):
    e = _events(spark, d)
    x = factorize(_event_matrix(spark, d), Config(backend=Backend.approximate())).solve(e.select(F.col("event_id").alias("vertex"), F.col("b").alias("value")))
    return e.select(F.col("user_id").alias("blk"), F.col("event_id").alias("vertex")).join(x, "vertex").select("blk", F.col("vertex").alias("v"), _r(F.col("value")).alias("x"))


_FOREST = f"""with cb as (select c_custkey, c_nationkey nk, cast(cast(round(abs(c_acctbal)*100) as bigint) % 1000 as double) b, power(2.0, c_custkey % 3) w from customer),
 v as (select n_regionkey r, count(c_custkey) nc, count(distinct n_nationkey) nn, sum(coalesce(b, 0)) sb from nation left join cb on nk = n_nationkey group by 1),
 m as (select r, sb / (nc + nn + 1.0) mean from v),
 n1 as (select n_nationkey nk, n_regionkey r, power(2.0, n_nationkey % 2) w, coalesce(sum(b - mean) filter (c_custkey is not null), 0) - any_value(mean) sub, any_value(mean) mean
        from nation join m on r = n_regionkey left join cb on cb.nk = n_nationkey group by all),
 n2 as (select nk, r, mean, sub / w xn from n1),
 allv as (select r, 'r' k, r id, 0.0 x from m union all select r, 'n', nk, xn from n2 union all select r, 'c', c_custkey, xn + (b - mean) / cb.w from cb join n2 using (nk))
select k, cast(id as bigint) as id, {_sql_r("x - avg(x) over (partition by r)")} as x from allv"""


@_query("q18_forest_potentials", _FOREST)
def q18(spark, d):
    r, n, c = (_t(spark, d, t) for t in ("region", "nation", "customer"))
    nr, nn = _size(r, "r_regionkey"), _size(n, "n_nationkey")
    up = n.select((F.col("n_nationkey") + nr).cast("long").alias("u"), F.col("n_regionkey").cast("long").alias("v"), F.pow(F.lit(2.0), F.col("n_nationkey") % 2).alias("w"))
    low = c.select((F.col("c_custkey") + nr + nn).cast("long").alias("u"), (F.col("c_nationkey") + nr).cast("long").alias("v"), F.pow(F.lit(2.0), F.col("c_custkey") % 3).alias("w"))
    m = from_edges(up.unionByName(low), nr + nn + _size(c, "c_custkey"))
    x = factorize(m).solve(_customer_rhs(spark, d).select((F.col("vertex") + nr + nn).alias("vertex"), "value"))
    kind = F.when(F.col("vertex") < nr, "r").when(F.col("vertex") < nr + nn, "n").otherwise("c")
    at = F.when(F.col("vertex") < nr, F.col("vertex")).when(F.col("vertex") < nr + nn, F.col("vertex") - nr).otherwise(F.col("vertex") - nr - nn)
    return x.select(kind.alias("k"), at.cast("long").alias("id"), _r(F.col("value")).alias("x"))


@_query("q19_anchored_solve", _ORDER_PATH + f"select blk, v, {_sql_r('x0 - max_by(x0, v) over (partition by blk)')} as x from h")
def q19(spark, d):
    return _order_solution(spark, d, factorize(_order_matrix(spark, d)), "anchored")


@_query(
    "q20_multiply",
    f"""with p as (select o_custkey blk, o_orderkey v, cast(cast(round(o_totalprice*100) as bigint) % 1000 as double) b, power(2.0, o_orderkey % 3) wt, row_number() over w i,
      lead(o_totalprice) over w nt, lag(o_totalprice) over w pt, lag(o_orderkey) over w pk from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
    q as (select v, b, wt, cast(cast(round(nt*100) as bigint) % 1000 as double) nb, cast(cast(round(pt*100) as bigint) % 1000 as double) pb, power(2.0, pk % 3) pw from p)
    select v as vertex, {_sql_r("coalesce(wt * (b - nb), 0) + coalesce(pw * (b - pb), 0)")} as value from q where nb is not null or pb is not null""",
)
def q20(spark, d):
    rhs = _orders(spark, d).select(F.col("o_orderkey").alias("vertex"), F.col("b").alias("value"))
    return pcg.multiply(_order_matrix(spark, d), rhs).withColumn("value", _r(F.col("value")))


@_query(
    "q21_batched_rhs",
    f"""with s as (select distinct event_type system_id, user_id u from events),
    p as (select system_id, user_id blk, event_id v, case when event_type = system_id then cast(cast(round(abs(value)*100) as bigint) % 1000 as double) else 0.0 end b,
        row_number() over w i, power(2.0, event_id % 3) wt from events join s on user_id = u window w as (partition by system_id, user_id order by ts, event_id)),
    f as (select *, b - avg(b) over (partition by system_id, blk) bb from p),
    g as (select *, sum(bb) over (partition by system_id, blk order by i) fl from f),
    h as (select *, coalesce(-sum(fl/wt) over (partition by system_id, blk order by i rows between unbounded preceding and 1 preceding), 0) x0 from g)
    select system_id, v as vertex, {_sql_r("x0 - avg(x0) over (partition by system_id, blk)")} as x from h""",
)
def q21(spark, d):
    rhs = _events(spark, d).select(F.col("event_id").alias("vertex"), F.col("b").alias("value"), F.col("event_type").alias("system_id"))
    x = factorize(_event_matrix(spark, d), Config(backend=Backend.approximate())).solve(rhs)
    return x.select("system_id", "vertex", _r(F.col("value")).alias("x"))


@_query(
    "q22_degree_buckets",
    "select l_partkey as vertex, count(*) as degree, cast(case when count(*) <= 10 then count(*) else least(10 + count(*) // 10, 20) end as bigint) as bucket from lineitem group by 1",
)
def q22(spark, d):
    degree = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("vertex")).agg(F.count(F.lit(1)).alias("degree"))
    return degree.withColumn("bucket", vectors.degree_bucket(F.col("degree"), 10))


@_query(
    "q23_exact_triangle",
    """with s as (select min(o_orderkey) block, count(*) m from orders group by o_custkey having count(*) between 2 and 25), e as (select block, m, unnest(range(1, m)) i from s)
    select block, cast(i as bigint) as i, cast(i as bigint) as j, cast(1 as double) as value from e union all select block, i, i - 1, cast(-1 as double) from e where i > 1""",
)
def q23(spark, d):
    o = _orders(spark, d)
    m = from_edges(_chain(o, "o_custkey", "o_orderkey", ["o_orderkey"], F.lit(1.0)), _size(o, "o_orderkey"))
    f = factorize(m).blocks.where("arm = 'exact'").select("block", F.posexplode("lower").alias("p", "value"))
    i = F.floor((F.sqrt(8.0 * F.col("p") + 1) + 1) / 2).cast("long")
    cells = f.withColumn("i", i).withColumn("j", F.col("p") - (F.col("i") * (F.col("i") - 1) / 2).cast("long") + 1)
    return cells.where("value != 0").select("block", "i", F.col("j").cast("long").alias("j"), "value")


@_query("q24_complete_graph", f"select cast(n_nationkey as bigint) as vertex, {_sql_r('(n_nationkey * n_nationkey - avg(n_nationkey * n_nationkey) over ()) / count(*) over ()')} as x from nation")
def q24(spark, d):
    n = _t(spark, d, "nation")
    size = _size(n, "n_nationkey")
    rhs = n.select(F.col("n_nationkey").cast("long").alias("vertex"), (F.col("n_nationkey") * F.col("n_nationkey")).cast("double").alias("value"))
    return factorize(from_edges(generators.complete(spark, size), size)).solve(rhs).select("vertex", _r(F.col("value")).alias("x"))


@_query(
    "q25_two_vertex_blocks",
    f"""with p as (select p_partkey v, cast(cast(round(p_retailprice*100) as bigint) % 1000 as double) b from part)
    select a.v as vertex, {_sql_r("(a.b - b.b) / 4")} as x from p a join p b on b.v = a.v + 1 - 2 * (a.v % 2)""",
)
def q25(spark, d):
    p = _t(spark, d, "part")
    pairs = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("u"), (F.col("p_partkey") + 1).alias("v"), F.lit(1.0).alias("w")).join(p.select(F.col("p_partkey").alias("v")), "v")
    rhs = p.select(F.col("p_partkey").alias("vertex"), (F.round(F.col("p_retailprice") * 100) % 1000).cast("double").alias("value"))
    x = factorize(from_edges(pairs.select("u", "v", "w"), _size(p, "p_partkey"))).solve(rhs)
    return x.select("vertex", _r(F.col("value")).alias("x"))


@_query(
    "q26_event_cycles",
    _EVENT_PATH.rsplit(" h as", 1)[0].rstrip().rstrip(",")
    + f""", c as (select *, sum(fl/wt) over (partition by blk) / sum(1/wt) over (partition by blk) cc from g),
    h as (select *, coalesce(-sum((fl - cc)/wt) over (partition by blk order by i rows between unbounded preceding and 1 preceding), 0) x0 from c) {_CENTRED}""",
)
def q26(spark, d):
    e = _events(spark, d)
    x = factorize(_event_matrix(spark, d, True), Config(backend=Backend.approximate())).solve(e.select(F.col("event_id").alias("vertex"), F.col("b").alias("value")))
    return e.select(F.col("user_id").alias("blk"), F.col("event_id").alias("vertex")).join(x, "vertex").select("blk", F.col("vertex").alias("v"), _r(F.col("value")).alias("x"))


@_query("q27_fallbacks", "select 'invalid_pivot' as kind, cast(3 * n_nationkey + 1 as bigint) as vertex, 'non_positive_pivot' as failure from nation")
def q27(spark, d):
    """A block of three vertices for each nation, in which a small weight vanishes beside a great one."""
    import warnings

    n, big, small = _t(spark, d, "nation"), 2.0**500, 2.0**-500
    cells = [(0, 0, big), (0, 1, -big), (1, 0, -big), (1, 1, big + small), (1, 2, -small), (2, 1, -small), (2, 2, small)]
    rows = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(i).alias("i"), F.lit(x).alias("x")) for i, (r, c, x) in enumerate(cells)])
    at = n.select((F.col("n_nationkey") * 3).alias("v"), F.explode(rows).alias("e"))
    entries = at.select((F.col("v") + F.col("e.r")).alias("row"), (F.col("v") + F.col("e.c")).alias("col"), (F.col("v") * 7 + F.col("e.i")).alias("pos"), F.col("e.x").alias("value"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        f = factorize(from_entries(entries, 3 * _size(n, "n_nationkey"), True))
    return f.blocks.where("fallback is not null").select(F.col("fallback").alias("kind"), F.col("fallback_vertex").alias("vertex"), "failure")


def part_supplier_system(spark, d) -> tuple[Matrix, DataFrame, Factor]:
    """The part-supplier Laplacian of the whole of lineitem, a right side, and the approximate factor.

    Each line sends its quantity from its supplier to its part, so the right side is consistent in every component.
    """
    rows = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"), F.pow(F.lit(2.0), F.col("l_linenumber") % 3).alias("w"), F.col("l_quantity").cast("double").alias("q"))
    parts = _size(rows, "u")
    rows = rows.withColumn("v", F.col("v") + parts)
    m = from_edges(rows.select("u", "v", "w"), _size(rows, "v"))
    b = rows.select(F.col("u").alias("vertex"), F.col("q").alias("value")).unionByName(rows.select(F.col("v").alias("vertex"), (-F.col("q")).alias("value")))
    return m, materialize(b.groupBy("vertex").agg(F.sum("value").alias("value"))), factorize(m, Config(backend=Backend.approximate()))


@_query(
    "q28_conjugate_gradients",
    f"""with recursive l as (select l_partkey p, l_suppkey + {_SHIFT} s from lineitem), e as (select distinct p a, s b from l union select distinct s, p from l),
    r(v) as (select min(a) from e union select e.b from r join e on e.a = r.v), n as (select count(distinct a) n from e)
    select n as vertices, cast(case when n = (select count(*) from r) then 1 end as bigint) as components, true as converged from n""",
)
def q28(spark, d):
    """Of ``part_supplier_system``: how many vertices, in how many components, and whether conjugate gradients converged.

    The SQL knows the number of components where the graph is connected.
    """
    m, b, factor = part_supplier_system(spark, d)
    found = pcg.conjugate_gradients(m, b, factor)
    components = factor.blocks.where("dim > 1").count() + (factor.large.graph.vertices.select("block").distinct().count() if factor.large else 0)
    counts = b.agg(F.count(F.lit(1)).alias("vertices"), F.lit(components).cast("long").alias("components"))
    return counts.withColumn("converged", F.lit(found.converged))


@_query(
    "q29_sampler_is_unbiased",
    f"""select o_custkey as "pivot", 16 * (count(*) - 1) as edges, {_sql_r("(sum(w) * sum(w) - sum(w * w)) / (2 * sum(w))", 6)} as weight, true as unbiased
    from (select o_custkey, power(2.0, o_orderkey % 4) w from orders) group by 1 having count(*) > 1""",
)
def q29(spark, d):
    """Of every customer's star: how many edges are drawn, and their weight, which is that of the expected clique.

    ``unbiased``: over all stars, weights that depend on the ends drawn deviate by 5 % at most from their expectation.
    """
    stars, k = _customer_stars(spark, d), 16
    drawn = materialize(sampling.sample_stars(stars.withColumnRenamed("pivot", "index"), 1, k))
    got = drawn.agg(F.sum(F.col("weight") * (1 + F.col("lo") % 5))).first()[0] or 0.0
    want = sampling.expected_weight(stars, 1 + F.col("lo") % 5).first()[0] or 0.0
    own = drawn.groupBy(F.col("index").alias("pivot")).agg(F.count(F.lit(1)).alias("edges"), _r(F.sum("weight"), 6).alias("weight"))
    return own.withColumn("unbiased", F.lit(abs(got - want) <= 0.05 * want))


@_query("q30_saved_factor", _ORDER_PATH + _CENTRED)
def q30(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/factor-{uuid.uuid4().hex}"
    factorize(_order_matrix(spark, d)).save(path)
    return _order_solution(spark, d, load(spark, path))


@_query("q31_rounds_on_paths", _ORDER_PATH + _CENTRED)
def q31(spark, d):
    """The distributed elimination, which is exact on forests."""
    o = _orders(spark, d)
    f = rounds.eliminate(ing.ingest(_order_matrix(spark, d), checked=False))
    x = f.solve(o.select(F.col("o_orderkey").alias("vertex"), F.col("b").alias("value")))
    return o.select(F.col("o_custkey").alias("blk"), F.col("o_orderkey").alias("vertex")).join(x, "vertex").select("blk", F.col("vertex").alias("v"), _r(F.col("value")).alias("x"))


@_query(
    "q32_split_edges",
    _EVENT_PATH + _CENTRED,
)
def q32(spark, d):
    """Edges split in three copies each: on paths nothing is sampled, so the answer stays exact."""
    e = _events(spark, d)
    x = factorize(_event_matrix(spark, d), Config(seed=7, split=3, backend=Backend.approximate())).solve(e.select(F.col("event_id").alias("vertex"), F.col("b").alias("value")))
    return e.select(F.col("user_id").alias("blk"), F.col("event_id").alias("vertex")).join(x, "vertex").select("blk", F.col("vertex").alias("v"), _r(F.col("value")).alias("x"))


@_query(
    "q33_bipartite_gradients",
    f"""with s as (select s_suppkey id, cast(cast(round(abs(s_acctbal)*100) as bigint) % 1000 as double) b from supplier),
    t as (select cast((select count(*) from nation) as double) n, cast(count(*) as double) m, sum(b) total from s),
    c as (select n, m, total / (n + m) mean, (total - m * total / (n + m)) / (n + m) sa from t)
    select 's' as k, cast(id as bigint) as id, {_sql_r("(b - mean - sa) / n")} as x from s, c
    union all select 'n', cast(n_nationkey as bigint), {_sql_r("(sa - mean) / m")} from nation, c""",
)
def q33(spark, d):
    """Every supplier joined to every nation: sampled elimination as a preconditioner, held against the closed form of the solution."""
    n, s = _t(spark, d, "nation"), _t(spark, d, "supplier")
    nn, size = _size(n, "n_nationkey"), _size(s, "s_suppkey")
    keys = F.array_sort(F.collect_list(F.col("n_nationkey").cast("long")))
    nations = n.agg(keys.alias("all")).first()["all"]  # the nations of the world
    edges = s.select((F.col("s_suppkey") + nn).cast("long").alias("u"), F.explode(F.array(*[F.lit(k).cast("long") for k in nations])).alias("v"), F.lit(1.0).alias("w"))
    rhs = s.select((F.col("s_suppkey") + nn).cast("long").alias("vertex"), (F.round(F.abs("s_acctbal") * 100) % 1000).cast("double").alias("value"))
    rhs = rhs.unionByName(n.select(F.col("n_nationkey").cast("long").alias("vertex"), F.lit(0.0).alias("value")))
    mean = rhs.agg(F.avg("value")).first()[0] or 0.0
    m = from_edges(edges, nn + size)
    factor = factorize(m, Config(backend=Backend.approximate()))
    found = pcg.conjugate_gradients(m, materialize(rhs.withColumn("value", F.col("value") - mean)), factor, 1e-12)
    at = F.when(F.col("vertex") < nn, F.col("vertex")).otherwise(F.col("vertex") - nn)
    return found.x.select(F.when(F.col("vertex") < nn, "n").otherwise("s").alias("k"), at.cast("long").alias("id"), _r(F.col("value")).alias("x"))
