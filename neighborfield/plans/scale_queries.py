"""Queries of the operators that divide work which others do in one task or over all pairs; registered beside the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neighborfield.operators import affinity, blocked, formats, grid, knn, linalg, lowrank, metric_tree, nbody, pencils, preprocess, separators, solvers, tree_forces
from neighborfield.params import EmbeddingParams
from neighborfield.plans import optimizer
from neighborfield.plans import queries as q
from neighborfield.plans.queries import _NODES, FATT, GRID, KN, PJ, E, P, Y, _file, _r, joint10, layout, points, query, rounded, trade
from neighborfield.sources import ranges, sinks
from neighborfield.tables import written

# grids by pencils

_Y4 = Y.replace(" FROM embeddings)", ", ((vec_id * vec_id * 17 + vec_id * 911) % 1019) / 50.0 AS y3 FROM embeddings)")


def layout4(s: SparkSession, d: str) -> DataFrame:
    i = F.col("i")
    return layout(s, d, 3).withColumn("y3", ((i * i * 17 + i * 911) % 1019) / 50.0)


_PHI3 = ", ".join(_r(f"phi{m}", f"phi{m}", 5) for m in range(4))
query("nuconv_3d_pencil", GRID(3, _NODES(4.0)) + f" SELECT i, {_PHI3} FROM r")(lambda s, d: rounded(pencils.nuconv_pencils(layout(s, d, 3), 4.0).select("i", *(f"phi{m}" for m in range(4))), 5))
_PHI4 = ", ".join(_r(f"phi{m}", f"phi{m}", 5) for m in range(5))
query("g2g_4d", GRID(4, "5").replace(Y, _Y4) + f" SELECT c0, c1, c2, c3, {_PHI4} FROM phi")(lambda s, d: rounded(pencils.convolve_pencils(grid.scatter(grid.stencil(grid.placed(grid.shift_to_origin(layout4(s, d)), nodes=5)))), 5))

# neighbours by a metric tree

query("knn_tree_k10", KN(10) + f" SELECT i, j, rank, {_r('d2', 'd2')} FROM k")(lambda s, d: rounded(metric_tree.tree_knn(points(s, d), 10, written, leaf=256)[0]))


def flat_points(s: SparkSession, d: str) -> DataFrame:
    """A layout without ties, as points of two components."""
    return layout(s, d).select("i", F.array(F.col("y0") + F.col("i") * 0.000137, F.col("y1") + F.col("i") * 0.000071).alias("x"))


_FLAT = Y + """, p AS (SELECT i, y0 + i * 0.000137::DOUBLE AS x0, y1 + i * 0.000071::DOUBLE AS x1 FROM y),
k AS (SELECT i, j, d2, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rank FROM (SELECT a.i, b.i AS j, (a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 AS d2 FROM p a JOIN p b ON a.i <> b.i))"""
query("knn_tree_layout_k10", _FLAT + f" SELECT i, j, rank, {_r('d2', 'd2')} FROM k WHERE rank <= 10")(lambda s, d: rounded(metric_tree.tree_knn(flat_points(s, d), 10, written, leaf=32)[0]))

# neighbours by other distances

_PAIR = "list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2]))"
_BY = {
    "cosine": "list_cosine_distance(a.x, b.x)",
    "correlation": "list_cosine_distance(list_transform(a.x, lambda v: v - list_avg(a.x)), list_transform(b.x, lambda v: v - list_avg(b.x)))",
    "cityblock": f"list_sum({_PAIR})",
    "chebychev": f"list_max({_PAIR})",
    "minkowski": "list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2]) ** 3)) ** (1 / 3.0)",
}
for _name, _value in _BY.items():
    query(f"knn_{_name}_k5", f"{P}, m AS (SELECT a.i, b.i AS j, ({_value}) ** 2 AS d2 FROM p a JOIN p b ON a.i <> b.i), k AS (SELECT i, j, d2, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rank FROM m) SELECT i, j, rank, {_r('d2', 'd2')} FROM k WHERE rank <= 5")(lambda s, d, n=_name: rounded(knn.metric_knn(points(s, d), 5, n)))

# a graph of customers and suppliers, which grows with the tables

_C = """e AS (SELECT o_custkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def bought(s: SparkSession, d: str) -> DataFrame:
    """The graph's edges, once for each line."""
    lines = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(orders, "l_orderkey").select(F.col("o_custkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("v"))


def purchases(s: SparkSession, d: str) -> DataFrame:
    return bought(s, d).groupBy("i", "j").agg(F.sum("v").alias("v"))


def accounts(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("x"))


_S = "x AS (SELECT s_suppkey AS i, s_acctbal AS x FROM supplier)"
query("spmv_purchases", f"{_C}, {_S} SELECT e.i, {_r('sum(v * x)', 'x', 2)} FROM e JOIN x ON e.j = x.i GROUP BY e.i")(lambda s, d: rounded(linalg.spmv(purchases(s, d), accounts(s, d)), 2))
query("spmv_min_plus_purchases", f"{_C}, {_S} SELECT e.i, {_r('min(v + x)', 'x', 2)} FROM e JOIN x ON e.j = x.i GROUP BY e.i")(lambda s, d: rounded(linalg.spmv(purchases(s, d), accounts(s, d), linalg.MIN_PLUS), 2))
query("stochastic_purchases", f"{_C} SELECT i, j, {_r('v / sum(v) OVER (PARTITION BY i)', 'v', 9)} FROM e")(lambda s, d: rounded(affinity.row_stochastic(purchases(s, d)), 9))
query("offsets_purchases", f"{_C}, g AS (SELECT i, count(*) AS n FROM e GROUP BY i) SELECT i, (sum(n) OVER (ORDER BY i) - n)::BIGINT AS start, n AS degree FROM g")(lambda s, d: rounded(formats.csr_offsets(purchases(s, d))))
query("gram_purchases", f"{_C} SELECT a.j AS i, b.j AS j, {_r('sum(a.v * b.v)', 'v', 2)} FROM e a JOIN e b ON a.i = b.i GROUP BY a.j, b.j")(lambda s, d: rounded(linalg.gram(bought(s, d)), 2))
query("toeplitz_line", f"x AS (SELECT vec_id AS i, (vec_id % 17)::DOUBLE AS x FROM embeddings) SELECT a.i AS i0, {_r('sum(b.x / (1 + abs(a.i - b.i)))', 'x', 4)} FROM x a, x b GROUP BY a.i")(lambda s, d: rounded(linalg.toeplitz_multiply(_lags(s, d), s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("i0"), (F.col("vec_id") % 17).cast("double").alias("x"))), 4))


def _lags(s: SparkSession, d: str) -> DataFrame:
    """1 / (1 + distance) for every distance of two of the table's ids."""
    ids = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id")
    return ids.select(F.explode(F.array_distinct(F.array("vec_id", -F.col("vec_id")))).alias("l0")).withColumn("v", 1 / (1 + F.abs("l0")))


# repulsion by a tree

_DEPTH = 7
_CELLS = f"""{Y}, o AS (SELECT i, y0 - (SELECT min(y0) FROM y) AS y0, y1 - (SELECT min(y1) FROM y) AS y1 FROM y), sp AS (SELECT greatest(max(y0), max(y1)) AS side FROM o),
c AS (SELECT i, y0, y1, side, least(floor(y0 / side * {1 << _DEPTH}), {(1 << _DEPTH) - 1})::BIGINT AS a, least(floor(y1 / side * {1 << _DEPTH}), {(1 << _DEPTH) - 1})::BIGINT AS b FROM o, sp),
t AS (SELECT level, a >> ({_DEPTH} - level) AS a, b >> ({_DEPTH} - level) AS b, count(*) AS n, sum(y0) AS s0, sum(y1) AS s1 FROM c, range({_DEPTH} + 1) AS l(level) GROUP BY ALL)"""


def _cells(s: SparkSession, d: str) -> DataFrame:
    """The tree's cells, by coordinates instead of codes."""
    place = lambda m: sum(F.shiftright("code", 2 * b + m).bitwiseAND(F.lit(1).cast("long")) * (1 << b) for b in range(_DEPTH))
    found = None
    for level, cells in enumerate(tree_forces.tree_cells(tree_forces.coded(layout(s, d), _DEPTH), _DEPTH, written)):
        own = cells.select(F.lit(level).alias("level"), place(0).alias("a"), place(1).alias("b"), "n", "s0", "s1")
        found = own if found is None else found.unionByName(own)
    return found


query("tree_cells_2d", f"{_CELLS} SELECT level::BIGINT AS level, a, b, n, {_r('s0', 's0')}, {_r('s1', 's1')} FROM t")(lambda s, d: rounded(_cells(s, d)))
_TREE = f"""WITH RECURSIVE {_CELLS},
f AS (SELECT c.i, c.y0, c.y1, c.a AS pa, c.b AS pb, side, t.level, t.a, t.b, n, s0, s1 FROM c, t WHERE t.level = 0
      UNION ALL SELECT f.i, f.y0, f.y1, f.pa, f.pb, f.side, t.level, t.a, t.b, t.n, t.s0, t.s1 FROM f JOIN t ON t.level = f.level + 1 AND t.a >> 1 = f.a AND t.b >> 1 = f.b
      WHERE NOT (f.n = 1 OR (f.side / (1 << f.level)) ** 2 < 0.25 * ((f.y0 - f.s0 / f.n) ** 2 + (f.y1 - f.s1 / f.n) ** 2))),
e AS (SELECT *, pa >> ({_DEPTH} - level) = a AND pb >> ({_DEPTH} - level) = b AS own FROM f
      WHERE n = 1 OR level = {_DEPTH} OR (side / (1 << level)) ** 2 < 0.25 * ((y0 - s0 / n) ** 2 + (y1 - s1 / n) ** 2)),
r AS (SELECT i, CASE WHEN own THEN n - 1 ELSE n END AS n, y0 - CASE WHEN own THEN (s0 - y0) / (n - 1) ELSE s0 / n END AS g0, y1 - CASE WHEN own THEN (s1 - y1) / (n - 1) ELSE s1 / n END AS g1 FROM e WHERE NOT (own AND n = 1)),
k AS (SELECT i, g0, g1, n, 1 / (1 + g0 * g0 + g1 * g1) AS q FROM r), z AS (SELECT sum(n * q) AS zeta FROM k),
h AS (SELECT i, sum(n * q * q * g0) / any_value(zeta) AS f0, sum(n * q * q * g1) / any_value(zeta) AS f1 FROM k, z GROUP BY i)"""
query("repulsive_tree_2d", f"{_TREE} SELECT i, {_r('f0', 'f0', 9)}, {_r('f1', 'f1', 9)} FROM h")(lambda s, d: rounded(tree_forces.repulsion_tree(layout(s, d), written, 0.5, _DEPTH), 9))

# n-body sums of several charges

_Q = ("i % 5 - 2.0", "sin(i)", "1.0")


def charged(s: SparkSession, d: str, dims: int) -> DataFrame:
    return layout(s, d, dims).withColumns({"q0": F.col("i") % 5 - 2.0, "q1": F.sin("i"), "q2": F.lit(1.0)})


def _direct(dims: int, kernel: str) -> str:
    d2 = " + ".join(f"(a.y{m} - b.y{m}) ** 2" for m in range(dims))
    charges = ", ".join(f"{c} AS q{k}" for k, c in enumerate(_Q))
    return f"{Y}, c AS (SELECT *, {charges} FROM y), d AS (SELECT a.i, b.q0, b.q1, b.q2, {d2} AS d2 FROM c a, c b), k AS (SELECT *, {kernel} AS k FROM d) SELECT i, {', '.join(_r(f'sum(k * q{m})', f'phi{m}', 3) for m in range(3))} FROM k GROUP BY i"


query("nbody_1d", _direct(1, "1 / (1 + d2)"))(lambda s, d: rounded(nbody.nbody(charged(s, d, 1), nbody.student_kernel(), 100, 9), 3))
query("nbody_2d", _direct(2, "(1 + d2 / 3.0) ** -4.0"))(lambda s, d: rounded(nbody.nbody(charged(s, d, 2), nbody.student_kernel(3, 2), 50, 9), 3))

# sparse systems

_L = E + ", w AS (SELECT i, j, v / 100.0 AS v FROM e WHERE i > j AND (i * 7 + j * 3) % 5 = 0), l AS (SELECT i, j, v FROM w UNION ALL SELECT n.i, n.i, 1 + coalesce(s, 0) FROM (SELECT n_nationkey::BIGINT AS i FROM nation) n LEFT JOIN (SELECT i, sum(v) AS s FROM w GROUP BY i) t ON n.i = t.i), c AS (SELECT n_nationkey::BIGINT AS i, (n_nationkey * 37 % 11 + 1)::DOUBLE AS x FROM nation)"


def lower(s: SparkSession, d: str) -> DataFrame:
    w = trade(s, d).filter("i > j and (i * 7 + j * 3) % 5 = 0").withColumn("v", F.col("v") / 100)
    diagonal = q.nation_vector(s, d).select("i").join(w.groupBy("i").agg(F.sum("v").alias("s")), "i", "left")
    return w.unionByName(diagonal.select("i", F.col("i").alias("j"), (1 + F.coalesce("s", F.lit(0.0))).alias("v")))


def _rounds(n: int, matrix: str, digits: int) -> str:
    """x by repeated substitution x = (c - rest x) / diagonal, n times; c (i, x) is the right side."""
    steps = "".join(
        f", x{k} AS MATERIALIZED (SELECT c.i, (c.x - coalesce(s, 0)) / m AS x FROM c JOIN (SELECT i, v AS m FROM {matrix} WHERE i = j) g ON c.i = g.i LEFT JOIN (SELECT {matrix}.i, sum(v * x) AS s FROM {matrix} JOIN x{k - 1} p ON {matrix}.j = p.i WHERE {matrix}.i <> j GROUP BY {matrix}.i) t ON c.i = t.i)"
        for k in range(1, n + 1)
    )
    return f", x0 AS (SELECT i, 0.0 AS x FROM c){steps} SELECT i, {_r('x', 'x', digits)} FROM x{n}"


query("solve_lower", _L + _rounds(25, "l", 8))(lambda s, d: rounded(solvers.solve_lower(lower(s, d), q.nation_vector(s, d).select("i", "x"), written), 8))
_A = PJ + ", a AS MATERIALIZED (SELECT i, j, -v AS v FROM pj WHERE i <> j UNION ALL SELECT i, i, 2 * sum(v) AS v FROM pj WHERE i <> j GROUP BY i), c AS (SELECT vec_id AS i, (vec_id % 13 - 6) / 500.0 AS x FROM embeddings)"


def laplacian(s: SparkSession, d: str) -> DataFrame:
    """Minus the joint weights, with twice a row's sum on the diagonal: symmetric and positive definite."""
    w = joint10(s, d).filter("i <> j")
    return w.withColumn("v", -F.col("v")).unionByName(w.groupBy("i").agg((2 * F.sum("v")).alias("v")).select("i", F.col("i").alias("j"), "v"))


def _solved(s: SparkSession, d: str) -> DataFrame:
    b = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("i"), ((F.col("vec_id") % 13 - 6) / 500.0).alias("x"))
    return rounded(solvers.solve_cg(laplacian(s, d), b, written, 1e-13)[0], 6)


query("solve_cg", _A + _rounds(50, "a", 6))(_solved)

# boxes as partitioner


@query("attractive_blocked", FATT + f" SELECT i, {_r('f0', 'f0', 9)}, {_r('f1', 'f1', 9)} FROM fa")
def _(s, d):
    y = layout(s, d)
    graph = blocked.block_graph(joint10(s, d), blocked.boxes(y, 64))
    try:
        return rounded(written(blocked.blocked_attraction(graph, y), "attraction"), 9)
    finally:
        graph.close()


# nested dissection


@query("dissection_check", "SELECT count(*) AS nodes, count(*) AS ranks, 0 AS least, count(*) - 1 AS most, 0 AS crossing FROM embeddings")
def _(s, d):
    """The order is one, and no edge joins the two halves of any round but through their separator."""
    graph = written(joint10(s, d), "graph")
    paths = written(separators.dissect(graph, written), "dissection")
    a, b = paths.select(F.col("node").alias("i"), F.col("path").alias("pi")), paths.select(F.col("node").alias("j"), F.col("path").alias("pj"))
    halves = F.exists(F.sequence(F.lit(1), F.lit(2)), lambda k: (F.substring("pi", F.lit(1), k - 1) == F.substring("pj", F.lit(1), k - 1)) & F.concat(F.substring("pi", k, F.lit(1)), F.substring("pj", k, F.lit(1))).isin("01", "10"))
    crossing = graph.join(a, "i").join(b, "j").filter(halves).agg(F.count("*").alias("crossing"))
    order = separators.order_of(paths).agg(F.count("old").alias("nodes"), F.count_distinct("new").alias("ranks"), F.min("new").alias("least"), F.max("new").alias("most"))
    return rounded(order.crossJoin(crossing))


query("dissection_order")(lambda s, d: separators.dissection_order(joint10(s, d), written))

# low rank

_NODE_COUNTS = (2, 3, 4, 5, 6)


def line(s: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    return s.read.parquet(f"{d}/embeddings.parquet").select(i.alias("i"), F.array(((i * 7919) % 1009) / 1009.0).alias("x"))


def _interpolated(n: int) -> str:
    spots = [k / (n - 1) for k in range(n)]
    basis = ", ".join(" * ".join(f"((x - {spots[m]!r}) / {spots[k] - spots[m]!r})" for m in range(n) if m != k) for k in range(n))
    return f"""SELECT {n} AS nodes, sqrt(sum((f - g) ** 2) / sum(f * f)) AS error FROM (WITH w AS (SELECT i, q, unnest([{basis}]) AS w, unnest({spots}) AS z FROM c),
s AS (SELECT z, sum(w * q) AS s FROM w GROUP BY z), t AS (SELECT a.z, sum(b.s / (1 + (a.z - b.z) ** 2)) AS p FROM s a, s b GROUP BY a.z) SELECT w.i, sum(w * p) AS g FROM w JOIN t USING (z) GROUP BY w.i) JOIN f USING (i)"""


_LINE = "c AS (SELECT vec_id AS i, ((vec_id * 7919) % 1009) / 1009.0::DOUBLE AS x, sin(10 * (((vec_id * 7919) % 1009) / 1009.0::DOUBLE)) + cos(2000 * (((vec_id * 7919) % 1009) / 1009.0::DOUBLE)) AS q FROM embeddings)"
query("lowrank_interpolation", f"{_LINE}, f AS (SELECT a.i, sum(b.q / (1 + (a.x - b.x) ** 2)) AS f FROM c a, c b GROUP BY a.i), u AS ({' UNION ALL '.join(map(_interpolated, _NODE_COUNTS))}) SELECT nodes::BIGINT AS nodes, {_r('error', 'error', 8)} FROM u")(
    lambda s, d: rounded(lowrank.interpolation_errors(line(s, d), line(s, d).select("i", (F.sin(10 * F.get("x", F.lit(0))) + F.cos(2000 * F.get("x", F.lit(0)))).alias("q")), lambda d2: 1 / (1 + d2), list(_NODE_COUNTS), 0.0, 1.0), 8)
)
query("lowrank_frobenius", f"{_LINE} SELECT {_r('sum((1 / (1 + (a.x - b.x) ** 2)) ** 2)', 'squares', 4)} FROM c a, c b")(lambda s, d: rounded(s.createDataFrame([(lowrank.frobenius(line(s, d), lambda d2: 1 / (1 + d2), written),)], "squares double"), 4))
query("lowrank_rank_errors")(lambda s, d: rounded(lowrank.rank_errors(line(s, d), lambda d2: 1 / (1 + d2), [1, 2, 3, 4, 5], written), 6))

# principal components, both ways

_NORMS = "SELECT i, {0} FROM (SELECT i, m, v - avg(v) OVER (PARTITION BY m) AS v FROM c) GROUP BY i"
_norms = lambda df: rounded(df.select("i", F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v).alias("norm2")))


def turned(s: SparkSession, d: str) -> DataFrame:
    """The table's components as points: fewer points than components."""
    return preprocess.turned(points(s, d))


query("pca_norms", f"{P}, c AS (SELECT i, unnest(x) AS v, unnest(range(len(x))) AS m FROM p) " + _NORMS.format(_r("sum(v * v)", "norm2")))(lambda s, d: _norms(preprocess.pca(points(s, d), 64)))
query("pca_dual_norms", f"{P}, c AS (SELECT i AS m, unnest(x) AS v, unnest(range(len(x))) AS i FROM p) " + _NORMS.format(_r("sum(v * v)", "norm2")))(lambda s, d: _norms(preprocess.pca_dual(turned(s, d), 64)))
query("gram", f"{P}, c AS (SELECT i AS m, unnest(x) AS v, unnest(range(len(x))) AS i FROM p), z AS (SELECT i, m, v - avg(v) OVER (PARTITION BY m) AS v FROM c) SELECT a.i AS a, b.i AS b, {_r('sum(a.v * b.v)', 's')} FROM z a JOIN z b ON a.m = b.m AND a.i <= b.i GROUP BY a.i, b.i")(lambda s, d: rounded(preprocess.gram(turned(s, d), 100)))

# files in parts


@query("source_binary_ranges", P + f" SELECT i, unnest(range(len(x))) AS m, {_r('unnest(x)', 'v')} FROM p")
def _(s, d):
    ranges.register(s)
    path = _file(s, "points") + ".dat"
    sinks.points_binary(points(s, d), path)
    return rounded(preprocess.components(s.read.format("binary_points").option("parts", 4).load(path)))


# the loop


def _loop(steps: int) -> str:
    out = PJ + ", " + Y + ", s0 AS (SELECT i, y0, y1, 0.0::DOUBLE AS u0, 0.0::DOUBLE AS u1, 1.0::DOUBLE AS g0, 1.0::DOUBLE AS g1 FROM y)"
    for k in range(1, steps + 1):
        gain = lambda m: f"greatest(CASE WHEN sign(d{m}) <> sign(u{m}) THEN g{m} + 0.2 ELSE g{m} * 0.8 END, 0.01)"
        out += f""", q{k} AS MATERIALIZED (SELECT a.i, b.i AS j, a.y0 - b.y0 AS h0, a.y1 - b.y1 AS h1, 1 / (1 + (a.y0 - b.y0) ** 2 + (a.y1 - b.y1) ** 2) AS q FROM s{k - 1} a JOIN s{k - 1} b ON a.i <> b.i),
z{k} AS (SELECT sum(q) AS zeta FROM q{k}), fr{k} AS (SELECT i, sum(q * q * h0) / any_value(zeta) AS f0, sum(q * q * h1) / any_value(zeta) AS f1 FROM q{k}, z{k} GROUP BY i),
fa{k} AS (SELECT pj.i, sum(pj.v * q * h0) AS f0, sum(pj.v * q * h1) AS f1 FROM pj JOIN q{k} e ON pj.i = e.i AND pj.j = e.j GROUP BY pj.i),
d{k} AS (SELECT s.i, s.y0, s.y1, u0, u1, g0, g1, 12.0 * coalesce(a.f0, 0) - r.f0 AS d0, 12.0 * coalesce(a.f1, 0) - r.f1 AS d1 FROM s{k - 1} s JOIN fr{k} r ON s.i = r.i LEFT JOIN fa{k} a ON s.i = a.i),
g{k} AS (SELECT i, y0, y1, u0, u1, d0, d1, {gain(0)} AS g0, {gain(1)} AS g1 FROM d{k}),
n{k} AS (SELECT i, y0 + 0.5 * u0 - 200 * g0 * d0 AS y0, y1 + 0.5 * u1 - 200 * g1 * d1 AS y1, 0.5 * u0 - 200 * g0 * d0 AS u0, 0.5 * u1 - 200 * g1 * d1 AS u1, g0, g1 FROM g{k}),
s{k} AS MATERIALIZED (SELECT i, y0 - avg(y0) OVER () AS y0, y1 - avg(y1) OVER () AS y1, u0, u1, g0, g1 FROM n{k})"""
    return out + f" SELECT i, {_r('y0', 'y0', 5)}, {_r('y1', 'y1', 5)} FROM s{steps}"


query("optimise_two_steps", _loop(2))(lambda s, d: rounded(optimizer.optimise(joint10(s, d), layout(s, d), EmbeddingParams(max_iter=2, repulsion="exact")), 5))
