"""One query for each operator of the embedding engine over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neighborfield.functions import kernels
from neighborfield.operators import affinity, forces, formats, grid, knn, linalg, preprocess
from neighborfield import tables
from neighborfield.plans import optimizer
from neighborfield.params import EmbeddingParams
from neighborfield.sources import readers, sinks, synthetic

DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("i"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a weighted graph: how many line items one's suppliers send to the other's customers."""
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    lines = read("lineitem", "l_orderkey", "l_suppkey").groupBy("l_orderkey", "l_suppkey").count()
    sides = lines.join(read("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    sides = sides.join(read("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return sides.groupBy(F.col("s_nationkey").cast("long").alias("i"), F.col("c_nationkey").cast("long").alias("j")).agg(F.sum("count").cast("double").alias("v"))


def layout(spark: SparkSession, sf_dir: str, d: int = 2) -> DataFrame:
    """A layout in closed form, the same for every engine."""
    i = F.col("vec_id")
    whole = [(i * 7919) % 1009, (i * i * 31 + i * 104729) % 1013, (i * i * i + i * 271) % 997]
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(i.alias("i"), *((whole[m] / 50.0).alias(f"y{m}") for m in range(d)))


def nation_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("i"), ((F.col("n_nationkey") * 37 % 11) + 1).cast("double").alias("x"), (F.col("n_nationkey") % 7).cast("double").alias("x2"))


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to so many digits behind the point, without minus zero."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c).cast("long").alias(c) if kind in ("int", "bigint") else F.col(c) for c, kind in df.dtypes))


def _r(text: str, name: str, digits: int = DIGITS) -> str:
    return f"round({text}, {digits}) + 0.0 AS {name}"


P = "p AS (SELECT vec_id AS i, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
D = P + ", d AS (SELECT a.i, b.i AS j, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM p a JOIN p b ON a.i <> b.i)"
E = """e AS (SELECT s_nationkey::BIGINT AS i, c_nationkey::BIGINT AS j, count(*)::DOUBLE AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
S = E + ", s AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM e)"
X = "x AS (SELECT n_nationkey::BIGINT AS i, ((n_nationkey * 37 % 11) + 1)::DOUBLE AS x, (n_nationkey % 7)::DOUBLE AS x2 FROM nation)"
Y = """y AS (SELECT vec_id AS i, ((vec_id * 7919) % 1009) / 50.0 AS y0, ((vec_id * vec_id * 31 + vec_id * 104729) % 1013) / 50.0 AS y1,
 ((vec_id * vec_id * vec_id + vec_id * 271) % 997) / 50.0 AS y2 FROM embeddings)"""
Q = Y + ", q AS (SELECT a.i, b.i AS j, a.y0 - b.y0 AS g0, a.y1 - b.y1 AS g1, 1 / (1 + (a.y0 - b.y0) ** 2 + (a.y1 - b.y1) ** 2) AS q FROM y a JOIN y b ON a.i <> b.i), z AS (SELECT sum(q) AS zeta FROM q)"
FREP = Q + ", fr AS (SELECT i, sum(q * q * g0) / any_value(zeta) AS f0, sum(q * q * g1) / any_value(zeta) AS f1 FROM q, z GROUP BY i)"


def KN(k: int) -> str:
    return D + f", k AS (SELECT i, j, rank, d2 FROM (SELECT i, j, d2, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rank FROM d) WHERE rank <= {k})"


#: Ten neighbours with Gaussian weights, stochastic rows, both directions, total 1: a graph with a short SQL definition.
PJ = KN(10) + ", g AS (SELECT i, j, exp(-0.05 * d2) AS v FROM k), w AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM g), b AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM w UNION ALL SELECT j, i, v FROM w) GROUP BY i, j), pj AS (SELECT i, j, v / (SELECT sum(v) FROM b) AS v FROM b)"


def joint10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affinity.joint(affinity.row_stochastic(affinity.fixed_beta(knn.exact_knn(points(spark, sf_dir), 10), 0.05)), tables.written)


FATT = PJ + ", " + Q + ", fa AS (SELECT pj.i, sum(pj.v * q.q * q.g0) AS f0, sum(pj.v * q.q * q.g1) AS f1 FROM pj JOIN q ON pj.i = q.i AND pj.j = q.j GROUP BY pj.i)"
GRAD = FATT + ", fr AS (SELECT i, sum(q * q * g0) / any_value(zeta) AS f0, sum(q * q * g1) / any_value(zeta) AS f1 FROM q, z GROUP BY i), dy AS (SELECT fr.i, 12.0 * coalesce(fa.f0, 0) - fr.f0 AS d0, 12.0 * coalesce(fa.f1, 0) - fr.f1 AS d1 FROM fr LEFT JOIN fa ON fr.i = fa.i)"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql if sql.lstrip().upper().startswith(("WITH", "SELECT")) else f"WITH {sql}"
        return f

    return add


def _u(seed: int, *keys: str | int) -> str:
    """The generators' U(0, 1) of integer keys."""
    m = synthetic.PRIME
    return f"((list_reduce([{', '.join(f'({k})::BIGINT' for k in (seed + 1, *keys, 11, 5, 2))}], lambda s, k: (((s + k * 7919 + 1) % {m}) * ((s + k * 104729 + 3) % {m})) % {m}) + 0.5)::DOUBLE / {m})"


def _gauss(seed: int, *keys: str | int) -> str:
    return f"(sqrt(-2 * ln({_u(2 * seed + 1, *keys)})) * cos(2 * pi() * {_u(2 * seed + 2, *keys)}))"


# neighbours and distances

for _k in (10, 90):
    query(f"knn_exact_k{_k}", KN(_k) + f" SELECT i, j, rank, {_r('d2', 'd2')} FROM k")(lambda s, d, k=_k: rounded(knn.exact_knn(points(s, d), k)))


@query("knn_relational_k5", KN(5) + f" SELECT i, j, rank, {_r('d2', 'd2')} FROM k")
def _(s, d):
    return rounded(knn.exact_knn(points(s, d), 5))


@query("dist_max_normalised", KN(10) + f" SELECT i, j, rank, {_r('d2 / (SELECT max(d2) FROM k)', 'd2')} FROM k")
def _(s, d):
    return rounded(affinity.max_normalised(knn.exact_knn(points(s, d), 10), tables.written))


def _metric(name: str, value: str, prepare=lambda p: p, extra: str = "") -> None:
    """Least, most and sum of a metric from each point to all others."""
    sql = P + extra + f", m AS (SELECT a.i, {value} AS m FROM p a JOIN p b ON a.i <> b.i) SELECT i, {_r('min(m)', 'least')}, {_r('max(m)', 'most')}, {_r('sum(m)', 'total', 4)} FROM m GROUP BY i"

    def run(s: SparkSession, d: str) -> DataFrame:
        own = knn.metric_summaries(prepare(points(s, d)), name)
        return own.select("i", *((F.round(c, digits) + 0.0).alias(c) for c, digits in (("least", DIGITS), ("most", DIGITS), ("total", 4))))

    query(f"metric_{name}", sql)(run)


_Z = "list_zip(a.x, b.x)"
_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
_metric("euclidean", f"sqrt(list_sum(list_transform({_Z}, lambda z: (z[1] - z[2]) * (z[1] - z[2]))))")
_metric("cityblock", f"list_sum(list_transform({_Z}, lambda z: abs(z[1] - z[2])))")
_metric("chebychev", f"list_max(list_transform({_Z}, lambda z: abs(z[1] - z[2])))")
_metric("minkowski", f"list_sum(list_transform({_Z}, lambda z: pow(abs(z[1] - z[2]), 3.0))) ** (1 / 3.0)")
_metric("cosine", f"1 - {_DOT('a.x', 'b.x')} / sqrt({_DOT('a.x', 'a.x')} * {_DOT('b.x', 'b.x')})")
_signs = lambda p: p.withColumn("x", F.transform("x", lambda v: F.floor(v * 8).cast("double")))
_SIGNS = "p0 AS (SELECT vec_id AS i, list_transform(embedding, lambda v: floor(v::DOUBLE * 8)) AS x FROM embeddings), "
_metric("hamming", f"len(list_filter({_Z}, lambda z: z[1] <> z[2]))::DOUBLE / len(a.x)", _signs)
_metric("jaccard", f"CASE WHEN len(list_filter({_Z}, lambda z: z[1] <> 0 OR z[2] <> 0)) = 0 THEN 0 ELSE len(list_filter({_Z}, lambda z: (z[1] <> 0 OR z[2] <> 0) AND z[1] <> z[2]))::DOUBLE / len(list_filter({_Z}, lambda z: z[1] <> 0 OR z[2] <> 0)) END", _signs)
for _n in ("metric_hamming", "metric_jaccard"):
    ORACLE_SQL[_n] = ORACLE_SQL[_n].replace(P, _SIGNS + "p AS (SELECT i, x FROM p0)")
_metric("correlation", f"1 - {_DOT('a.x', 'b.x')} / sqrt({_DOT('a.x', 'a.x')} * {_DOT('b.x', 'b.x')})")
ORACLE_SQL["metric_correlation"] = ORACLE_SQL["metric_correlation"].replace(P, "p AS (SELECT i, list_transform(x, lambda v: v - list_sum(x) / len(x)) AS x FROM (SELECT vec_id AS i, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings))")


_PARTS = "c AS (SELECT i, unnest(x) AS v, unnest(range(len(x))) AS m FROM p), st AS (SELECT m, avg(v) AS mean, stddev_samp(v) AS sd FROM c GROUP BY m)"
_metric("seuclidean", f"sqrt(list_sum(list_transform({_Z}, lambda z: (z[1] - z[2]) * (z[1] - z[2]))))")
ORACLE_SQL["metric_seuclidean"] = ORACLE_SQL["metric_seuclidean"].replace(P, f"p AS (WITH {P}, {_PARTS} SELECT i, list(v / sd ORDER BY c.m) AS x FROM c JOIN st ON c.m = st.m GROUP BY i)")
_metric("spearman", f"1 - {_DOT('a.x', 'b.x')} / sqrt({_DOT('a.x', 'a.x')} * {_DOT('b.x', 'b.x')})")
ORACLE_SQL["metric_spearman"] = ORACLE_SQL["metric_spearman"].replace(P, f"p AS (WITH {P}, c AS (SELECT i, unnest(x) AS v, unnest(range(len(x))) AS m FROM p), r AS (SELECT i, m, rank() OVER (PARTITION BY i ORDER BY v) + (count(*) OVER (PARTITION BY i, v) - 1) / 2.0 AS r FROM c) SELECT i, list(r - (SELECT 65 / 2.0) ORDER BY m) AS x FROM r GROUP BY i)")

# affinities

query("gaussian_affinity_fixed_beta", KN(10) + f" SELECT i, j, {_r('exp(-0.05 * d2)', 'v')} FROM k")(lambda s, d: rounded(affinity.fixed_beta(knn.exact_knn(points(s, d), 10), 0.05)))
query("row_stochastic", S + f" SELECT i, j, {_r('v', 'v')} FROM s")(lambda s, d: rounded(affinity.row_stochastic(trade(s, d))))
query("stochastic_row_count", E + " SELECT count(*) AS n_rows, count(*) FILTER (WHERE abs(s - 1) <= 1e-12) AS n_stochastic FROM (SELECT i, sum(v) AS s FROM e GROUP BY i)")(lambda s, d: affinity.stochastic_rows(trade(s, d)))
_HALF = "CASE WHEN abs(g) < 1e-5 THEN x WHEN g > 0 THEN CASE WHEN hi IS NULL THEN 2 * x ELSE (x + hi) / 2 END ELSE CASE WHEN lo IS NULL THEN x / 2 ELSE (x + lo) / 2 END END AS x, CASE WHEN abs(g) >= 1e-5 AND g > 0 THEN x ELSE lo END AS lo, CASE WHEN abs(g) >= 1e-5 AND g <= 0 THEN x ELSE hi END AS hi, abs(g) < 1e-5 AS done"
_GAP = "list_sum(list_transform(ds, lambda v: x * v * exp(-x * v))) / list_sum(list_transform(ds, lambda v: exp(-x * v))) + ln(list_sum(list_transform(ds, lambda v: exp(-x * v)))) - ln(30.0)"
PERP = "WITH RECURSIVE " + KN(90) + f""", a AS (SELECT i, list(d2 ORDER BY d2, j) AS ds FROM k GROUP BY i),
t AS (SELECT i, 0 AS step, 1.0::DOUBLE AS x, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, false AS done FROM a
 UNION ALL SELECT i, step + 1, {_HALF} FROM (SELECT t.i, step, x, lo, hi, done, {_GAP} AS g FROM t JOIN a ON t.i = a.i WHERE NOT done AND step < 200)),
beta AS (SELECT i, arg_max(x, step) AS beta FROM t GROUP BY i)"""
query("perplexity_beta", PERP + f" SELECT i, {_r('beta', 'beta')} FROM beta")(lambda s, d: rounded(affinity.perplexity(knn.exact_knn(points(s, d), 90), 30).select("i", "beta")))
query("perplexity_affinities", PERP + f", w AS (SELECT k.i, j, exp(-beta * d2) AS v FROM k JOIN beta ON k.i = beta.i) SELECT i, j, {_r('v / sum(v) OVER (PARTITION BY i)', 'v')} FROM w")(lambda s, d: rounded(affinity.perplexity_edges(knn.exact_knn(points(s, d), 90), 30)))
query("sigma_summary", PERP + f" SELECT {_r('avg(sqrt(1 / beta))', 'mean_sigma')}, {_r('min(sqrt(1 / beta))', 'min_sigma')}, {_r('max(sqrt(1 / beta))', 'max_sigma')} FROM beta")(lambda s, d: rounded(affinity.sigma_summary(affinity.perplexity(knn.exact_knn(points(s, d), 90), 30))))
_LGAP = "list_sum(list_transform(ds, lambda w: exp(-x * w))) - 5.0"
LAM = "WITH RECURSIVE " + S + f""", a AS (SELECT i, list(-ln(v) ORDER BY j) AS ds FROM s GROUP BY i),
t AS (SELECT i, 0 AS step, 1.0::DOUBLE AS x, -1000.0::DOUBLE AS lo, NULL::DOUBLE AS hi, false AS done FROM a
 UNION ALL SELECT i, step + 1, {_HALF} FROM (SELECT t.i, step, x, lo, hi, done, {_LGAP} AS g FROM t JOIN a ON t.i = a.i WHERE NOT done AND step < 100)),
sg AS (SELECT i, arg_max(x, step) AS sigma FROM t GROUP BY i), w AS (SELECT s.i, s.j, exp(sigma * ln(v)) AS v, sigma FROM s JOIN sg ON s.i = sg.i)"""
query("lambda_rescale", LAM + f" SELECT i, j, {_r('v / sum(v) OVER (PARTITION BY i)', 'v')}, {_r('sigma', 'sigma')} FROM w")(lambda s, d: rounded(affinity.lambda_rescale(affinity.row_stochastic(trade(s, d)), 5.0)))
_BOTH = "b AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM s UNION ALL SELECT j, i, v FROM s) GROUP BY i, j)"
for _name, _f, _t in (("sum", lambda e: affinity.symmetrise(e), "v"), ("half", lambda e: affinity.symmetrise(e, 0.5), "v / 2"), ("over_2n", lambda e: affinity.symmetrise_over_2n(e), "v / (2 * (SELECT count(DISTINCT i) FROM b))")):
    query(f"symmetrize_{_name}", f"{S}, {_BOTH} SELECT i, j, {_r(_t, 'v')} FROM b")(lambda s, d, f=_f: rounded(f(affinity.row_stochastic(trade(s, d)))))
query("joint_normalised", f"{S}, {_BOTH} SELECT i, j, {_r('v / (SELECT sum(v) FROM b)', 'v', 9)} FROM b")(lambda s, d: rounded(affinity.joint(affinity.row_stochastic(trade(s, d))), 9))
query("drop_diagonal", E + " SELECT i, j, v FROM e WHERE i <> j")(lambda s, d: affinity.drop_diagonal(trade(s, d)))
query("zero_diagonal", E + " SELECT i, j, CASE WHEN i = j THEN 0.0 ELSE v END AS v FROM e")(lambda s, d: affinity.zero_diagonal(trade(s, d)))
query("drop_leaves", E + ", u AS (SELECT * FROM e WHERE i < j) SELECT i, j, CASE WHEN count(*) OVER (PARTITION BY i) = 1 THEN 0.0 ELSE v END AS v FROM u")(lambda s, d: affinity.drop_leaves(trade(s, d).filter("i < j")))
query("realmin_floor", E + f" SELECT i, j, {_r('greatest(v - 100, 2.2250738585072014e-308)', 'v')} FROM e")(lambda s, d: rounded(affinity.at_least_realmin(trade(s, d).withColumn("v", F.col("v") - 100))))
query("entropy_rows", S + f" SELECT i, {_r('-sum(CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)', 'h')} FROM s GROUP BY i")(lambda s, d: rounded(affinity.row_stochastic(trade(s, d)).groupBy("i").agg((-F.sum(kernels.entropy_term(F.col("v")))).alias("h"))))

# formats

for _by, _n in (("i", "csr"), ("j", "csc")):
    query(f"{_n}_offsets", f"{E}, g AS (SELECT {_by}, count(*) AS degree FROM e GROUP BY {_by}) SELECT {_by}, coalesce(sum(degree) OVER (ORDER BY {_by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, degree FROM g")(lambda s, d, by=_by: formats.offsets(trade(s, d), by))
_POS = E + ", o AS (SELECT i, j, v, row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS pos FROM e)"
query("ell_part", _POS + " SELECT i, j, v, pos FROM o WHERE pos < 12")(lambda s, d: rounded(formats.ell_part(trade(s, d), 12)))
query("coo_tail", _POS + " SELECT i, j, v, pos FROM o WHERE pos >= 12")(lambda s, d: rounded(formats.coo_tail(trade(s, d), 12)))
query("ell_round_trip", _POS + " SELECT i, j, v FROM o WHERE pos < 12")(lambda s, d: formats.from_ell(formats.ell_arrays(trade(s, d), 12)))
query("row_stats", E + ", g AS (SELECT vec_id AS i, coalesce(n, 0) AS n FROM embeddings LEFT JOIN (SELECT i, count(*) AS n FROM e GROUP BY i) t ON vec_id = t.i) SELECT min(n) AS min_nnz, max(n) AS max_nnz, floor(avg(n))::BIGINT AS avg_nnz, " + _r("stddev_pop(n)", "sd_nnz") + " FROM g")(lambda s, d: rounded(formats.row_stats(trade(s, d), points(s, d))))
_BLK = E + ", g AS (SELECT i >> 2 AS br, j >> 2 AS bc, count(*) AS nnz FROM e GROUP BY 1, 2)"
query("block_stats", _BLK + " SELECT count(*) AS n_blocks, min(nnz) AS min_nnz, max(nnz) AS max_nnz, " + _r("avg(nnz)", "avg_nnz") + ", " + _r("stddev_pop(nnz)", "sd_nnz") + " FROM g")(lambda s, d: rounded(formats.block_stats(trade(s, d), 2)))
query("block_imbalance", _BLK + ", r AS (SELECT br, sum(nnz) AS n FROM g GROUP BY br) SELECT " + _r("max(n) / avg(n)", "imbalance") + " FROM r")(lambda s, d: rounded(formats.block_imbalance(trade(s, d), 2)))
query("degree_histogram", "g AS (SELECT l_orderkey, count(*)::DOUBLE AS n FROM lineitem GROUP BY l_orderkey) SELECT CASE WHEN n < 0 THEN 0 WHEN n >= 8 THEN 5 ELSE floor(n / 2.0) + 1 END::BIGINT AS bin, count(*) AS n FROM g GROUP BY 1")(lambda s, d: formats.histogram(s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").alias("c")), "c", 0.0, 8.0, 4))
query("sum_duplicates", "SELECT l_suppkey AS i, l_linenumber::BIGINT AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2")(lambda s, d: formats.sum_duplicates(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("long").alias("j"), F.col("l_quantity").alias("v"))))
query("permute", E + " SELECT (i * 7) % 25 AS i, (j * 7) % 25 AS j, v FROM e")(lambda s, d: formats.permute(trade(s, d), s.range(25).select(F.col("id").alias("old"), (F.col("id") * 7 % 25).alias("new"))))
query("upper_triangle", E + " SELECT i, j, v FROM e WHERE i <= j")(lambda s, d: formats.upper(trade(s, d)))
query("band", E + " SELECT i, j, v FROM e WHERE abs(i - j) <= 3")(lambda s, d: formats.band(trade(s, d), 3))
query("circulant_test", E + ", g AS (SELECT ((j - i) % 25 + 25) % 25 AS w, min(v) AS lo, max(v) AS hi, count(*) AS n FROM e WHERE v <> 0 GROUP BY 1) SELECT bool_and(lo = hi AND n = 25) AS circulant FROM g")(lambda s, d: formats.is_circulant(trade(s, d), 25))
query("degree_order", "e2 AS (SELECT l_suppkey AS i, l_linenumber AS j, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT i, sum(n) AS degree FROM e2 GROUP BY i) SELECT i AS old, row_number() OVER (ORDER BY degree, i) - 1 AS new FROM g")(lambda s, d: formats.similar_order(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("i"))))
query("morton_codes", "SELECT vec_id AS i, " + " + ".join(f"(((((vec_id * 7919) % 1009) >> {b}) & 1) << {2 * b}) + (((((vec_id * vec_id * 31 + vec_id * 104729) % 1013) >> {b}) & 1) << {2 * b + 1})" for b in range(10)) + " AS code FROM embeddings")(lambda s, d: layout(s, d).select("i", kernels.morton([F.round(F.col("y0") * 50), F.round(F.col("y1") * 50)], 10).alias("code")))

# products

query("spmv", f"{E}, {X} SELECT e.i, sum(v * x) AS x FROM e JOIN x ON e.j = x.i GROUP BY e.i")(lambda s, d: linalg.spmv(trade(s, d), nation_vector(s, d)))
query("spmv_accumulate", f"{E}, {X} SELECT i, sum(x) AS x FROM (SELECT e.i, v * x AS x FROM e JOIN x ON e.j = x.i UNION ALL SELECT i, x FROM x) GROUP BY i")(lambda s, d: linalg.spmv(trade(s, d), nation_vector(s, d), y=nation_vector(s, d)))
query("spmv_transpose", f"{E}, {X} SELECT e.j AS i, sum(v * x) AS x FROM e JOIN x ON e.i = x.i GROUP BY e.j")(lambda s, d: linalg.spmv_transposed(trade(s, d), nation_vector(s, d)))
query("spmv_minplus", f"{E}, {X} SELECT e.i, min(v + x) AS x FROM e JOIN x ON e.j = x.i GROUP BY e.i")(lambda s, d: linalg.spmv(trade(s, d), nation_vector(s, d), linalg.MIN_PLUS))
query("spmv_pattern", f"{E}, {X} SELECT e.i, sum(x) AS x FROM e JOIN x ON e.j = x.i GROUP BY e.i")(lambda s, d: linalg.spmv(trade(s, d), nation_vector(s, d), linalg.PATTERN))
query("spmv_symmetric", f"{E}, {X}, u AS (SELECT i, j, v FROM e WHERE i <= j), f AS (SELECT i, j, v FROM u UNION ALL SELECT j, i, v FROM u WHERE i <> j) SELECT f.i, sum(v * x) AS x FROM f JOIN x ON f.j = x.i GROUP BY f.i")(lambda s, d: linalg.spmv_symmetric(formats.upper(trade(s, d)), nation_vector(s, d)))
query("spmm", f"{E}, {X} SELECT e.i, sum(v * x) AS x, sum(v * x2) AS x2 FROM e JOIN x ON e.j = x.i GROUP BY e.i")(lambda s, d: linalg.spmm(trade(s, d), nation_vector(s, d), ["x", "x2"]))
query("matrix_multiply", f"{E} SELECT a.i, b.j, sum(a.v * b.v) AS v FROM e a JOIN e b ON a.j = b.i GROUP BY a.i, b.j")(lambda s, d: linalg.multiply(trade(s, d), trade(s, d)))
query("matrix_add", f"{E} SELECT i, j, sum(v) AS v FROM (SELECT i, j, 2 * v AS v FROM e UNION ALL SELECT j, i, -v FROM e) GROUP BY i, j")(lambda s, d: linalg.add(trade(s, d), formats.transpose(trade(s, d)), 2.0, -1.0))
query("one_norm", f"{E} SELECT max(s) AS norm1 FROM (SELECT j, sum(abs(v)) AS s FROM e GROUP BY j)")(lambda s, d: linalg.one_norm(trade(s, d)))
query("drop_below", f"{E} SELECT i, j, v FROM e WHERE abs(v) > 90")(lambda s, d: linalg.drop_below(trade(s, d), 90.0))
for _axis, _by in ((1, "i"), (0, "j")):
    query(f"reduce_axis{_axis}", f"{E} SELECT {_by}, 0.5 * sum(v) AS s FROM e GROUP BY {_by}")(lambda s, d, a=_axis: linalg.reduce_axis(trade(s, d), a, 0.5))
    query(f"divide_axis{_axis}", f"{E} SELECT i, j, {_r(f'v / sum(v) OVER (PARTITION BY {_by})', 'v')} FROM e")(lambda s, d, a=_axis: rounded(linalg.divide_axis(trade(s, d), linalg.reduce_axis(trade(s, d), a), a)))

_LAGS = "g AS (SELECT range - 24 AS lag, 1 / (1 + (range - 24) ** 2 / 9.0) + (range - 24) / 50.0 AS v FROM range(49))"


def lags(spark: SparkSession) -> DataFrame:
    lag = F.col("id") - 24
    return spark.range(49).select(lag.alias("lag"), (1 / (1 + lag * lag / 9.0) + lag / 50.0).alias("v"))


query("toeplitz_edges", f"{_LAGS} SELECT a.range AS i, b.range AS j, {_r('v', 'v')} FROM range(25) a, range(25) b, g WHERE lag = a.range - b.range")(lambda s, d: rounded(linalg.toeplitz_edges(lags(s), 25)))
query("toeplitz_multiply", f"{X}, {_LAGS} SELECT a.i AS i0, {_r('sum(v * b.x)', 'x')} FROM x a, x b, g WHERE lag = a.i - b.i GROUP BY a.i")(lambda s, d: rounded(linalg.toeplitz_multiply(lags(s).withColumnRenamed("lag", "l0"), nation_vector(s, d).select(F.col("i").alias("i0"), "x"))))
query("block_toeplitz_multiply", f"{X} SELECT a.i // 5 AS i0, a.i % 5 AS i1, {_r('sum(b.x / (1 + (a.i // 5 - b.i // 5) ** 2 + abs(a.i % 5 - b.i % 5)))', 'x')} FROM x a, x b GROUP BY a.i")(
    lambda s, d: rounded(linalg.toeplitz_multiply(s.range(81).select(F.expr("id div 9 - 4").alias("l0"), F.expr("id % 9 - 4").alias("l1")).withColumn("v", 1 / (1 + F.col("l0") * F.col("l0") + F.abs("l1"))), nation_vector(s, d).select(F.expr("i div 5").alias("i0"), F.expr("i % 5").alias("i1"), "x")))
)

# forces and the optimiser's step

query("center_mean", f"{Y} SELECT i, {_r('y0 - (SELECT avg(y0) FROM y)', 'y0')}, {_r('y1 - (SELECT avg(y1) FROM y)', 'y1')} FROM y")(lambda s, d: rounded(grid.centre(layout(s, d))))
query("shift_min", f"{Y} SELECT i, {_r('y0 - (SELECT min(y0) FROM y)', 'y0')}, {_r('y1 - (SELECT min(y1) FROM y)', 'y1')} FROM y")(lambda s, d: rounded(grid.shift_to_origin(layout(s, d))))
query("attractive", FATT + f" SELECT i, {_r('f0', 'f0', 9)}, {_r('f1', 'f1', 9)} FROM fa")(lambda s, d: rounded(forces.attraction(joint10(s, d), layout(s, d)), 9))
query("attractive_times4", FATT + f" SELECT i, {_r('4 * f0', 'f0', 9)}, {_r('4 * f1', 'f1', 9)} FROM fa")(lambda s, d: rounded(forces.attraction(joint10(s, d), layout(s, d), 4.0), 9))
query("repulsive_exact", FREP + f" SELECT i, {_r('f0', 'f0', 9)}, {_r('f1', 'f1', 9)} FROM fr")(lambda s, d: rounded(forces.repulsion(layout(s, d), tables.written), 9))
query("zeta", Q + f" SELECT {_r('zeta', 'zeta', 4)} FROM z")(lambda s, d: rounded(forces.zeta_from_pairs(forces.kernel_sums(layout(s, d))), 4))
query("zeta_identity", Q + f" SELECT {_r('zeta', 'zeta', 4)} FROM z")(lambda s, d: rounded(forces.zeta_from_phi(forces.kernel_sums(layout(s, d))), 4))


@query("kl_cost", FATT + f" SELECT {_r('sum(12 * pj.v * ln((12 * pj.v + 1.1754943508222875e-38) / (q.q / zeta + 1.1754943508222875e-38)))', 'kl')} FROM pj JOIN q ON pj.i = q.i AND pj.j = q.j, z")
def _(s, d):
    y = layout(s, d)
    return rounded(forces.kl_cost(joint10(s, d), y, forces.zeta_from_pairs(forces.kernel_sums(y)), 12.0))


@query("kl_dense", FATT + f" SELECT {_r('sum(pj.v * ln(pj.v)) - sum(pj.v * ln(q.q / zeta))', 'kl')} FROM pj JOIN q ON pj.i = q.i AND pj.j = q.j, z")
def _(s, d):
    y = layout(s, d)
    return rounded(forces.dense_kl(joint10(s, d), y, forces.zeta_from_pairs(forces.kernel_sums(y))))


def _gradient(s: SparkSession, d: str) -> DataFrame:
    return optimizer.step_gradient(joint10(s, d), layout(s, d), EmbeddingParams(repulsion="exact"), 12.0)


query("gradient_step", GRAD + f" SELECT i, {_r('d0', 'd0', 9)}, {_r('d1', 'd1', 9)} FROM dy")(lambda s, d: rounded(_gradient(s, d), 9))
_UP = ", n AS (SELECT dy.i, y0 - 200 * {g0} * d0 AS y0, y1 - 200 * {g1} * d1 AS y1, -200 * {g0} * d0 AS u0, -200 * {g1} * d1 AS u1, {g0} AS g0, {g1} AS g1 FROM dy JOIN y ON dy.i = y.i)".format(g0="CASE WHEN sign(d0) <> 0 THEN 1.2::DOUBLE ELSE 0.8::DOUBLE END", g1="CASE WHEN sign(d1) <> 0 THEN 1.2::DOUBLE ELSE 0.8::DOUBLE END")
query("update_step", GRAD + _UP + f" SELECT i, {_r('y0 - (SELECT avg(y0) FROM n)', 'y0')}, {_r('y1 - (SELECT avg(y1) FROM n)', 'y1')}, {_r('u0', 'u0')}, {_r('u1', 'u1')}, {_r('g0', 'g0')}, {_r('g1', 'g1')} FROM n")(lambda s, d: rounded(optimizer.update(optimizer.start_state(layout(s, d)), _gradient(s, d), EmbeddingParams(), 0.5)))
query("gradient_norm", GRAD + f" SELECT {_r('max(abs(d0) + abs(d1))', 'norm', 9)} FROM dy")(lambda s, d: rounded(_gradient(s, d).agg(F.max(F.abs("d0") + F.abs("d1")).alias("norm")), 9))

# the grid

_SIZES = "[" + ", ".join(map(str, kernels.FAST_GRID_SIZES)) + "]"


def GRID(d: int, nodes: str) -> str:
    """Cells, weights, charges and potentials in SQL: o at the origin, t places, w stencil rows, v cells, phi potentials, r back at the points."""
    dims = range(d)
    shift = ", ".join(f"y{m} - (SELECT min(y{m}) FROM y) AS y{m}" for m in dims)
    most = "greatest(" + ", ".join(f"max(y{m})" for m in dims) + ")"
    weight = lambda x: f"[((-(1 + {x}) / 6 + 1) * (1 + {x}) - 11 / 6.0) * (1 + {x}) + 1, ((0.5 * {x} - 1) * {x} - 0.5) * {x} + 1, ((0.5 * (1 - {x}) - 1) * (1 - {x}) - 0.5) * (1 - {x}) + 1, ((-(2 - {x}) / 6 + 1) * (2 - {x}) - 11 / 6.0) * (2 - {x}) + 1]"
    places = ", ".join(f"least(y{m} / most, 1 - 2.220446049250313e-16) * (nodes - 1) AS t{m}" for m in dims)
    cells = ", ".join(f"floor(t{m})::BIGINT + k{m}.range AS c{m}" for m in dims)
    product = " * ".join(f"w{m}[k{m}.range + 1]" for m in dims)
    ks = ", ".join(f"range(4) k{m}" for m in dims)
    by = ", ".join(f"c{m}" for m in dims)
    charges = ", ".join(["sum(w) AS q0", *(f"sum(w * y{m}) AS q{m + 1}" for m in dims)])
    d2 = " + ".join(f"((a.c{m} - b.c{m}) * a.step) ** 2" for m in dims)
    kernel = f"1 / ((1 + {d2}) * (1 + {d2}))"
    return f"""{Y}, o AS (SELECT i, {shift} FROM y), sp AS (SELECT {most} AS most FROM o), sz AS (SELECT most, {nodes} AS nodes FROM sp),
g AS (SELECT most, nodes, most / (nodes - 1 - 2.220446049250313e-16) AS step FROM sz), t AS (SELECT i, {", ".join(f"y{m}" for m in dims)}, step, {places} FROM o, g),
l AS (SELECT *, {", ".join(f"{weight(f'(t{m} - floor(t{m}))')} AS w{m}" for m in dims)} FROM t),
w AS (SELECT i, {", ".join(f"y{m}" for m in dims)}, step, {cells}, {product} AS w FROM l, {ks}), v AS (SELECT {by}, any_value(step) AS step, {charges} FROM w GROUP BY {by}),
phi AS (SELECT {", ".join(f"a.c{m}" for m in dims)}, {", ".join(f"sum({kernel} * b.q{m}) AS phi{m}" for m in range(d + 1))} FROM v a, v b GROUP BY {", ".join(f"a.c{m}" for m in dims)}),
r AS (SELECT i, {", ".join(f"any_value(y{m}) AS y{m}" for m in dims)}, {", ".join(f"sum(w * phi{m}) AS phi{m}" for m in range(d + 1))} FROM w JOIN phi USING ({by}) GROUP BY i)"""


_NODES = lambda h: f"list_filter({_SIZES}, lambda s: s >= greatest(ceil(most / {h}), 14) + 2)[1] - 2"
query("grid_size", GRID(2, _NODES(0.7)) + f" SELECT nodes::BIGINT AS nodes, {_r('step', 'step')} FROM g")(lambda s, d: rounded(grid.placed(grid.shift_to_origin(layout(s, d)), 0.7).select("nodes", "step").distinct()))
query("grid_places", GRID(2, _NODES(0.7)) + f" SELECT i, {_r('t0', 't0')}, {_r('t1', 't1')} FROM t")(lambda s, d: rounded(grid.placed(grid.shift_to_origin(layout(s, d)), 0.7).select("i", "t0", "t1")))
query("lagrange_weights", GRID(1, _NODES(0.5)) + f" SELECT i, {', '.join(_r(f'w0[{k}]', f'w{k}') for k in range(1, 5))} FROM l")(lambda s, d: rounded(grid.placed(grid.shift_to_origin(layout(s, d, 1)), 0.5).select("i", kernels.lagrange_weights(F.col("t0") - F.floor("t0")).alias("w")).select("i", *(F.get("w", F.lit(k)).alias(f"w{k + 1}") for k in range(4)))))
_KEYS = lambda x: [f"((-0.5 * (1 + {x}) + 2.5) * (1 + {x}) - 4) * (1 + {x}) + 2", f"(1.5 * {x} - 2.5) * {x} * {x} + 1", f"(1.5 * (1 - {x}) - 2.5) * (1 - {x}) * (1 - {x}) + 1", f"((-0.5 * (2 - {x}) + 2.5) * (2 - {x}) - 4) * (2 - {x}) + 2"]
query("keys_weights", GRID(1, _NODES(0.5)) + f" SELECT i, {', '.join(_r(w, f'w{k}') for k, w in enumerate(_KEYS('(t0 - floor(t0))'), 1))} FROM t")(lambda s, d: rounded(grid.placed(grid.shift_to_origin(layout(s, d, 1)), 0.5).select("i", kernels.keys_weights(F.col("t0") - F.floor("t0")).alias("w")).select("i", *(F.get("w", F.lit(k)).alias(f"w{k + 1}") for k in range(4)))))
for _d, _h in ((1, 0.5), (2, 0.7), (3, 4.0)):
    _cells = ", ".join(f"c{m}" for m in range(_d))
    _qs, _ps = ", ".join(_r(f"q{m}", f"q{m}") for m in range(_d + 1)), ", ".join(_r(f"phi{m}", f"phi{m}", 5) for m in range(_d + 1))
    query(f"s2g_{_d}d", GRID(_d, _NODES(_h)) + f" SELECT {_cells}, {_qs} FROM v")(lambda s, d, n=_d, h=_h: rounded(grid.scatter(grid.stencil(grid.placed(grid.shift_to_origin(layout(s, d, n)), h))).drop("nodes", "step")))
    query(f"g2g_{_d}d", GRID(_d, _NODES(_h)) + f" SELECT {_cells}, {_ps} FROM phi")(lambda s, d, n=_d, h=_h: rounded(grid.convolve(grid.scatter(grid.stencil(grid.placed(grid.shift_to_origin(layout(s, d, n)), h)))), 5))
    query(f"nuconv_{_d}d", GRID(_d, _NODES(_h)) + f" SELECT i, {', '.join(_r(f'y{m}', f'y{m}') for m in range(_d))}, {_ps} FROM r")(lambda s, d, n=_d, h=_h: rounded(rounded(grid.nuconv(layout(s, d, n), h, fft=True), 5).withColumns({f"y{m}": F.round(f"y{m}", 6) for m in range(n)}), 6))
_ZG = ", zg AS (SELECT sum((1 + 2 * (y0 * y0 + y1 * y1)) * phi0 - 2 * (y0 * phi1 + y1 * phi2)) - count(*) AS zeta FROM r), fg AS (SELECT i, (y0 * phi0 - phi1) / zeta AS f0, (y1 * phi0 - phi2) / zeta AS f1 FROM r, zg)"
query("repulsive_grid_2d", GRID(2, _NODES(0.7)) + _ZG + f" SELECT i, {_r('f0', 'f0', 8)}, {_r('f1', 'f1', 8)} FROM fg")(lambda s, d: rounded(grid.repulsion_grid(layout(s, d), 0.7), 8))
query("repulsive_grid_fft_2d", GRID(2, _NODES(0.7)) + _ZG + f" SELECT i, {_r('f0', 'f0', 8)}, {_r('f1', 'f1', 8)} FROM fg")(lambda s, d: rounded(grid.repulsion_grid(layout(s, d), 0.7, fft=True), 8))
query("force_error", GRID(2, _NODES(0.7)) + _ZG + ", " + FREP[len(Y) + 2 :] + f", er AS (SELECT sqrt(sum((fg.f0 - fr.f0) ** 2 + (fg.f1 - fr.f1) ** 2) / sum(fr.f0 ** 2 + fr.f1 ** 2)) AS error FROM fg JOIN fr ON fg.i = fr.i) SELECT {_r('error', 'error')}, {_r('log10(error)', 'log10_error')} FROM er")(lambda s, d: rounded(forces.relative_error(grid.repulsion_grid(layout(s, d), 0.7), forces.repulsion(layout(s, d)))))
def _shifted(turn: int, shifts: int = 2, nodes: int = 24) -> str:
    """Potentials on the grid that is moved by a part of a cell: GRID with moved points instead of those at the origin."""
    whole = GRID(2, str(nodes + 1))
    rest = whole[whole.index(", sp AS (") :]
    part = f"st * {turn} / {shifts + 1}.0"
    return f"""(WITH st AS (SELECT greatest(max(y0), max(y1)) / ({nodes} - 1) AS st FROM o0), o AS (SELECT i, y0 + {part} AS y0, y1 + {part} AS y1 FROM o0, st){rest}
SELECT i, phi0, phi1 - phi0 * {part} AS phi1, phi2 - phi0 * {part} AS phi2 FROM r, st)"""


_ORIGIN = Y + ", o0 AS (SELECT i, y0 - (SELECT min(y0) FROM y) AS y0, y1 - (SELECT min(y1) FROM y) AS y1 FROM y)"
_MEANS = ", ".join(_r(f"avg(phi{m})", f"phi{m}", 5) for m in range(3))
query("shifted_grids", _ORIGIN + ", u AS (" + " UNION ALL ".join(map(_shifted, range(3))) + f") SELECT o0.i, {_r('any_value(y0)', 'y0', 5)}, {_r('any_value(y1)', 'y1', 5)}, {_MEANS} FROM o0 JOIN u ON o0.i = u.i GROUP BY o0.i")(lambda s, d: rounded(grid.shifted_average(layout(s, d), 2, 24), 5))
_SPOTS = [(2 * k + 1) / 6 for k in range(3)]
_BASIS = lambda x: "[" + ", ".join(" * ".join(f"(({x} - {_SPOTS[m]!r}) / {_SPOTS[k] - _SPOTS[m]!r})" for m in range(3) if m != k) for k in range(3)) + "]"
_BOX = _ORIGIN + f""", st AS (SELECT (most + 2.220446049250313e-16) / boxes AS step, boxes FROM (SELECT greatest(max(y0), max(y1)) AS most, greatest(50, least(240, ceil(greatest(max(y0), max(y1))))) AS boxes FROM o0)),
b AS (SELECT i, y0, y1, step, least(floor(y0 / step), boxes - 1)::BIGINT AS b0, least(floor(y1 / step), boxes - 1)::BIGINT AS b1 FROM o0, st),
l AS (SELECT *, {_BASIS('(y0 / step - b0)')} AS w0, {_BASIS('(y1 / step - b1)')} AS w1 FROM b),
w AS (SELECT i, y0, y1, step / 3 AS step, b0 * 3 + k0.range AS c0, b1 * 3 + k1.range AS c1, w0[k0.range + 1] * w1[k1.range + 1] AS w FROM l, range(3) k0, range(3) k1),
v AS (SELECT c0, c1, any_value(step) AS step, sum(w) AS q0, sum(w * y0) AS q1, sum(w * y1) AS q2 FROM w GROUP BY c0, c1),
k AS (SELECT a.c0, a.c1, b.q0, b.q1, b.q2, 1 / (1 + ((a.c0 - b.c0) * a.step) ** 2 + ((a.c1 - b.c1) * a.step) ** 2) ** 2 AS k FROM v a, v b),
phi AS (SELECT c0, c1, sum(k * q0) AS phi0, sum(k * q1) AS phi1, sum(k * q2) AS phi2 FROM k GROUP BY c0, c1),
r AS (SELECT i, any_value(y0) AS y0, any_value(y1) AS y1, sum(w * phi0) AS phi0, sum(w * phi1) AS phi1, sum(w * phi2) AS phi2 FROM w JOIN phi USING (c0, c1) GROUP BY i)"""
query("box_interpolation_2d", _BOX + " SELECT i, " + ", ".join(_r(c, c, 5) for c in ("y0", "y1", "phi0", "phi1", "phi2")) + " FROM r")(lambda s, d: rounded(grid.box_interpolation(layout(s, d)), 5))
for _d, _h in ((1, 0.5), (2, 0.7), (3, 4.0)):
    _ps = ", ".join(_r(f"phi{m}", f"phi{m}", 5) for m in range(_d + 1))
    query(f"nuconv_unpadded_{_d}d", GRID(_d, _NODES(_h)) + f" SELECT i, {_ps} FROM r")(lambda s, d, n=_d, h=_h: rounded(grid.nuconv(layout(s, d, n), h, fft=True, padded=False).select("i", *(f"phi{m}" for m in range(n + 1))), 5))
_CODE = lambda b: " + ".join(f"(((floor(y0 / most * {(1 << b) - 1})::BIGINT >> {k}) & 1) << {2 * k}) + (((floor(y1 / most * {(1 << b) - 1})::BIGINT >> {k}) & 1) << {2 * k + 1})" for k in range(b))
query("grid_bins", f"{_ORIGIN}, c AS (SELECT {_CODE(4)} AS code FROM o0, (SELECT greatest(max(y0), max(y1)) AS most FROM o0)), g AS (SELECT code, count(*) AS n FROM c GROUP BY code) SELECT code, (sum(n) OVER (ORDER BY code) - n)::BIGINT AS start, n AS count FROM g")(lambda s, d: preprocess.bins(layout(s, d), 4))

# preparation

query("standardize", f"{P}, {_PARTS} SELECT i, c.m, {_r('CASE WHEN sd > 0 THEN (v - mean) / sd ELSE 0 END', 'v')} FROM c JOIN st ON c.m = st.m")(lambda s, d: rounded(preprocess.components(preprocess.standardise(points(s, d)))))
query("minmax_center", f"{P}, c AS (SELECT i, unnest(x) AS v, unnest(range(len(x))) AS m FROM p), r AS (SELECT min(v) AS lo, max(v) AS hi FROM c), n AS (SELECT i, m, (v - lo) / (hi - lo) AS v FROM c, r) SELECT i, m, {_r('v - avg(v) OVER (PARTITION BY m)', 'v')} FROM n")(lambda s, d: rounded(preprocess.components(preprocess.minmax_centre(points(s, d)))))
query("pca_cov", f"{P}, c AS (SELECT i, unnest(x) AS v, unnest(range(len(x))) AS m FROM p) SELECT a.m AS a, b.m AS b, {_r('covar_samp(a.v, b.v)', 'cov')} FROM c a JOIN c b ON a.i = b.i AND a.m <= b.m GROUP BY a.m, b.m")(lambda s, d: rounded(preprocess.covariance(points(s, d))))
query("pca_projection")(lambda s, d: rounded(preprocess.components(preprocess.pca(points(s, d), 8)), 4))
query("metric_mahalanobis_knn")(lambda s, d: rounded(knn.exact_knn(preprocess.whiten(points(s, d)), 5), 4))
query("without_nan", "SELECT vec_id AS i FROM embeddings WHERE len(list_filter(embedding, lambda v: isnan(v))) = 0")(lambda s, d: preprocess.without_nan(points(s, d)).select("i"))
query("extract_dimensions", f"{P} SELECT i, x[4] AS a, x[1] AS b FROM p")(lambda s, d: preprocess.extract(points(s, d), [3, 0]).select("i", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b")))
query("random_rows", f"SELECT vec_id AS i FROM embeddings ORDER BY {_u(0, 'vec_id')}, vec_id LIMIT 100")(lambda s, d: synthetic.random_rows(points(s, d), 100).select("i"))

# neighbours without a short SQL form, generated data, whole embeddings

query("knn_ivf_k10")(lambda s, d: rounded(knn.ivf_knn(points(s, d), 10)))
query("knn_ivfpq_k10")(lambda s, d: rounded(knn.ivfpq_knn(points(s, d), 10)))
query("knn_lsh_k10")(lambda s, d: rounded(knn.lsh_knn(points(s, d), 10, 4.0)))
for _name, _find in (("ivf", lambda p: knn.ivf_knn(p, 10)), ("ivfpq", lambda p: knn.ivfpq_knn(p, 10)), ("lsh", lambda p: knn.lsh_knn(p, 10, 4.0))):
    query(f"knn_{_name}_recall", "SELECT true AS at_least_nine_tenths")(lambda s, d, f=_find: knn.recall(f(points(s, d)), knn.exact_knn(points(s, d), 10)).select((F.col("recall") >= 0.9).alias("at_least_nine_tenths")))
_GENERATED = "SELECT i.range AS i, m.range AS m, {} FROM range(200) i, range({}) m"
query("source_two_blobs", _GENERATED.format(_r(f"CASE WHEN i.range < 100 THEN -10 ELSE 10 END + {_gauss(0, 'i.range', 'm.range')}", "v"), 3))(lambda s, d: rounded(preprocess.components(synthetic.two_blobs(s, 200, 3))))
query("source_four_blobs", _GENERATED.format(_r(f"[-20, 20, 10, -10][i.range // 50 + 1] + 2 * {_gauss(0, 'i.range', 'm.range')}", "v"), 3))(lambda s, d: rounded(preprocess.components(synthetic.four_blobs(s, 200, 3))))
query("source_clusters", _GENERATED.format(_r(f"CASE WHEN m.range >= i.range // 50 THEN 20 ELSE -20 END + 2 * {_gauss(0, 'i.range', 'm.range')}", "v"), 50))(lambda s, d: rounded(preprocess.components(synthetic.clusters(s, 200, 4))))
query("source_uniform", _GENERATED.format(_r(_u(0, "i.range", "m.range"), "v"), 4))(lambda s, d: rounded(preprocess.components(synthetic.uniform_points(s, 200, 4))))
_EDGES = f"e AS (SELECT j.range AS j, k.range + 1 AS k FROM range(200) j, range(11) k WHERE k.range < floor({_u(0, 'j.range', 1)} * 10) + 2)"
query("source_random_graph", f"{_EDGES} SELECT floor({_u(0, 'j', 'k', 2)} * 200)::BIGINT AS i, j, {_r('sum(' + _u(0, 'j', 'k', 3) + ')', 'v')} FROM e GROUP BY 1, 2")(lambda s, d: rounded(synthetic.random_graph(s, 200)))
query("source_charges", f"SELECT range AS i, {_r('y0', 'y0')}, {_r('sin(10 * y0) + cos(2000 * y0)', 'q')} FROM (SELECT range, {_u(0, 'range')} AS y0 FROM range(200))")(lambda s, d: rounded(synthetic.charge_signal(s, 200)))
query("initial_layout", f"SELECT vec_id AS i, {_r('1e-4 * ' + _gauss(0, 'vec_id', 0), 'y0', 12)}, {_r('1e-4 * ' + _gauss(0, 'vec_id', 1), 'y1', 12)} FROM embeddings")(lambda s, d: rounded(optimizer.initial_layout(points(s, d), 2), 12))
query("initial_layout_uniform", f"SELECT vec_id AS i, {_r('1e-4 * ' + _u(0, 'vec_id', 0), 'y0', 12)}, {_r('1e-4 * ' + _u(0, 'vec_id', 1), 'y1', 12)} FROM embeddings")(lambda s, d: rounded(optimizer.initial_layout(points(s, d), 2, gaussian=False), 12))

# files, written and read again


def _file(spark: SparkSession, name: str) -> str:
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("source_points_text", P + f" SELECT i, unnest(range(len(x))) AS m, {_r('unnest(x)', 'v')} FROM p")
def _(s, d):
    own, path = points(s, d), _file(s, "points")
    sinks.points_text(own, path)
    return rounded(preprocess.components(readers.points_text(s, path)))


@query("source_points_plain", P + f" SELECT i, unnest(range(len(x))) AS m, {_r('unnest(x)', 'v')} FROM p WHERE i < 50")
def _(s, d):
    path = _file(s, "plain")
    sinks.points_text(points(s, d), path, header=False)
    return rounded(preprocess.components(readers.points_plain(s, path, 50)))


@query("sink_layout_text", f"{Y} SELECT i, {_r('y0', 'y0')}, {_r('y1', 'y1')} FROM y")
def _(s, d):
    path = _file(s, "layout")
    sinks.layout_text(layout(s, d), path)
    return rounded(readers.layout_text(s, path))


@query("source_matrix_market", f"{E} SELECT i, j, v FROM e")
def _(s, d):
    path = _file(s, "graph")
    sinks.graph_text(trade(s, d), 25, path)
    return rounded(readers.matrix_market(s, path))


@query("source_matrix_symmetric", f"{E}, u AS (SELECT i, j, v FROM e WHERE i >= j) SELECT i, j, v FROM u UNION ALL SELECT j, i, v FROM u WHERE i <> j")
def _(s, d):
    path = _file(s, "graph")
    sinks.graph_text(trade(s, d).filter("i >= j"), 25, path)
    return rounded(readers.matrix_market(s, path, symmetric=True))


@query("sink_snapshots", f"{Y} SELECT i, {_r('y0', 'y0')}, {_r('y1', 'y1')}, 0 AS iter FROM y UNION ALL SELECT i, {_r('2 * y0', 'y0')}, {_r('2 * y1', 'y1')}, 50 FROM y")
def _(s, d):
    path, y = _file(s, "snapshots"), layout(s, d)
    sinks.snapshot(y, 0, path)
    sinks.snapshot(y.select("i", (2 * F.col("y0")).alias("y0"), (2 * F.col("y1")).alias("y1")), 50, path)
    return rounded(s.read.parquet(path))


query("sink_stage_times", f"SELECT event_type AS stage, {_r('sum(value)', 'total_ms')}, count(*) AS n FROM events GROUP BY event_type")(lambda s, d: rounded(sinks.stage_times(s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("iter"), F.col("event_type").alias("stage"), F.col("value").alias("ms")))))

# whole embeddings


@query("embed_points_cost", "SELECT true AS falls, true AS finite, 21 AS logged")
def _(s, d):
    log = optimizer.cost_log(affinity.perplexity_edges(knn.exact_knn(points(s, d), 90), 30))
    first, last = F.min(F.struct("iter", "kl"))["kl"], F.max(F.struct("iter", "kl"))["kl"]
    return log.agg((last < first).alias("falls"), F.every(~F.isnan("kl") & (F.abs("kl") < 1e6)).alias("finite"), F.count("*").alias("logged"))


query("embed_graph")(lambda s, d: rounded(optimizer.embed_graph(trade(s, d), lam=5.0)))
query("embed_points")(lambda s, d: rounded(optimizer.embed_points(points(s, d))))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to a joint stochastic graph: neighbours, perplexity, both directions, total 1."""
    return affinity.joint(affinity.perplexity_edges(knn.exact_knn(points(spark, sf_dir), 90), 30), tables.written)


query("joint_affinity", PERP + ", w AS (SELECT k.i, j, exp(-beta * d2) AS v FROM k JOIN beta ON k.i = beta.i), s AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM w), b AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM s UNION ALL SELECT j, i, v FROM s) GROUP BY i, j) SELECT i, j, " + _r("v / (SELECT sum(v) FROM b)", "v", 12) + " FROM b")(lambda s, d: rounded(flagship(s, d), 12))

