"""From distances to a stochastic graph: perplexity, lambda rescaling, stochastic rows, symmetric and joint weights."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neighborfield.functions.kernels import bind, floor_at_realmin, gaussian, total
from neighborfield.params import DBL_MIN

Write = Callable[[DataFrame, str], DataFrame]


def _as_it_is(df: DataFrame, _: str) -> DataFrame:
    return df


def _row():
    return Window.partitionBy("i")


def fixed_beta(knn: DataFrame, beta: float) -> DataFrame:
    """(i, j, v) with v = exp(-beta d2)."""
    return knn.select("i", "j", gaussian(F.col("d2"), beta).alias("v"))


def max_normalised(knn: DataFrame, write: Write = _as_it_is) -> DataFrame:
    """d2 divided by the largest d2 of all. write keeps the neighbours, which are read twice."""
    knn = write(knn, "neighbours")
    most = knn.agg(F.max("d2").alias("most"))
    return knn.crossJoin(F.broadcast(most)).withColumn("d2", F.when(F.col("most") > 0, F.col("d2") / F.col("most")).otherwise(F.col("d2"))).drop("most")


def row_stochastic(edges: DataFrame, tol: float = 1e-12) -> DataFrame:
    """Rows divided by their sums; rows that sum to 1 within tol, or to 0, stay."""
    s = F.sum("v").over(_row())
    return edges.select("i", "j", "v", s.alias("s")).select("i", "j", F.when((F.abs(F.col("s") - 1) <= tol) | (F.col("s") == 0), F.col("v")).otherwise(F.col("v") / F.col("s")).alias("v"))


def stochastic_rows(edges: DataFrame, tol: float = 1e-12) -> DataFrame:
    """One row: how many rows there are, and how many sum to 1 already."""
    return edges.groupBy("i").agg(F.sum("v").alias("s")).agg(F.count("*").alias("n_rows"), F.count_if(F.abs(F.col("s") - 1) <= tol).alias("n_stochastic"))


def _bisect(start: Column, gap: Callable[[Column], Column], steps: int, tol: float, first_low: float | None) -> Column:
    """Bisection as a fold: gap(x) > 0 moves x up. An end that is not known yet is null; the state is frozen once |gap| < tol."""
    kind = "struct<x double, lo double, hi double, done boolean>"
    state = F.struct(start.alias("x"), F.lit(first_low).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done")).cast(kind)

    def step(s: Column, _: Column) -> Column:
        x, lo, hi = s["x"], s["lo"], s["hi"]
        # one struct for the gap, so that it is computed once
        g = F.transform(F.array(gap(x)), lambda v: F.struct(
            F.when(F.abs(v) < tol, x).when(v > 0, F.when(hi.isNull(), 2 * x).otherwise((x + hi) / 2)).otherwise(F.when(lo.isNull(), x / 2).otherwise((x + lo) / 2)).alias("x"),
            F.when(F.abs(v) < tol, lo).when(v > 0, x).otherwise(lo).alias("lo"),
            F.when(F.abs(v) < tol, hi).when(v > 0, hi).otherwise(x).alias("hi"),
            (F.abs(v) < tol).alias("done"),
        ))
        return F.when(s["done"], s).otherwise(F.get(g, F.lit(0)).cast(kind))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)


def perplexity(knn: DataFrame, u: float, tol: float = 1e-5, steps: int = 200) -> DataFrame:
    """(i, beta, p, d2s, js): beta so that the row's entropy is ln u; p its affinities, summing to 1."""
    rows = knn.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("d2", "j"))).alias("near"))
    rows = rows.select("i", F.transform("near", lambda z: z["d2"]).alias("d2s"), F.transform("near", lambda z: z["j"]).alias("js"))

    def gap(beta: Column) -> Column:
        both = F.aggregate("d2s", F.struct(F.lit(DBL_MIN).alias("s"), F.lit(0.0).alias("h")), lambda a, d: F.struct((a["s"] + F.exp(-beta * d)).alias("s"), (a["h"] + beta * d * F.exp(-beta * d)).alias("h")))
        return bind(both, lambda a: a["h"] / a["s"] + F.ln(a["s"]) - math.log(u))

    def shares(beta: Column) -> Column:
        scaled = lambda w: bind(total(w), lambda s: F.struct(beta.alias("beta"), F.transform(w, lambda v: v / s).alias("p")))
        return bind(F.transform("d2s", lambda d: F.exp(-beta * d)), scaled)

    rows = rows.withColumn("r", bind(_bisect(F.lit(1.0), gap, steps, tol, None)["x"], shares))
    return rows.select("i", "r.beta", "r.p", "d2s", "js")


def perplexity_edges(knn: DataFrame, u: float) -> DataFrame:
    """The row-stochastic matrix of perplexity(): (i, j, v)."""
    return perplexity(knn, u).select("i", F.explode(F.arrays_zip("js", "p")).alias("z")).select("i", F.col("z.js").alias("j"), F.col("z.p").alias("v"))


def sigma_summary(betas: DataFrame) -> DataFrame:
    """Mean, least and most of sqrt(1 / beta): one row."""
    s = F.sqrt(1 / F.col("beta"))
    return betas.agg(F.avg(s).alias("mean_sigma"), F.min(s).alias("min_sigma"), F.max(s).alias("max_sigma"))


def lambda_rescale(edges: DataFrame, lam: float, tol: float = 1e-5, steps: int = 100, drop_leaf: bool = False) -> DataFrame:
    """(i, j, v, sigma): with w = -ln v, sigma so that sum exp(-sigma w) = lam in each row, then rows to 1.
    Edges whose weight is not positive have no distance and are dropped. drop_leaf: a row's only edge becomes 0."""
    rows = edges.filter("v > 0").groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", (-F.ln("v")).alias("w")))).alias("row"))
    rows = rows.select("i", F.transform("row", lambda z: z["j"]).alias("js"), F.transform("row", lambda z: z["w"]).alias("ws"))
    gap = lambda x: F.aggregate("ws", F.lit(0.0), lambda a, w: a + F.exp(-w * x)) - lam

    def scaled(sigma: Column) -> Column:
        share = lambda e: bind(total(e), lambda s: F.transform(e, lambda v: v / s))
        return F.struct(sigma.alias("sigma"), bind(F.transform("ws", lambda w: F.exp(-w * sigma)), share).alias("v"))

    rows = rows.withColumn("r", bind(_bisect(F.lit(1.0), gap, steps, tol, -1e3)["x"], scaled))
    value = F.when(F.size("js") == 1, 0.0).otherwise(F.col("z.v")) if drop_leaf else F.col("z.v")
    rows = rows.select("i", "js", "r.sigma", F.col("r.v").alias("v"))
    return rows.select("i", "sigma", "js", F.explode(F.arrays_zip("js", "v")).alias("z")).select("i", F.col("z.js").alias("j"), value.alias("v"), "sigma")


def drop_leaves(edges: DataFrame) -> DataFrame:
    """The only edge of a row becomes 0."""
    return edges.select("i", "j", F.when(F.count("*").over(_row()) == 1, 0.0).otherwise(F.col("v")).alias("v"))


def drop_diagonal(edges: DataFrame) -> DataFrame:
    return edges.filter("i <> j")


def zero_diagonal(edges: DataFrame) -> DataFrame:
    return edges.withColumn("v", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("v")))


def at_least_realmin(edges: DataFrame) -> DataFrame:
    return edges.withColumn("v", floor_at_realmin(F.col("v")))


def symmetrise(edges: DataFrame, factor: float = 1.0) -> DataFrame:
    """factor * (P + P^T): one shuffle, both directions summed before it. Edges are read once, so what they come from runs once."""
    way = lambda a, b: F.struct(F.col(a).alias("i"), F.col(b).alias("j"), F.col("v").alias("v"))
    both = edges.select(F.inline(F.array(way("i", "j"), way("j", "i"))))
    return both.groupBy("i", "j").agg((F.sum("v") * factor).alias("v"))


def symmetrise_over_2n(edges: DataFrame, n: int | None = None) -> DataFrame:
    """(P + P^T) / (2n), n the number of points."""
    return symmetrise(edges, 1 / (2 * (n or max(1, edges.select("i").union(edges.select("j")).distinct().count()))))


def normalise(edges: DataFrame, write: Write = _as_it_is) -> DataFrame:
    """Divided by the grand total, which a one-row broadcast carries. write keeps the edges, which are read twice."""
    edges = write(edges, "unscaled")
    whole = edges.agg(F.sum("v").alias("whole"))
    return edges.crossJoin(F.broadcast(whole)).select("i", "j", F.when(F.col("whole") != 0, F.col("v") / F.col("whole")).otherwise(F.col("v")).alias("v"))


def joint(edges: DataFrame, write: Write = _as_it_is) -> DataFrame:
    return normalise(symmetrise(edges), write)
