"""Solving sparse systems over edge tables (i, j, v): triangular ones level by level, symmetric ones by conjugate gradients."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborfield.operators.formats import drop_loops, transpose
from neighborfield.operators.linalg import spmv

Write = Callable[[DataFrame, str], DataFrame]


def levels(lower: DataFrame, write: Write) -> DataFrame:
    """(i, level) of a strictly lower triangle's rows: 0 without entries, else one more than the last row it needs.

    A round settles all rows of a level, so there are as many rounds as levels: the longest chain of dependent rows."""
    edges = write(drop_loops(lower).select("i", "j"), "level-edges")
    rows = write(lower.select("i").distinct(), "level-rows")
    open_ = edges
    done = write(rows.join(edges.select("i").distinct(), "i", "left_anti").withColumn("level", F.lit(0)), "levels-0")
    out, level = done, 0
    while not done.isEmpty():
        level += 1
        # entries whose column was settled go; rows that have lost their last one are the next level
        rest = write(open_.join(done.select(F.col("i").alias("j")), "j", "left_anti").select("i", "j"), f"level-rest-{level}")
        done = write(open_.select("i").distinct().join(rest.select("i").distinct(), "i", "left_anti").withColumn("level", F.lit(level)), f"levels-{level}")
        open_ = rest
        out = out.unionByName(done)
    if not open_.isEmpty():
        raise ValueError("the matrix is not triangular: rows depend on each other")
    return out


def solve_lower(lower: DataFrame, b: DataFrame, write: Write) -> DataFrame:
    """(i, x) with L x = b, for L (i, j, v) with its diagonal and b (i, x); a round for each level of L.

    What a solved row gives to later rows is summed with what is known of them, so a round joins the entries of one level
    only. Rows without a diagonal entry can't be solved: an error."""
    diagonal = lower.filter("i = j").select("i", F.col("v").alias("pivot"))
    if not lower.select("i").distinct().join(diagonal.filter("pivot <> 0"), "i", "left_anti").isEmpty():
        raise ValueError("a row has no diagonal entry")
    own = write(levels(lower, write), "solve-levels")
    edges = write(lower.filter("i <> j").join(own.select(F.col("i").alias("j"), F.col("level").alias("from")), "j"), "solve-edges")
    rest = write(diagonal.join(own, "i").join(b.select("i", "x"), "i", "left").select("i", "level", "pivot", F.coalesce("x", F.lit(0.0)).alias("x")), "solve-rest")
    out = None
    for level in range(own.agg(F.coalesce(F.max("level"), F.lit(-1))).first()[0] + 1):
        solved = write(rest.filter(F.col("level") == level).select("i", (F.col("x") / F.col("pivot")).alias("x")), f"solved-{level}")
        out = solved if out is None else out.unionByName(solved)
        given = edges.filter(F.col("from") == level).join(solved.select(F.col("i").alias("j"), F.col("x").alias("_x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("_x")).alias("given"))
        rest = write(rest.filter(F.col("level") > level).join(given, "i", "left").select("i", "level", "pivot", (F.col("x") - F.coalesce("given", F.lit(0.0))).alias("x")), f"solve-rest-{level}")
    return out if out is not None else b.select("i", "x").limit(0)


def solve_upper(upper: DataFrame, b: DataFrame, write: Write) -> DataFrame:
    """The same for an upper triangle: rows in reverse are a lower one."""
    turned = solve_lower(upper.select((-F.col("i")).alias("i"), (-F.col("j")).alias("j"), "v"), b.select((-F.col("i")).alias("i"), "x"), write)
    return turned.select((-F.col("i")).alias("i"), "x")


def solve_cg(edges: DataFrame, b: DataFrame, write: Write, tol: float = 1e-10, most: int = 200) -> tuple[DataFrame, float, int]:
    """(i, x) with A x = b for a symmetric positive definite A (i, j, v), the relative residual, and the steps it took.

    Conjugate gradients scaled by the diagonal: a step is one sparse product and two sums; the state and
    the product are written once a step. Ends at the relative residual `tol`; after `most` steps without it, an error."""
    edges = write(edges.select("i", "j", "v"), "cg-matrix")
    diagonal = edges.filter("i = j").select("i", F.col("v").alias("m"))
    state = write(b.join(diagonal, "i").select("i", F.lit(0.0).alias("x"), F.col("x").alias("r"), (F.col("x") / F.col("m")).alias("p"), "m"), "cg-0")
    dots = state.agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("rz"), F.sum(F.col("r") * F.col("r")).alias("rr")).first()
    rz, whole = dots.rz or 0.0, dots.rr or 0.0
    if whole == 0:
        return state.select("i", "x"), 0.0, 0
    for step in range(1, most + 1):
        product = spmv(edges, state.select("i", F.col("p").alias("x"))).withColumnRenamed("x", "ap")
        both = write(state.join(product, "i", "left").withColumn("ap", F.coalesce("ap", F.lit(0.0))), f"cg-{step}")
        alpha = rz / both.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        moved = both.select("i", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p", "m")
        dots = moved.agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("rz"), F.sum(F.col("r") * F.col("r")).alias("rr")).first()
        beta, rz = dots.rz / rz, dots.rz
        state = moved.select("i", "x", "r", (F.col("r") / F.col("m") + beta * F.col("p")).alias("p"), "m")
        residual = (dots.rr / whole) ** 0.5
        if residual <= tol:
            return state.select("i", "x"), residual, step
    raise RuntimeError(f"the residual is {residual} after {most} steps")


def least_squares(edges: DataFrame, b: DataFrame, write: Write, shift: float = 0.0, tol: float = 1e-10, most: int = 200) -> DataFrame:
    """(i, x): the normal equations (A' A + shift) x = A' b by conjugate gradients, for A of any shape with full columns."""
    left = transpose(edges).withColumnRenamed("j", "k")
    right = edges.select(F.col("i").alias("k"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    gram = left.join(right, "k").groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))
    gram = gram.withColumn("v", F.col("v") + F.when(F.col("i") == F.col("j"), F.lit(shift)).otherwise(0.0))
    return solve_cg(gram, spmv(transpose(edges), b), write, tol, most)[0]
