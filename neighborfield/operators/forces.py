"""Attraction, repulsion, their sum, and the cost of an embedding y(i, y0, ..)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neighborfield.functions.array_metrics import CACHED
from neighborfield.functions.kernels import entropy_term, student
from neighborfield.operators import pair_blocks
from neighborfield.params import FLT_MIN

Write = Callable[[DataFrame, str], DataFrame]


def axes(y: DataFrame) -> list[str]:
    return [c for c in y.columns if c.startswith("y") and c[1:].isdigit()]


def gathered(edges: DataFrame, y: DataFrame) -> DataFrame:
    """Edges with both ends' places, and q = 1 / (1 + d2). Spark picks a broadcast where y is small enough."""
    dims = axes(y)
    a = y.select("i", *dims)
    b = y.select(F.col("i").alias("j"), *(F.col(c).alias(f"_{c}") for c in dims))
    d2 = sum((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in dims)
    return edges.join(a, "i").join(b, "j").withColumn("q", student(d2))


def attraction(edges: DataFrame, y: DataFrame, factor: float = 1.0) -> DataFrame:
    """(i, f0, ..): factor * sum_j p q (y_i - y_j)."""
    return gathered(edges, y).groupBy("i").agg(*((F.sum(F.col("v") * F.col("q") * (F.col(c) - F.col(f"_{c}"))) * factor).alias(f"f{c[1:]}") for c in axes(y)))


#: Squares of centred places up to which 1 + d2 is taken from products: they cancel, by less than 1e-12 of it.
CLOSE = 1024.0


class KernelSums:
    """Of each query the sums over all points of q^2, with charges 1 and their places, and of q without itself."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.i, self.x = ids, x
        self.sums = np.zeros((len(ids), x.shape[1] + 2))
        self.centre = x.mean(0)
        own = x - self.centre
        self.size = np.einsum("ij,ij->i", own, own)
        self.terms = np.concatenate([-2 * own, np.ones((len(x), 1)), 1 + self.size[:, None]], 1)

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        columns, moved = np.ascontiguousarray(x.T), x - self.centre
        size = np.einsum("ij,ij->i", moved, moved)
        terms = np.concatenate([moved.T, size[None], np.ones((1, len(x)))])
        close = max(self.size.max(), size.max()) <= CLOSE
        step = max(1, 2 * CACHED // max(1, len(x)))
        room = np.empty((2, min(step, len(self.i)), len(x)))  # for all tiles: fresh arrays cost as much as sums
        for lo in range(0, len(self.i), step):
            own, out = self.x[lo : lo + step], self.sums[lo : lo + step]
            q, gap = room[:, : len(own)]
            if close:
                np.matmul(self.terms[lo : lo + step], terms, out=q)
            else:
                q.fill(1)
                for m, column in enumerate(columns):
                    np.subtract(own[:, m, None], column, out=gap)
                    gap *= gap
                    q += gap
            np.divide(1, q, out=q)
            out[:, -1] += q.sum(1)
            q *= q
            out[:, 0] += q.sum(1)
            for m, column in enumerate(columns, 1):
                out[:, m] += q @ column

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = ["i", *(f"phi{m}" for m in range(self.x.shape[1] + 1)), *(f"y{m}" for m in range(self.x.shape[1])), "z"]
        columns = [self.i, *self.sums[:, :-1].T, *self.x.T, self.sums[:, -1] - 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)


def kernel_sums(y: DataFrame, block: int = pair_blocks.LEAST_QUERIES) -> DataFrame:
    """(i, y0.., phi0, phi1.., z): exact sums of q^2 over all points with charges 1 and y, and of q without the point
    itself. A task has a chunk of points (of at least `block` where there are so many) and all pass by it in packed blocks."""
    dims = axes(y)
    names = ["i", *(f"phi{m}" for m in range(len(dims) + 1)), *(f"y{m}" for m in range(len(dims))), "z"]
    places = y.select("i", F.array(*dims).alias("x"))
    sums = pair_blocks.meet(places, places, KernelSums, ", ".join(f"{n} {'long' if n == 'i' else 'double'}" for n in names), block)
    return sums.select("i", *(F.col(f"y{m}").alias(c) for m, c in enumerate(dims)), *(n for n in names if n[0] != "y" and n != "i"))


def zeta_from_phi(phi: DataFrame) -> DataFrame:
    """One row, zeta: the sum of q over all pairs, from the q^2 sums alone."""
    dims = axes(phi)
    squares = sum(F.col(c) * F.col(c) for c in dims)
    cross = sum(F.col(c) * F.col(f"phi{m + 1}") for m, c in enumerate(dims))
    return phi.agg((F.sum((1 + 2 * squares) * F.col("phi0") - 2 * cross) - F.count("*")).alias("zeta"))


def zeta_from_pairs(phi: DataFrame) -> DataFrame:
    return phi.agg(F.sum("z").alias("zeta"))


def forces_from_phi(phi: DataFrame, zeta: DataFrame) -> DataFrame:
    """(i, f0, ..): (y phi0 - phi) / zeta."""
    return phi.crossJoin(F.broadcast(zeta)).select("i", *(((F.col(c) * F.col("phi0") - F.col(f"phi{m + 1}")) / F.col("zeta")).alias(f"f{m}") for m, c in enumerate(axes(phi))))


def repulsion(y: DataFrame, write: Write | None = None) -> DataFrame:
    """Exact repulsive force. write keeps the sums over pairs, which are read twice."""
    phi = kernel_sums(y)
    phi = write(phi, "exact-sums") if write else phi
    return forces_from_phi(phi, zeta_from_pairs(phi))


def kl_cost(edges: DataFrame, y: DataFrame, zeta: DataFrame, alpha: float = 1.0) -> DataFrame:
    """One row, kl: sum alpha p ln((alpha p + FLT_MIN) / (q / zeta + FLT_MIN))."""
    p = F.col("v") * alpha
    return gathered(edges, y).crossJoin(F.broadcast(zeta)).agg(F.sum(p * F.ln((p + FLT_MIN) / (F.col("q") / F.col("zeta") + FLT_MIN))).alias("kl"))


def dense_kl(edges: DataFrame, y: DataFrame, zeta: DataFrame) -> DataFrame:
    """One row, kl: sum p ln p - sum p ln(q / zeta) over the entries."""
    return gathered(edges, y).crossJoin(F.broadcast(zeta)).agg((F.sum(entropy_term(F.col("v"))) - F.sum(F.col("v") * F.ln(F.col("q") / F.col("zeta")))).alias("kl"))


def gradient(attractive: DataFrame, repulsive: DataFrame, alpha: float) -> DataFrame:
    """(i, d0, ..): alpha * attraction - repulsion; a point without edges has no attraction."""
    dims = [c[1:] for c in repulsive.columns if c.startswith("f")]
    a = attractive.select("i", *(F.col(f"f{m}").alias(f"a{m}") for m in dims))
    return repulsive.join(a, "i", "left").select("i", *((alpha * F.coalesce(F.col(f"a{m}"), F.lit(0.0)) - F.col(f"f{m}")).alias(f"d{m}") for m in dims))


def relative_error(forces: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: norm of the difference over the norm of the exact forces, and its decimal logarithm."""
    dims = [c for c in exact.columns if c.startswith("f")]
    both = exact.join(forces.select("i", *(F.col(c).alias(f"_{c}") for c in dims)), "i")
    gap: Column = sum((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in dims)
    size: Column = sum(F.col(c) * F.col(c) for c in dims)
    return both.agg(F.sqrt(F.sum(gap) / F.sum(size)).alias("error")).withColumn("log10_error", F.log10("error"))
