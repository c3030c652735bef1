"""Low-rank approximations of a kernel matrix over points (i, x): by interpolation on few nodes and by a randomised range.

The matrix has a row for each point and is never made: products with a few columns are sums over blocks of points. The
orthonormal basis of a tall matrix comes from its tasks' triangular factors, which are combined in a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborfield.operators import pair_blocks
from neighborfield.operators.pair_blocks import dense

Write = Callable[[DataFrame, str], DataFrame]
Kernel = Callable[[np.ndarray], np.ndarray]
BLOCK = 2048


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, max(1, values.shape[1]), dtype=np.int32)), pa.array(values.reshape(-1)))


def kernel_times(points: DataFrame, vectors: DataFrame, kernel: Kernel) -> DataFrame:
    """(i, u): the kernel matrix of points (i, x) times vectors (i, u array). Equal points have equal rows and
    columns, so each different point stands once, with the sum of its vectors. Blocks of these meet in tasks; no pair is a row."""
    both = points.join(vectors, "i")
    known = both.select("x", F.posexplode("u").alias("m", "v")).groupBy("x", "m").agg(F.sum("v").alias("v"))
    known = known.groupBy("x").agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "v"))), lambda z: z["v"]).alias("u"))
    blocks = max(1, -(-points.select("x").distinct().count() // BLOCK))
    own = known.withColumn("b", F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("int"))
    every = F.explode(F.expr(f"sequence(0, {blocks - 1})"))
    rows = own.select(F.col("b").alias("p"), every.alias("c"), F.lit(True).alias("asks"), "x", "u")
    others = own.select(every.alias("p"), F.col("b").alias("c"), F.lit(False).alias("asks"), "x", "u")

    def meet(part: pa.Table) -> pa.Table:
        asks = part["asks"].to_numpy()
        x, u = dense(part["x"]), dense(part["u"])
        a, b, given = x[asks], x[~asks], u[~asks]
        out = np.zeros((len(a), u.shape[1]))
        for lo in range(0, len(a), 128):
            gap = a[lo : lo + 128, None, :] - b[None]
            out[lo : lo + 128] = kernel(np.einsum("abm,abm->ab", gap, gap)) @ given
        return pa.table([_lists(a), _lists(out)], names=["x", "u"])

    met = rows.unionByName(others).groupBy("p", "c").applyInArrow(meet, "x array<double>, u array<double>")
    summed = met.select("x", F.posexplode("u").alias("m", "v")).groupBy("x", "m").agg(F.sum("v").alias("v"))
    summed = summed.groupBy("x").agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "v"))), lambda z: z["v"]).alias("u"))
    return points.join(summed, "x").select("i", "u")


def triangular(vectors: DataFrame, write: Write) -> np.ndarray:
    """R of a QR factorisation of the tall matrix of rows u: a factor for each task, then factors of factors, 64 at a time,
    until one is left. R has as many rows as columns."""

    def factor(batches):
        r = None
        for b in batches:
            u = dense(b["u"])
            r = np.linalg.qr(u if r is None else np.concatenate([r, u]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([r.tobytes()], pa.binary()), pa.array([r.shape[1]], pa.int32())], names=["k", "r", "n"])

    def combine(part: pa.Table) -> pa.Table:
        n = part["n"][0].as_py()
        r = np.linalg.qr(np.concatenate([np.frombuffer(x.as_buffer()).reshape(-1, n) for x in part["r"]]), mode="r")
        return pa.table([part["k"].slice(0, 1), pa.array([r.tobytes()], pa.binary()), pa.array([n], pa.int32())], names=["k", "r", "n"])

    factors = write(vectors.select("u").mapInArrow(factor, "k long, r binary, n int").withColumn("k", F.monotonically_increasing_id()), "factors")
    count = factors.count()
    while count > 1:
        count = -(-count // 64)
        factors = write(factors.withColumn("k", F.pmod(F.xxhash64("k"), F.lit(count)).cast("long")).groupBy("k").applyInArrow(combine, "k long, r binary, n int"), "factors")
        count = factors.count()
    row = factors.first()
    return np.frombuffer(bytes(row.r)).reshape(-1, row.n)


def _times(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["i"], _lists(dense(b["u"]) @ matrix)], names=["i", "u"])

    return vectors.mapInArrow(run, "i long, u array<double>")


def orthonormal(vectors: DataFrame, write: Write) -> DataFrame:
    """(i, u) with orthonormal columns that span those given; twice, so that rounding in the first factor is mended."""
    for k in range(2):
        r = triangular(vectors, write)
        left, values, right = np.linalg.svd(r)
        inverse = right.T @ np.diag(np.where(values > 1e-13 * values.max(initial=0), 1 / np.maximum(values, 1e-300), 0)) @ left.T
        vectors = write(_times(vectors, inverse), f"basis-{k}")
    return vectors


def singular_values(points: DataFrame, kernel: Kernel, rank: int, write: Write, over: int = 8, powers: int = 3, seed: int = 0) -> np.ndarray:
    """The `rank` largest singular values of the kernel matrix, by a random range of rank + over columns and `powers`
    further products."""
    columns = rank + over
    uniform = lambda m: (F.pmod(F.xxhash64(F.lit(seed), F.lit(m), "i"), F.lit(1 << 40)) + 0.5) / (1 << 40) * 2 - 1
    basis = write(points.select("i", F.array(*(uniform(m) for m in range(columns))).alias("u")), "random-columns")
    for k in range(powers + 1):
        basis = orthonormal(write(kernel_times(points, basis, kernel), f"range-{k}"), write)
    r = triangular(write(kernel_times(points, basis, kernel), "projected"), write)
    return np.linalg.svd(r, compute_uv=False)[:rank]


def frobenius(points: DataFrame, kernel: Kernel, write: Write) -> float:
    """The sum of the kernel matrix's squared entries."""
    ones = points.select("i", F.array(F.lit(1.0)).alias("u"))
    return kernel_times(points, ones, lambda d2: kernel(d2) ** 2).agg(F.sum(F.get("u", F.lit(0)))).first()[0]


def rank_errors(points: DataFrame, kernel: Kernel, ranks: list[int], write: Write, **options) -> DataFrame:
    """(rank, error): relative Frobenius error of the best approximation of each rank, from the singular values."""
    whole = frobenius(points, kernel, write)
    squares = singular_values(points, kernel, max(ranks), write, **options) ** 2
    rows = [(k, float(np.sqrt(max(whole - squares[:k].sum(), 0.0) / whole))) for k in ranks]
    return points.sparkSession.createDataFrame(rows, "rank int, error double")


class _Sums:
    """Of each query (x) the sum over all points (x, q) of kernel(squared distance) * q."""

    def __init__(self, x: np.ndarray, kernel: Kernel):
        self.x, self.kernel, self.f = x[:, 0], kernel, np.zeros(len(x))

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        step = max(1, pair_blocks.TILE // len(x))
        for lo in range(0, len(self.x), step):
            gap = self.x[lo : lo + step, None] - x[:, 0]
            self.f[lo : lo + step] += self.kernel(gap * gap) @ x[:, 1]

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(self.x)), pa.array(self.f)], names=["x", "f"])


def interpolation_errors(points: DataFrame, charges: DataFrame, kernel, nodes: list[int], low: float, high: float) -> DataFrame:
    """(nodes, error): relative error of kernel sums over one-dimensional points (i, x) with charges (i, q) when the kernel
    is interpolated between so many equispaced nodes from low to high. kernel is a function of the squared distance, as a
    Column (between nodes) and as an array (between points).

    Equal points have equal sums, so each different point stands once, with the sum of its charges. All pairs of these are
    compared in blocks (pair_blocks): no pair is a row."""
    own = points.select("i", F.get("x", F.lit(0)).alias("x")).join(charges, "i").groupBy("x").agg(F.sum("q").alias("q"), F.count("*").alias("n"))
    asked = own.select(F.xxhash64("x").alias("i"), F.array("x").alias("x"))
    exact = pair_blocks.meet(asked, own.select(F.xxhash64("x").alias("i"), F.array("x", "q").alias("x")), lambda _, x: _Sums(x, kernel), "x double, f double")
    terms = []
    for n in nodes:
        spots = [low + (high - low) * k / (n - 1) for k in range(n)] if n > 1 else [low]
        for k in range(n):
            value = F.lit(1.0)
            for m in range(n):
                if m != k:
                    value = value * ((F.col("x") - spots[m]) / (spots[k] - spots[m]))
            terms.append(F.struct(F.lit(n).alias("nodes"), F.lit(spots[k]).alias("z"), value.alias("w")))
    weighted = own.select("x", "q", F.explode(F.array(*terms)).alias("t")).select("x", "q", "t.*")
    sums = weighted.groupBy("nodes", "z").agg(F.sum(F.col("w") * F.col("q")).alias("s"))
    between = sums.select("nodes", F.col("z").alias("_z"), F.col("s").alias("_s")).join(sums.select("nodes", "z"), "nodes")  # nodes squared rows
    potential = between.groupBy("nodes", "z").agg(F.sum(kernel((F.col("z") - F.col("_z")) * (F.col("z") - F.col("_z"))) * F.col("_s")).alias("p"))
    close = weighted.join(F.broadcast(potential), ["nodes", "z"]).groupBy("x", "nodes").agg(F.sum(F.col("w") * F.col("p")).alias("g"))
    gap, f = F.col("f") - F.col("g"), F.col("f")
    return exact.join(own.select("x", "n"), "x").join(close, "x").groupBy("nodes").agg(F.sqrt(F.sum(F.col("n") * gap * gap) / F.sum(F.col("n") * f * f)).alias("error"))
