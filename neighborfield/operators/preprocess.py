"""Preparation of points (i, x): standard scores, ranges, covariance, principal components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def without_nan(points: DataFrame) -> DataFrame:
    """Rows all of whose components are numbers."""
    return points.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))


def first_points(points: DataFrame, n: int) -> DataFrame:
    """The rows with id below n, as a row limit on a file would give."""
    return points.filter(F.col("i") < n)


def components(points: DataFrame) -> DataFrame:
    """(i, m, v), one row a component."""
    return points.select("i", F.posexplode("x").alias("m", "v"))


def turned(points: DataFrame, run: int = 4096) -> DataFrame:
    """The components as points (i, x), each with as many components as there were points, in order of their numbers. Points
    are cut into runs of about `run` in that order and turned run by run, so a component is gathered from arrays, not from a row for each value."""
    parts = max(1, -(-points.count() // run))
    dealt = points.select("i", "x").repartitionByRange(parts, "i").sortWithinPartitions("i")

    def turn(batches):
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).T
            at = pa.array(np.arange(0, x.size + 1, max(1, batch.num_rows), dtype=np.int32))
            first = pa.array(np.full(len(x), batch["i"][0].as_py() if batch.num_rows else 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), first, pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(x).reshape(-1)))], names=["m", "first", "x"])

    runs = dealt.mapInArrow(turn, "m long, first long, x array<double>")
    return runs.groupBy(F.col("m").alias("i")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("first", "x"))), lambda z: z["x"])).alias("x"))


def _packed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "v"))), lambda z: z["v"]).alias("x"))


def column_stats(points: DataFrame) -> DataFrame:
    """(m, mean, sd) with the sample deviation."""
    return components(points).groupBy("m").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))


def standardise(points: DataFrame) -> DataFrame:
    """z-scores; a constant component becomes 0. The statistics are one row of arrays, carried to every point."""
    stats = column_stats(points).agg(F.sort_array(F.collect_list(F.struct("m", "mean", "sd"))).alias("s"))
    both = points.crossJoin(F.broadcast(stats))
    return both.select("i", F.zip_with("x", "s", lambda v, s: F.when(s["sd"] > 0, (v - s["mean"]) / s["sd"]).otherwise(0.0)).alias("x"))


def minmax_centre(points: DataFrame) -> DataFrame:
    """Less the least of all components, divided by the most, less each component's mean."""
    whole = points.agg(F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi"))
    scaled = points.crossJoin(F.broadcast(whole)).select("i", F.transform("x", lambda v: F.when(F.col("hi") > F.col("lo"), (v - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)).alias("x"))
    means = components(scaled).groupBy("m").agg(F.avg("v").alias("mean")).agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "mean"))), lambda z: z["mean"]).alias("mean"))
    return scaled.crossJoin(F.broadcast(means)).select("i", F.zip_with("x", "mean", lambda v, m: v - m).alias("x"))


def outer_sums(points: DataFrame, means: list[float]) -> DataFrame:
    """(a, b, s) for a <= b: sums over points of products of components less their means; a matrix for each task, of the
    dimensions squared, and no row for a point."""

    def run(batches):
        total = np.zeros((len(means), len(means)))
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - means
            total += x.T @ x
        a, b = np.triu_indices(len(means))
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], names=["a", "b", "s"])

    return points.select("x").mapInArrow(run, "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s"))


def component_means(points: DataFrame) -> tuple[int, list[float]]:
    """How many points there are, and each component's mean."""
    rows = components(points).groupBy("m").agg(F.avg("v").alias("mean"), F.count("*").alias("n")).orderBy("m").collect()
    return (rows[0].n if rows else 0), [r["mean"] for r in rows]


def covariance(points: DataFrame) -> DataFrame:
    """(a, b, cov) for a <= b: sample covariance from sums about the means."""
    n, means = component_means(points)
    return outer_sums(points, means).select("a", "b", (F.col("s") / max(n - 1, 1)).alias("cov"))


def _symmetric(rows: list, n: int, value: str) -> np.ndarray:
    out = np.zeros((n, n))
    for r in rows:
        out[r["a"], r["b"]] = out[r["b"], r["a"]] = r[value]
    return out


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the largest entry of each is positive."""
    return vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)


def pca(points: DataFrame, dims: int) -> DataFrame:
    """(i, x) projected on the `dims` leading principal axes, each signed so that its largest entry is positive.

    With more points than components the axes are eigenvectors of the covariance, with fewer those of the points' own
    products (see pca_dual): the smaller matrix, whose size is not that of the points' table, comes to the driver."""
    n, means = component_means(points)
    if n <= len(means):
        return pca_dual(points, dims)
    values, vectors = np.linalg.eigh(_symmetric(outer_sums(points, means).collect(), len(means), "s"))
    lead = _signed(vectors[:, np.argsort(values)[::-1][:dims]])
    return _projected(points, np.array(means), lead)


def _projected(points: DataFrame, means: np.ndarray, axes: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = (batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - means) @ axes
            at = pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch["i"], pa.ListArray.from_arrays(at, pa.array(x.reshape(-1)))], names=["i", "x"])

    return points.select("i", "x").mapInArrow(run, "i long, x array<double>")


def _cut(points: DataFrame, block: int) -> DataFrame:
    """(n, k, x): the k-th block of components of the n-th point in order of i."""
    numbered = points.withColumn("n", F.row_number().over(Window.orderBy("i")) - 1)  # fewer points than components
    cut = F.expr(f"transform(sequence(0, (size(x) - 1) div {block}), k -> slice(x, k * {block} + 1, {block}))")
    return numbered.select("n", F.posexplode(cut).alias("k", "x"))


def gram(points: DataFrame, block: int = 4096) -> DataFrame:
    """(a, b, s) for a <= b: products of points, less the components' means, by their number in order of i. Components are
    cut into blocks; a task has a block of all points' components, so this is for fewer points than components."""
    parts = _cut(points, block)

    def run(part: pa.Table) -> pa.Table:
        order = np.argsort(part["n"].to_numpy())
        x = np.stack(part["x"].to_numpy())[order]
        x = x - x.mean(0)
        products = x @ x.T
        a, b = np.triu_indices(len(x))
        return pa.table([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(products[a, b])], names=["a", "b", "s"])

    return parts.groupBy("k").applyInArrow(run, "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s"))


def pca_dual(points: DataFrame, dims: int, block: int = 4096) -> DataFrame:
    """The same projections from the eigenvectors of the points' products, for at least as many components as points.

    The product matrix has the points' number squared entries; an axis is never made, only its sign is looked at."""
    n, _ = component_means(points)
    values, vectors = np.linalg.eigh(_symmetric(gram(points, block).collect(), n, "s"))
    order = np.argsort(values)[::-1][:dims]
    lead = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    table = points.sparkSession.createDataFrame([(k, own) for k, own in enumerate(lead.tolist())], "n int, own array<double>")
    numbered = points.select("i", (F.row_number().over(Window.orderBy("i")) - 1).alias("n"))
    # axis m = sum over points of (x - mean) * vector; the mean falls out, for vectors with a value sum to zero
    weights = np.ascontiguousarray(vectors[:, order])

    def largest(part: pa.Table) -> pa.Table:
        by = np.argsort(part["n"].to_numpy())
        axes = np.stack(part["x"].to_numpy())[by].T @ weights
        m = np.abs(axes).argmax(0)
        return pa.table([np.arange(len(m)), m + part["k"][0].as_py() * block, axes[m, np.arange(len(m))]], names=["axis", "m", "a"])

    found = _cut(points, block).groupBy("k").applyInArrow(largest, "axis long, m long, a double")  # a row for each block and axis
    turned = dict(found.groupBy("axis").agg(F.max_by("a", F.struct(F.abs("a"), -F.col("m"))).alias("a")).collect())
    signs = F.array(*(F.lit(-1.0 if turned[k] < 0 else 1.0) for k in range(len(order))))
    return numbered.join(F.broadcast(table), "n").select("i", F.zip_with("own", signs, lambda v, s: v * s).alias("x"))


def component_ranks(points: DataFrame) -> DataFrame:
    """Average ranks of each row's components, for rank correlation."""
    parts = components(points)
    within = Window.partitionBy("i")
    r = F.rank().over(within.orderBy("v")) + (F.count("*").over(Window.partitionBy("i", "v")) - 1) / 2
    return _packed(parts.withColumn("v", r.cast("double")).select("i", "m", "v"))


def whiten(points: DataFrame) -> DataFrame:
    """Points in which euclidean distance is the mahalanobis distance of the given ones."""
    rows = covariance(points).collect()
    values, vectors = np.linalg.eigh(_symmetric(rows, 1 + max(r.b for r in rows), "cov"))
    root = vectors / np.sqrt(np.maximum(values, 1e-300))
    return _projected(points, np.zeros(len(root)), root)


def permute_points(points: DataFrame, permutation: DataFrame) -> DataFrame:
    """permutation (old, new)."""
    return points.join(permutation.select(F.col("old").alias("i"), "new"), "i").select(F.col("new").alias("i"), "x")


def extract(points: DataFrame, dims: list[int]) -> DataFrame:
    return points.select("i", F.array(*(F.get("x", F.lit(m)) for m in dims)).alias("x"))


def tangle(y: DataFrame, bits: int = 10) -> DataFrame:
    """Points with the Morton code of their quantised coordinates, in order of it over range partitions."""
    from neighborfield.functions.kernels import morton
    from neighborfield.operators.forces import axes
    from neighborfield.operators.grid import shift_to_origin

    dims = axes(y)
    own = shift_to_origin(y)
    most = own.agg(F.max(F.greatest(*dims) if len(dims) > 1 else F.col(dims[0])).alias("_most"))
    cell = lambda c: F.when(F.col("_most") > 0, F.floor(F.col(c) / F.col("_most") * ((1 << bits) - 1))).otherwise(0)
    return own.crossJoin(F.broadcast(most)).withColumn("code", morton([cell(c) for c in dims], bits)).drop("_most").orderBy("code", "i")


def bins(y: DataFrame, bits: int = 10) -> DataFrame:
    """(code, start, count): where each occupied bin of the tangled points begins, and how many it has."""
    from neighborfield.operators.formats import offsets

    return offsets(tangle(y, bits), "code").withColumnRenamed("degree", "count")
