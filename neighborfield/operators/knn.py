"""Nearest neighbours: exact in blocks, by inverted cells, by random projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neighborfield.functions.array_metrics import PAIRS, PREPARED, Pairs, Sharing
from neighborfield.functions.kernels import squared_l2
from neighborfield.operators import pair_blocks, preprocess
from neighborfield.operators.pair_blocks import dense

KNN = "i long, j long, d2 double"
#: Bounds are rounded; so much of the distances is added.
SLACK = 1e-9
#: Buckets with so large a part of all pairs are not told apart before pairs are compared.
MEET = 8


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each i, ties by j: (i, j, rank, d2)."""
    nearest = Window.partitionBy("i").orderBy("d2", "j")
    return pairs.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("i", "j", "rank", "d2")


def exact_knn(points: DataFrame, k: int, block: int = pair_blocks.LEAST_QUERIES) -> DataFrame:
    """points (i, x). All pairs are compared: a task has a chunk of queries (of at least `block` points where there are so
    many) and all points pass by it, so at most k rows leave it for each query and no pair of points is a row."""
    return pair_blocks.nearest(points, points, k, PAIRS["euclidean"], block)


def cross_knn(points: DataFrame, k: int) -> DataFrame:
    """The definition, as one relational plan, for tests and small tables."""
    a, b = points.select("i", F.col("x").alias("xi")), points.select(F.col("i").alias("j"), F.col("x").alias("xj"))
    return ranked(a.crossJoin(b).filter("i <> j").select("i", "j", squared_l2(F.col("xi"), F.col("xj")).alias("d2")), k)


def centroids(points: DataFrame, cells: int, seed: int = 0, rounds: int = 10) -> np.ndarray:
    """k-means centres by Spark ML."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = points.select(array_to_vector("x").alias("features"))
    return np.array(KMeans(k=cells, seed=seed, maxIter=rounds).fit(data).clusterCenters())


def nearest_in_group(k: int, short_list: int = 0, decode=None):
    """Of a group's queries (asks) and points, each query's k nearest within its reach.

    short_list: the so many nearest by the points' codes, which decode turns into vectors, are compared by their own."""
    pairs = PAIRS["euclidean"]

    def run(part: pa.Table) -> pa.Table:
        asks = part["asks"].to_numpy()
        x, i, reach = dense(part["x"]), part["i"].to_numpy(), part["reach"].to_numpy()
        a, b, ia, ib = x[asks], x[~asks], i[asks], i[~asks]
        bound = (reach[asks] * (1 + SLACK) + SLACK) ** 2
        if not (len(a) and len(b)):
            return pa.table([np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], names=["i", "j", "d2"])
        if not decode or short_list >= len(b):
            own = pair_blocks.Nearest(ia, a, k, pairs, bound)
            own.see(ib, b)
            return pa.Table.from_batches(own.rows(), pair_blocks.FOUND).drop_columns(["rank"])
        coarse = decode(dense(part.filter(pa.array(~asks))["codes"]).astype(np.int64))
        out: list[list[np.ndarray]] = [[], [], []]
        for lo in range(0, len(a), 64):
            own = a[lo : lo + 64]
            rough = (coarse * coarse).sum(1)[None] - 2 * own @ coarse.T
            rough[ia[lo : lo + 64, None] == ib[None, :]] = np.inf
            near = np.argpartition(rough, short_list - 1, axis=1)[:, :short_list]
            d2 = pairs.squared(np.repeat(own, short_list, 0), b[near.ravel()]).reshape(near.shape)
            d2[ia[lo : lo + 64, None] == ib[near]] = np.inf
            n = min(k, d2.shape[1])
            # the n smallest, and all that tie with the last of them: the final rank decides among ties by j
            edge = np.minimum(np.partition(d2, n - 1, axis=1)[:, n - 1], bound[lo : lo + 64])
            q, c = np.nonzero((d2 <= edge[:, None]) & np.isfinite(d2))
            for column, found in zip(out, (ia[lo : lo + 64][q], ib[near[q, c]], d2[q, c]), strict=True):
                column.append(found)
        return pa.table([np.concatenate(c) for c in out], names=["i", "j", "d2"])

    return run


def in_cells(queries: DataFrame, listed: DataFrame, k: int, block: int = 2048, short_list: int = 0, decode=None) -> DataFrame:
    """(i, j, d2): neighbours of queries (i, x, cell, reach) among the points listed (i, x, cell, and codes to decode) in
    the same cell, at most k (and ties) for each query and group.

    A cell of more than `block` points is dealt into blocks, its queries into chunks, so a group is bounded however hot its
    cell is; only such cells are in the tables of sizes. No pair of points is a row."""
    large = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name)).filter(F.col(name) > 1)
    blocks, chunks = large(listed, "blocks"), large(queries, "chunks")
    sized = lambda df: df.join(blocks, "cell", "left").join(chunks, "cell", "left").fillna(1, ["blocks", "chunks"])
    codes = F.col("codes") if "codes" in listed.columns else F.lit(None).cast("array<int>")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    own = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "i"), F.col(n)).cast("int")
    asking = sized(queries).select("cell", every("blocks").alias("block"), own("chunk", "chunks").alias("chunk"), F.lit(True).alias("asks"), "i", "x", "reach", F.lit(None).cast("array<int>").alias("codes"))
    asked = sized(listed).select("cell", own("block", "blocks").alias("block"), every("chunks").alias("chunk"), F.lit(False).alias("asks"), "i", "x", F.lit(0.0).alias("reach"), codes.alias("codes"))
    return asking.unionByName(asked).groupBy("cell", "block", "chunk").applyInArrow(nearest_in_group(k, short_list, decode), KNN)


def _prepared(points: DataFrame, distance: str) -> tuple[DataFrame, Pairs]:
    """Points and the distance of array_metrics that stand for a distance of points."""
    if distance == "seuclidean":
        sd = preprocess.column_stats(points).agg(F.sort_array(F.collect_list(F.struct("m", "sd"))).alias("s"))
        points = points.crossJoin(F.broadcast(sd)).select("i", F.zip_with("x", "s", lambda v, s: F.when(s["sd"] > 0, v / s["sd"]).otherwise(0.0)).alias("x"))
    elif distance == "mahalanobis":
        points = preprocess.whiten(points)
    elif distance == "spearman":
        points = preprocess.component_ranks(points)
    name = PREPARED.get(distance, distance)
    if name not in PAIRS:
        raise ValueError(f"no distance {distance}")
    return points, PAIRS[name]


def metric_knn(points: DataFrame, k: int, distance: str) -> DataFrame:
    """The k nearest by any distance of array_metrics: (i, j, rank, d2), d2 its square. All pairs are compared, as in exact_knn."""
    points, pairs = _prepared(points, distance)
    return pair_blocks.nearest(points, points, k, pairs)


def metric_summaries(points: DataFrame, distance: str) -> DataFrame:
    """(i, least, most, total) of any distance of array_metrics from each point to all others."""
    return pair_blocks.summaries(*_prepared(points, distance))


def _dealt(points: DataFrame, centres: np.ndarray, probes: int, code=None) -> DataFrame:
    """(i, x, cells, codes): numbers of each point's nearest centres, nearest first, and its codes."""
    lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.reshape(-1).astype(np.int32)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = dense(b["x"])
            d2 = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
            order = np.argsort(d2, axis=1, kind="stable")[:, :probes]
            codes = lists(code(x)) if code else pa.nulls(b.num_rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b["i"], b["x"], lists(order), codes], names=["i", "x", "cells", "codes"])

    return points.select("i", "x").mapInArrow(near, "i long, x array<double>, cells array<int>, codes array<int>")


def ivf_knn(points: DataFrame, k: int, cells: int | None = None, probes: int = 20, seed: int = 0) -> DataFrame:
    """Inverted cells: a point asks in the cells of its `probes` nearest centres. cells: sqrt(n) unless given."""
    cells = cells or max(1, int(points.count() ** 0.5))
    centres = centroids(points, cells, seed)
    dealt = _dealt(points, centres, min(probes, len(centres)))
    queries = dealt.select("i", "x", F.explode("cells").alias("cell"), F.lit(float("inf")).alias("reach"))
    return ranked(in_cells(queries, dealt.select("i", "x", F.get("cells", F.lit(0)).alias("cell")), k), k)


def ivfpq_knn(points: DataFrame, k: int, cells: int | None = None, probes: int = 20, parts: int = 2, codes: int = 256, seed: int = 0, short_list: int = 32) -> DataFrame:
    """As ivf_knn, but points are compared by the nearest code of each of `parts` sub-vectors first; the nearest
    short_list * k of a group by them are ranked by their true distance."""
    n, width = points.count(), len(points.first()["x"])
    edges = np.linspace(0, width, parts + 1).astype(int)
    books = [centroids(points.select(F.slice("x", int(a) + 1, int(b - a)).alias("x")), min(codes, n), seed) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    centres = centroids(points, cells or max(1, int(n**0.5)), seed)

    def code(x: np.ndarray) -> np.ndarray:
        parted = zip(books, edges[:-1], edges[1:], strict=True)
        return np.stack([((book * book).sum(1)[None] - 2 * x[:, lo:hi] @ book.T).argmin(1) for book, lo, hi in parted], 1)

    def decode(c: np.ndarray) -> np.ndarray:
        return np.concatenate([book[c[:, m]] for m, book in enumerate(books)], 1)

    dealt = _dealt(points, centres, min(probes, len(centres)), code)
    queries = dealt.select("i", "x", F.explode("cells").alias("cell"), F.lit(float("inf")).alias("reach"))
    return ranked(in_cells(queries, dealt.select("i", "x", F.get("cells", F.lit(0)).alias("cell"), "codes"), k, short_list=short_list * k, decode=decode), k)


def lsh_knn(points: DataFrame, k: int, bucket: float, tables: int = 8, seed: int = 0) -> DataFrame:
    """Random projections: points that share a bucket of any of `tables` hashes are compared, bucket by bucket. Where buckets
    are so coarse that they hold many of all pairs (MEET), and most more than once, all points pass by all queries once
    instead, and pairs without a shared bucket are left out: the same rows."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = points.select("i", "x", array_to_vector("x").alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(data)
    known = model.transform(data)
    known = known.select("i", "x", F.array(*(F.get(vector_to_array(F.get("hashes", F.lit(t))), F.lit(0)) for t in range(tables))).alias("h"))
    hashed = known.select("i", "x", F.posexplode("h").alias("table", "h")).select("i", "x", F.struct("table", F.col("h").cast("long").alias("h")).alias("cell"))
    n, met = points.count(), hashed.groupBy("cell").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    if (met or 0) * MEET >= n * n:
        whole = known.select("i", F.concat("x", "h").alias("x"))
        return pair_blocks.nearest(whole, whole, k, Sharing(tables))
    found = in_cells(hashed.withColumn("reach", F.lit(float("inf"))), hashed, k)
    return ranked(found.dropDuplicates(["i", "j"]), k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of true neighbours that were found: one row."""
    hits = truth.select("i", "j").join(found.select("i", "j").withColumn("hit", F.lit(1.0)), ["i", "j"], "left")
    return hits.agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
