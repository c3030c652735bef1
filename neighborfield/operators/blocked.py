"""Boxes of a two-level tree as the partitioner of points and edges: attraction without a shuffle of edges.

Points are coded along the Morton curve of a layout. A first-level cell (at most FIRST_CELLS of them) with few points is
merged with those after it on the curve; one with many is split by the next bits of the code, and a cell that is still
too full by a hash. So a box is a stretch of the curve with about `most` points, and neighbours in the layout share boxes.

Edges are dealt once to the box of their row and kept in as many buckets as there are tasks; so are, by point, the boxes
that need a point. A step then sends each point once to each box that has an edge to it, and a box sums its rows alone:
what is shuffled is points, not edges, and no sum is combined afterwards.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neighborfield.functions.kernels import morton
from neighborfield.operators.forces import axes
from neighborfield.operators.grid import shift_to_origin

Write = Callable[[DataFrame, str], DataFrame]
FIRST_CELLS = 1 << 12
#: Bits of the code for each axis.
BITS = 16


def boxes(y: DataFrame, most: int = 1024) -> DataFrame:
    """(i, box) for a layout (i, y0, ..)."""
    dims = axes(y)
    d = len(dims)
    own = shift_to_origin(y)
    side = own.agg(F.max(F.greatest(*dims) if d > 1 else F.col(dims[0])).alias("side"))
    bits = min(BITS, 60 // d)
    cell = lambda c: F.when(F.col("side") > 0, F.least(F.floor(F.col(c) / F.col("side") * (1 << bits)), F.lit((1 << bits) - 1))).otherwise(0)
    coded = own.crossJoin(F.broadcast(side)).select("i", morton([cell(c) for c in dims], bits).alias("code"))
    first = max(1, FIRST_CELLS.bit_length() // d) * d  # bits of the code of the first level
    cells = coded.groupBy(F.shiftright("code", bits * d - first).alias("cell")).agg(F.count("*").alias("n"))
    along = Window.orderBy("cell")  # at most 2^first rows
    merged = cells.withColumn("before", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    merged = merged.select("cell", F.expr(f"before div {most}").alias("group"), F.ceil(F.col("n") / most).alias("wanted"))
    # a full cell is split by as many further bits as it has points for; its own boxes start a new group
    dealt = coded.withColumn("cell", F.shiftright("code", bits * d - first)).join(F.broadcast(merged), "cell")
    deeper = F.when(F.col("wanted") > 1, F.ceil(F.log2(F.col("wanted").cast("double")) / d) * d).otherwise(0).cast("int")
    deeper = F.least(deeper, F.lit(bits * d - first))
    second = F.expr("shiftright(inner, shift)")
    parts = dealt.withColumn("deeper", deeper).withColumn("inner", F.col("code").bitwiseAND(F.lit((1 << (bits * d - first)) - 1))).withColumn("shift", (F.lit(bits * d - first) - F.col("deeper")).cast("int"))
    parts = parts.select("i", "group", F.when(F.col("wanted") > 1, F.col("cell") + 1).otherwise(0).alias("full"), second.alias("second"))
    full = parts.groupBy("group", "full", "second").agg(F.ceil(F.count("*") / (2 * most)).alias("chunks"))
    placed = parts.join(full, ["group", "full", "second"]).withColumn("chunk", F.pmod(F.xxhash64("i"), F.col("chunks")))
    return placed.select("i", F.xxhash64("group", "full", "second", "chunk").alias("box"))


@dataclass
class BlockedGraph:
    """A graph's edges by the box of their row, and for each point the boxes that need it, both in buckets."""

    spark: SparkSession
    edges: str
    needs: str
    buckets: int

    def close(self) -> None:
        for name in (self.edges, self.needs):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def block_graph(edges: DataFrame, box: DataFrame, buckets: int | None = None) -> BlockedGraph:
    """edges (i, j, v) dealt by box (i, box): two shuffles, once for a graph. buckets: as many as shuffle partitions."""
    spark = edges.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"blocked_{kind}_{uuid.uuid4().hex}" for kind in ("edges", "needs")]
    placed = edges.join(box, "i").select("box", "i", "j", "v")
    placed.repartition(n, "box").write.bucketBy(n, "box").sortBy("box", "i").saveAsTable(names[0])
    needs = spark.table(names[0]).select("box", F.explode(F.array("j", "i")).alias("i")).distinct()
    lists = needs.groupBy("i").agg(F.collect_list("box").alias("boxes"))
    lists.repartition(n, "i").write.bucketBy(n, "i").saveAsTable(names[1])
    return BlockedGraph(spark, *names, n)


def needed_points(graph: BlockedGraph, y: DataFrame) -> DataFrame:
    """(of, i, y0, ..): each point once for each box that needs it."""
    return y.join(graph.spark.table(graph.needs), "i").select(F.explode("boxes").alias("of"), "i", *axes(y))


def blocked_attraction(graph: BlockedGraph, y: DataFrame, factor: float = 1.0) -> DataFrame:
    """(i, f0, ..): factor * sum_j v q (y_i - y_j), box by box."""
    dims = axes(y)

    def pull(edges: pa.Table, points: pa.Table) -> pa.Table:
        if not edges.num_rows:
            return pa.table([pa.array([], pa.int64()), *[pa.array([], pa.float64())] * len(dims)], names=["i", *(f"f{c[1:]}" for c in dims)])
        ids = points["i"].to_numpy()
        order = np.argsort(ids)
        ids, place = ids[order], np.stack([points[c].to_numpy() for c in dims], 1)[order]
        i = edges["i"].to_numpy()
        gap = place[np.searchsorted(ids, i)] - place[np.searchsorted(ids, edges["j"].to_numpy())]
        weight = factor * edges["v"].to_numpy() / (1 + (gap * gap).sum(1))
        rows, own = np.unique(i, return_inverse=True)
        sums = [np.bincount(own, weight * gap[:, m], len(rows)) for m in range(len(dims))]
        return pa.table([rows, *sums], names=["i", *(f"f{c[1:]}" for c in dims)])

    schema = ", ".join(["i long", *(f"f{c[1:]} double" for c in dims)])
    return graph.spark.table(graph.edges).groupBy("box").cogroup(needed_points(graph, y).groupBy("of")).applyInArrow(pull, schema)


def box_counts(edges: DataFrame, box: DataFrame) -> DataFrame:
    """(box, other, n): how many edges each pair of boxes has."""
    a, b = box.select("i", "box"), box.select(F.col("i").alias("j"), F.col("box").alias("other"))
    return edges.join(a, "i").join(b, "j").groupBy("box", "other").agg(F.count("*").alias("n"))


def box_order(y: DataFrame, box: DataFrame) -> DataFrame:
    """A permutation (old, new) that keeps boxes together, new dense from 0."""
    sizes = box.groupBy("box").agg(F.count("*").alias("n"))
    ahead = sizes.select("box", F.coalesce(F.sum("n").over(Window.orderBy("box").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("box").orderBy("i")) - 1
    return y.select("i").join(box, "i").withColumn("r", within).join(ahead, "box").select(F.col("i").alias("old"), (F.col("r") + F.col("ahead")).cast("long").alias("new"))
