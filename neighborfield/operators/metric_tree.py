"""Exact nearest neighbours by a metric tree: points are dealt to its leaves, balls decide which leaves a query visits.

The tree is fitted on a bounded sample and every point is dealt by it. A point first asks in its own leaf; the distance
of its k-th neighbour there bounds what is left, and it is sent only to leaves whose ball it reaches. Where distances
hardly differ (independent components in many dimensions) no bound prunes; a point that would visit more than an eighth of
the leaves isn't sent to them, all points pass by it in packed blocks instead (pair_blocks). A leaf of more than `leaf` points, however hot, is dealt into blocks, its queries into chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborfield.functions.array_metrics import PAIRS
from neighborfield.operators import pair_blocks
from neighborfield.operators.knn import SLACK, dense, in_cells, ranked

#: Points of a leaf or block, sampled points of a leaf, and leaves at most.
LEAF, SAMPLE, LEAVES = 2048, 16, 8192


@dataclass
class Node:
    """A ball; an inner node's points are those of its two children, a leaf has a number."""

    centre: np.ndarray
    left: Node | None = None
    right: Node | None = None
    number: int = -1
    radius: float = 0.0


def grow(x: np.ndarray, leaves: int) -> tuple[Node, list[Node]]:
    """A tree over sample points: the largest node is split between two far points until there are so many leaves."""
    root = Node(x.mean(0))
    open_ = [(root, x)]
    while len(open_) < leaves:
        open_.sort(key=lambda p: len(p[1]))
        node, own = open_.pop()
        a = own[((own - own[0]) ** 2).sum(1).argmax()]
        b = own[((own - a) ** 2).sum(1).argmax()]
        side = ((own - a) ** 2).sum(1) <= ((own - b) ** 2).sum(1)
        if side.all():  # all equal, so the largest node can't be split
            open_.append((node, own))
            break
        node.left, node.right = Node(own[side].mean(0)), Node(own[~side].mean(0))
        open_ += [(node.left, own[side]), (node.right, own[~side])]
    for k, (node, _) in enumerate(open_):
        node.number = k
    return root, [n for n, _ in open_]


def distance(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - centre) ** 2).sum(1))


def leaf_of(node: Node, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Each row goes to the child whose centre is nearer."""
    if node.number >= 0 or not len(rows):
        out[rows] = node.number
        return
    side = distance(x[rows], node.left.centre) <= distance(x[rows], node.right.centre)
    leaf_of(node.left, x, rows[side], out)
    leaf_of(node.right, x, rows[~side], out)


def cover(node: Node, radii: dict[int, float]) -> float:
    """Sets balls from the leaves' radii upwards; an empty leaf has none."""
    if node.number >= 0:
        node.radius = radii.get(node.number, -np.inf)
    else:
        node.radius = max(cover(child, radii) + float(np.sqrt(((child.centre - node.centre) ** 2).sum())) for child in (node.left, node.right))
    return node.radius


def visits(node: Node, x: np.ndarray, reach: np.ndarray, rows: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(rows, leaf): which rows may have neighbours within their reach in a leaf that isn't their own."""
    away = distance(x[rows], node.centre)
    rows = rows[away - node.radius <= reach[rows] + SLACK * (1 + away)]
    if not len(rows):
        return
    if node.number >= 0:
        rows = rows[own[rows] != node.number]
        if len(rows):
            yield rows, node.number
        return
    yield from visits(node.left, x, reach, rows, own)
    yield from visits(node.right, x, reach, rows, own)


def tree_knn(points: DataFrame, k: int, write, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """points (i, x). (i, j, rank, d2) of the k nearest, ties by j; and (i, leaf), the visits beyond a point's own leaf.

    write(df, name) gives a written copy: what the rounds share is computed once."""
    n = points.count()
    leaves = int(min(LEAVES, max(1, -(-n // leaf))))
    sample = points.select("x").orderBy(F.xxhash64("i")).limit(leaves * SAMPLE).toArrow()["x"]
    root, _ = grow(dense(sample), leaves) if n else (Node(np.zeros(0), number=0), [])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres: dict[int, np.ndarray] = {}

        def collect(node: Node) -> None:
            if node.number >= 0:
                centres[node.number] = node.centre
            else:
                collect(node.left)
                collect(node.right)

        collect(root)
        for b in batches:
            x = dense(b["x"])
            own = np.zeros(len(x), np.int64)
            leaf_of(root, x, np.arange(len(x)), own)
            away = np.zeros(len(x))
            for number in np.unique(own).tolist():
                away[own == number] = distance(x[own == number], centres[number])
            yield pa.RecordBatch.from_arrays([b["i"], b["x"], own.astype(np.int32), away], names=["i", "x", "leaf", "away"])

    dealt = write(points.select("i", "x").mapInArrow(deal, "i long, x array<double>, leaf int, away double"), "tree-points")
    sizes = dealt.groupBy("leaf").agg(F.max("away").alias("radius"))
    cover(root, dict(sizes.collect()))  # a row for each leaf
    listed = dealt.select("i", "x", F.col("leaf").alias("cell"))
    first = write(ranked(in_cells(listed.withColumn("reach", F.lit(float("inf"))), listed, k, LEAF), k).drop("rank"), "tree-first")
    reach = first.groupBy("i").agg(F.when(F.count("*") >= k, F.sqrt(F.max("d2"))).alias("r"))
    bounded = dealt.join(reach, "i", "left").select("i", "x", "leaf", F.coalesce("r", F.lit(float("inf"))).alias("reach"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, own = dense(b["x"]), b["leaf"].to_numpy()
            found = [(rows, np.full(len(rows), number, np.int32)) for rows, number in visits(root, x, b["reach"].to_numpy(), np.arange(len(x)), own)]
            rows, leaf = map(np.concatenate, zip((np.zeros(0, np.int64), np.zeros(0, np.int32)), *found, strict=True))
            order = np.argsort(rows, kind="stable")
            starts = np.searchsorted(rows[order], np.arange(len(x) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["i"], b["x"], b["reach"], pa.ListArray.from_arrays(pa.array(starts), pa.array(leaf[order]))], names=["i", "x", "reach", "leaves"])

    sent = write(bounded.mapInArrow(search, "i long, x array<double>, reach double, leaves array<int>"), "tree-visits")
    many = F.size("leaves") > max(pair_blocks.CHUNKS, leaves // 8)
    second = in_cells(sent.filter(~many).select("i", "x", F.explode("leaves").alias("cell"), "reach"), listed, k, LEAF)
    found = ranked(first.join(sent.filter(many).select("i"), "i", "left_anti").unionByName(second), k)
    if leaves > pair_blocks.CHUNKS:
        found = found.unionByName(pair_blocks.nearest(sent.filter(many), dealt, k, PAIRS["euclidean"]))
    return found, sent.select("i", F.explode("leaves").alias("leaf"))
