"""Repulsion by a 2^d-tree: cells with their points' number and mean stand for far points.

Cells are made bottom-up: points are counted in cells of the finest level, and each level is summed from the one below. A
point accepts a cell of side s at distance r from its mean if s < theta * r, and also cells of one point and of the finest
level; a cell that it doesn't accept is replaced by its children. A cell that holds the point counts without it.

Points that are near each other are walked together: for a block (a cell, cut into chunks if it holds many points) the
cells that any of its points may visit are found by one join a level, from the block's box; then a task has a chunk and
these few cells and decides for each point apart. So a row is a block and a cell, never a point and a cell.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborfield.functions.kernels import morton
from neighborfield.operators.forces import axes
from neighborfield.operators.grid import shift_to_origin

THETA = 0.5
#: Points of a chunk, cells up to which a level is broadcast, and the widest cell of the finest level: the kernel changes over
#: a length of 1, so what such a cell blurs is about the square of this.
CHUNK, SMALL_LEVEL, FINEST = 1024, 1 << 16, 0.02
Write = Callable[[DataFrame, str], DataFrame]


def tree_depth(n: int, d: int, side: float) -> int:
    """Levels below the root: about 2^3d cells for each point, were they even, and none wider than FINEST; at most 20."""
    wide = int(np.ceil(np.log2(max(side / FINEST, 1.0))))
    return min(60 // d, 20, max(-(-max(n, 1).bit_length() // d) + 3, wide))


def coded(y: DataFrame, depth: int) -> DataFrame:
    """Points moved to the origin with their cell of the finest level (Morton code) and the root's side."""
    dims = axes(y)
    own = shift_to_origin(y)
    most = own.agg(F.max(F.greatest(*dims) if len(dims) > 1 else F.col(dims[0])).alias("side"))
    place = lambda c: F.when(F.col("side") > 0, F.least(F.floor(F.col(c) / F.col("side") * (1 << depth)), F.lit((1 << depth) - 1))).otherwise(0).cast("long")
    return own.crossJoin(F.broadcast(most)).withColumn("code", morton([place(c) for c in dims], depth))


def tree_cells(points: DataFrame, depth: int, write: Write) -> list[DataFrame]:
    """For each level from the root (code, n, s0, ..): occupied cells, their points and sums of coordinates."""
    dims = axes(points)
    d = len(dims)
    sums = [f"s{c[1:]}" for c in dims]
    level = write(points.groupBy("code").agg(F.count("*").alias("n"), *(F.sum(c).alias(s) for c, s in zip(dims, sums, strict=True))), f"tree-{depth}")
    out = [level]
    for k in range(depth - 1, -1, -1):
        level = write(level.groupBy(F.shiftright("code", d).alias("code")).agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in sums)), f"tree-{k}")
        out.append(level)
    return out[::-1]


def _needed(points: DataFrame, cells: list[DataFrame], block_level: int, theta: float, write: Write) -> tuple[DataFrame, DataFrame]:
    """(block, chunks, box) of the blocks; and (block, level, code, n, s0..) of the cells that their points may visit."""
    dims = axes(points)
    d, depth = len(dims), len(cells) - 1
    sums = [f"s{c[1:]}" for c in dims]
    shift = d * (depth - block_level)
    boxes = [f(c).alias(f"{name}{c[1:]}") for c in dims for name, f in (("lo", F.min), ("hi", F.max))]
    blocks = write(points.groupBy(F.shiftright("code", shift).alias("block")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.max("side").alias("side"), *boxes), "tree-blocks")
    box = ["block", "side", *(f"{e}{c[1:]}" for c in dims for e in ("lo", "hi"))]
    frontier = write(blocks.select(*box).join(F.broadcast(cells[0]), how="cross"), "tree-walk-0")
    walks = [frontier.select("block", F.lit(0).alias("level"), "code", "n", *sums)]
    for k in range(1, depth + 1):
        gap = [F.greatest(F.col(f"lo{c[1:]}") - F.col(s) / F.col("n"), F.col(s) / F.col("n") - F.col(f"hi{c[1:]}"), F.lit(0.0)) for c, s in zip(dims, sums, strict=True)]
        near = sum(g * g for g in gap)
        side = F.col("side") / (1 << (k - 1))
        # some point may not accept it: the box's nearest place does not, with room for rounding
        open_ = frontier.filter((F.col("n") > 1) & (side * side >= theta * theta * near * (1 - 1e-9))).select(*box, F.col("code").alias("parent"))
        children = cells[k].withColumn("parent", F.shiftright("code", d))
        small = 1 << (d * k) <= SMALL_LEVEL
        frontier = write(open_.join(F.broadcast(children) if small else children, "parent").drop("parent"), f"tree-walk-{k}")
        walks.append(frontier.select("block", F.lit(k).alias("level"), "code", "n", *sums))
    every = walks[0]
    for w in walks[1:]:
        every = every.unionByName(w)
    return blocks, every


def _walk(d: int, depth: int, theta: float):
    """The sums of a chunk of points over its cells."""

    def run(own: pa.Table, cells: pa.Table) -> pa.Table:
        names = ["i", *(f"p{m}" for m in range(d)), "z"]
        n = own.num_rows
        y = np.stack([own[f"y{m}"].to_numpy() for m in range(d)], 1) if n else np.zeros((0, d))
        code, side = own["code"].to_numpy(), own["side"][0].as_py() if n else 0.0
        push, z = np.zeros((n, d)), np.zeros(n)
        level, at, count = cells["level"].to_numpy(), cells["code"].to_numpy(), cells["n"].to_numpy()
        sums = np.stack([cells[f"s{m}"].to_numpy() for m in range(d)], 1) if cells.num_rows else np.zeros((0, d))
        levels = []
        for k in range(depth + 1):
            rows = np.flatnonzero(level == k)
            levels.append(rows[np.argsort(at[rows], kind="stable")])
        for lo in range(0, n, 128):
            p, c = y[lo : lo + 128], code[lo : lo + 128]
            opened = np.ones((len(p), 1), bool)
            for k, rows in enumerate(levels):
                if k:
                    parents = np.searchsorted(at[levels[k - 1]], at[rows] >> d)
                    visited = opened[:, parents]
                else:
                    visited = opened
                rows, visited = rows[keep := visited.any(0)], visited[:, keep]
                inside = (c[:, None] >> (d * (depth - k))) == at[rows][None, :]
                mean = sums[rows] / count[rows][:, None]
                gap = p[:, None, :] - mean[None]
                r2 = (gap * gap).sum(2)
                taken = visited & ((count[rows] == 1)[None] | (k == depth) | ((side / (1 << k)) ** 2 < theta * theta * r2))
                a, b = np.nonzero(taken & inside)  # without the point itself
                others = (count[rows][b] - 1).astype(float)
                rest = (sums[rows][b] - p[a]) / np.maximum(others, 1)[:, None]
                gap[a, b] = (p[a] - rest) * (others > 0)[:, None]
                weight = np.where(taken, count[rows][None].astype(float), 0.0)
                weight[a, b] = others
                q = 1 / (1 + (gap * gap).sum(2))
                z[lo : lo + 128] += (weight * q).sum(1)
                push[lo : lo + 128] += ((weight * q * q)[:, :, None] * gap).sum(1)
                opened = np.zeros((len(p), len(levels[k])), bool)
                opened[:, np.flatnonzero(keep)] = visited & ~taken
        return pa.table([own["i"], *push.T, z], names=names)

    return run


def tree_sums(y: DataFrame, write: Write, theta: float = THETA, depth: int | None = None, chunk_level: int | None = None) -> DataFrame:
    """(i, p0.., z): of each point the sums of q^2 times the gap and of q over the others, far ones by their cells."""
    dims = axes(y)
    d = len(dims)
    n, *ends = y.agg(F.count("*"), *(F.coalesce(F.max(c) - F.min(c), F.lit(0.0)) for c in dims)).first()
    depth = depth if depth is not None else tree_depth(n, d, max(ends))
    points = write(coded(y, depth), "tree-coded")
    cells = tree_cells(points, depth, write)
    block_level = chunk_level if chunk_level is not None else min(depth, max(0, (n // CHUNK).bit_length() // d))
    blocks, needed = _needed(points, cells, block_level, theta, write)
    sizes = blocks.select("block", "chunks")
    dealt = points.withColumn("block", F.shiftright("code", d * (depth - block_level))).join(sizes, "block").withColumn("chunk", F.pmod(F.xxhash64("i"), F.col("chunks")).cast("int"))
    parts = blocks.select(F.col("block").alias("of"), F.col("chunks").alias("parts"))
    lists = needed.select(F.col("block").alias("of"), *(c for c in needed.columns if c != "block")).join(parts, "of").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    schema = ", ".join(["i long", *(f"p{m} double" for m in range(d)), "z double"])
    return dealt.groupBy("block", "chunk").cogroup(lists.groupBy("of", "part")).applyInArrow(_walk(d, depth, theta), schema)


def repulsion_tree(y: DataFrame, write: Write, theta: float = THETA, depth: int | None = None) -> DataFrame:
    """Repulsive force (i, f0, ..) through the tree."""
    sums = write(tree_sums(y, write, theta, depth), "tree-sums")
    zeta = sums.agg(F.sum("z").alias("zeta"))
    return sums.crossJoin(F.broadcast(zeta)).select("i", *((F.col(f"p{c[1:]}") / F.col("zeta")).alias(f"f{c[1:]}") for c in axes(y)))
