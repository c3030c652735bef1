"""Nested dissection by multilevel vertex separators, in rounds over edge tables.

A graph is halved part by part, all parts of a round at once. Nodes are matched with their heaviest neighbour and
contracted until a part has at most COARSE nodes; that bounded graph is halved by its Fiedler vector in a task; halves
are carried back level by level, and at each level nodes on the border move where that shortens the cut and keeps the
balance. The border nodes of the smaller border are the separator. In the order, each half comes before its separator, so
factors fill inside the halves and the separators only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Write = Callable[[DataFrame, str], DataFrame]
#: Nodes of a part that a task halves, rounds of matching for a level, rounds of moves, largest share of a half.
COARSE, MATCHINGS, MOVES, MOST_SHARE = 256, 3, 4, 0.6


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select("part", F.col("b").alias("a"), F.col("a").alias("b"), "v"))


def _matching(nodes: DataFrame, edges: DataFrame, level: int, write: Write) -> DataFrame:
    """(node, to): partners get one name, the smaller of theirs; others keep their own.

    A node points at its heaviest free neighbour (ties by a hash of the pair, which both see alike); two that point at
    each other are partners."""
    free, pairs = nodes.select("node"), None
    for k in range(MATCHINGS):
        open_ = _both(edges).join(free.select(F.col("node").alias("a")), "a", "left_semi").join(free.select(F.col("node").alias("b")), "b", "left_semi")
        best = F.max(F.struct("v", F.xxhash64(F.least("a", "b"), F.greatest("a", "b"), F.lit(k)).alias("h"), "b"))["b"]
        choice = write(open_.groupBy("a").agg(best.alias("b")), f"choice-{level}-{k}")
        mutual = choice.join(choice.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").filter("a < b")
        mutual = write(mutual, f"mutual-{level}-{k}")
        pairs = mutual if pairs is None else pairs.unionByName(mutual)
        if mutual.isEmpty() or k == MATCHINGS - 1:
            break
        taken = mutual.select(F.explode(F.array("a", "b")).alias("node"))
        free = write(free.join(taken, "node", "left_anti"), f"free-{level}-{k}")
    joined = pairs.select(F.col("b").alias("node"), F.col("a").alias("to"))
    return write(nodes.select("node").join(joined, "node", "left").select("node", F.coalesce("to", "node").alias("to")), f"match-{level}")


def _contract(nodes: DataFrame, edges: DataFrame, match: DataFrame, level: int, write: Write) -> tuple[DataFrame, DataFrame]:
    """Nodes (part, node, w) and edges (part, a, b, v) of the matched graph."""
    merged = nodes.join(match, "node").groupBy("part", F.col("to").alias("node")).agg(F.sum("w").alias("w"))
    at_a, at_b = match.select(F.col("node").alias("a"), F.col("to").alias("x")), match.select(F.col("node").alias("b"), F.col("to").alias("y"))
    joined = edges.join(at_a, "a").join(at_b, "b").filter("x <> y")
    fewer = joined.groupBy("part", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("v").alias("v"))
    return write(merged, f"coarse-nodes-{level}"), write(fewer, f"coarse-edges-{level}")


def fiedler_halves(nodes: pa.Table, edges: pa.Table) -> pa.Table:
    """(node, side) of one part: by the weighted median of the second eigenvector of its Laplacian."""
    order = np.argsort(nodes["node"].to_numpy())
    ids, w = nodes["node"].to_numpy()[order], nodes["w"].to_numpy()[order].astype(float)
    n = len(ids)
    a, b = np.searchsorted(ids, edges["a"].to_numpy()), np.searchsorted(ids, edges["b"].to_numpy())
    laplacian = np.zeros((n, n))
    np.add.at(laplacian, (a, b), -edges["v"].to_numpy())
    laplacian += laplacian.T
    laplacian[np.arange(n), np.arange(n)] = -laplacian.sum(1)
    vector = np.linalg.eigh(laplacian)[1][:, min(1, n - 1)]
    by = np.argsort(vector, kind="stable")
    side = np.zeros(n, np.int32)
    side[by] = np.cumsum(w[by]) - w[by] / 2 > w.sum() / 2
    return pa.table([ids, side], names=["node", "side"])


def _moved(nodes: DataFrame, edges: DataFrame, sides: DataFrame, level: int, write: Write) -> DataFrame:
    """Sides after rounds of moves. In a round a part's heavier half gives nodes whose edges to the other half weigh more
    than those to their own, none next to another that moves; a part keeps a round only if its cut got shorter."""

    def cuts(own: DataFrame) -> DataFrame:
        x, y = own.select(F.col("node").alias("a"), F.col("side").alias("sa")), own.select(F.col("node").alias("b"), F.col("side").alias("sb"))
        return edges.join(x, "a").join(y, "b").groupBy("part").agg(F.sum(F.when(F.col("sa") != F.col("sb"), F.col("v")).otherwise(0.0)).alias("cut"))

    for k in range(MOVES):
        known = nodes.join(sides, "node")
        weights = known.groupBy("part").agg(F.sum(F.col("w") * F.col("side")).alias("w1"), F.sum("w").alias("whole"))
        heavy = weights.select("part", (2 * F.col("w1") > F.col("whole")).cast("int").alias("from"), "whole", F.greatest("w1", F.col("whole") - F.col("w1")).alias("most"))
        at_a, at_b = sides.select(F.col("node").alias("a"), F.col("side").alias("sa")), sides.select(F.col("node").alias("b"), F.col("side").alias("sb"))
        gains = _both(edges).join(at_a, "a").join(at_b, "b").groupBy("part", F.col("a").alias("node"), F.col("sa").alias("side")).agg(F.sum(F.when(F.col("sa") != F.col("sb"), F.col("v")).otherwise(-F.col("v"))).alias("gain"))
        willing = write(gains.join(heavy, "part").join(nodes.select("node", "w"), "node").filter((F.col("side") == F.col("from")) & (F.col("gain") > 0) & (F.col("whole") - F.col("most") + F.col("w") <= MOST_SHARE * F.col("whole"))).select("part", "node", "gain"), f"willing-{level}-{k}")
        if willing.isEmpty():
            break
        one, two = willing.select(F.col("node").alias("a"), F.col("gain").alias("ga")), willing.select(F.col("node").alias("b"), F.col("gain").alias("gb"))
        losers = edges.join(one, "a").join(two, "b").select(F.when((F.col("ga") > F.col("gb")) | ((F.col("ga") == F.col("gb")) & (F.col("a") < F.col("b"))), F.col("b")).otherwise(F.col("a")).alias("node")).distinct()
        going = willing.join(losers, "node", "left_anti").select("node", F.lit(1).alias("goes"))
        changed = write(sides.join(going, "node", "left").select("node", F.when(F.col("goes") == 1, 1 - F.col("side")).otherwise(F.col("side")).alias("side")), f"moved-{level}-{k}")
        balance = nodes.join(changed, "node").groupBy("part").agg((F.greatest(F.sum(F.col("w") * F.col("side")), F.sum(F.col("w") * (1 - F.col("side")))) / F.sum("w")).alias("share"))
        better = cuts(changed).withColumnRenamed("cut", "now").join(cuts(sides), "part").join(balance, "part").filter((F.col("now") < F.col("cut")) & (F.col("share") <= MOST_SHARE)).select("part")
        better = write(better, f"better-{level}-{k}")
        if better.isEmpty():
            break
        chosen = nodes.select("part", "node").join(better.withColumn("yes", F.lit(True)), "part", "left").join(sides, "node").join(changed.withColumnRenamed("side", "new"), "node")
        sides = write(chosen.select("node", F.when(F.col("yes"), F.col("new")).otherwise(F.col("side")).alias("side")), f"sides-{level}-{k}")
    return sides


def halves(nodes: DataFrame, edges: DataFrame, write: Write) -> DataFrame:
    """(node, side) of every part: nodes (part, node, w), edges (part, a, b, v) with a < b inside a part."""
    graphs, level = [(nodes, edges)], 0
    matches: list[DataFrame] = []
    while not nodes.groupBy("part").count().filter(F.col("count") > COARSE).isEmpty():
        match = _matching(nodes, edges, level, write)
        coarse, fewer = _contract(nodes, edges, match, level, write)
        if coarse.count() > 0.95 * nodes.count():
            break  # nothing left to match (stars): the parts are halved as they are
        matches.append(match)
        graphs.append((coarse, fewer))
        nodes, edges, level = coarse, fewer, level + 1
    small = nodes.groupBy("part").count().filter(F.col("count") <= COARSE).select("part")
    solved = nodes.join(small, "part").groupBy("part").cogroup(edges.join(small, "part").select(F.col("part").alias("of"), "a", "b", "v").groupBy("of")).applyInArrow(lambda n, e: fiedler_halves(n, e) if n.num_rows else pa.table([pa.array([], pa.int64()), pa.array([], pa.int32())], names=["node", "side"]), "node long, side int")
    rest = nodes.join(small, "part", "left_anti").select("node", F.pmod(F.xxhash64("node"), F.lit(2)).cast("int").alias("side"))  # moves mend this start
    sides = write(solved.unionByName(rest), "halves")
    for (own, between), match in zip(graphs[-2::-1], matches[::-1], strict=True):
        sides = write(match.join(sides.select(F.col("node").alias("to"), "side"), "to").select("node", "side"), "carried")
        sides = _moved(own, between, sides, own.count(), write)
    return sides if matches else _moved(*graphs[0], sides, 0, write)


def dissect(graph: DataFrame, write: Write, rounds: int = 2, least: int = 32) -> DataFrame:
    """(node, path): for each round 0 or 1 for a half and 2 for its separator, of a graph (i, j, v); directions and loops
    do not matter. Parts of fewer than `least` nodes are left whole."""
    pairs = graph.filter("i <> j").groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.sum(F.abs("v")).alias("v"))
    pairs = write(pairs, "dissect-edges")
    paths = write(graph.select(F.explode(F.array("i", "j")).alias("node")).distinct().select("node", F.lit("").alias("path")), "paths")
    for k in range(rounds):
        large = paths.filter(~F.col("path").contains("2")).groupBy("path").count().filter(F.col("count") >= least).select("path")
        nodes = write(paths.join(large, "path").select(F.col("path").alias("part"), "node", F.lit(1).cast("long").alias("w")), f"part-nodes-{k}")
        if nodes.isEmpty():
            break
        at = lambda c: nodes.select(F.col("node").alias(c), F.col("part").alias(f"p{c}"))
        inside = write(pairs.join(at("a"), "a").join(at("b"), "b").filter("pa = pb").select(F.col("pa").alias("part"), "a", "b", "v"), f"part-edges-{k}")
        sides = halves(nodes, inside, write)
        x, y = sides.select(F.col("node").alias("a"), F.col("side").alias("sa")), sides.select(F.col("node").alias("b"), F.col("side").alias("sb"))
        crossing = write(inside.join(x, "a").join(y, "b").filter("sa <> sb").select("part", F.when(F.col("sa") == 0, F.col("a")).otherwise(F.col("b")).alias("zero"), F.when(F.col("sa") == 1, F.col("a")).otherwise(F.col("b")).alias("one")), f"crossing-{k}")
        borders = crossing.groupBy("part").agg((F.count_distinct("one") < F.count_distinct("zero")).alias("take_one"))
        separator = crossing.join(borders, "part").select(F.when(F.col("take_one"), F.col("one")).otherwise(F.col("zero")).alias("node")).distinct().withColumn("cut", F.lit(True))
        paths = write(paths.join(sides, "node", "left").join(separator, "node", "left").select("node", F.concat("path", F.when(F.col("cut"), F.lit("2")).otherwise(F.coalesce(F.col("side").cast("string"), F.lit("")))).alias("path")), f"paths-{k}")
    return paths


def order_of(paths: DataFrame) -> DataFrame:
    """The permutation (old, new) of dissected paths (node, path), new dense from 0: halves come before their separators."""
    sizes = paths.groupBy("path").agg(F.count("*").alias("n"))
    ahead = sizes.select("path", F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row a part
    within = F.row_number().over(Window.partitionBy("path").orderBy("node")) - 1
    return paths.withColumn("r", within).join(ahead, "path").select(F.col("node").alias("old"), (F.col("r") + F.col("ahead")).cast("long").alias("new"))


def dissection_order(graph: DataFrame, write: Write, rounds: int = 2, least: int = 32) -> DataFrame:
    return order_of(dissect(graph, write, rounds, least))
