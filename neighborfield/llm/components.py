"""Connected components of an edge table by repeated contraction, with every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborfield.llm.runtime import written


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable.

    Each round maps every node to the smallest node next to it, follows that twice, and contracts the edges. Only
    aggregates that combine before the shuffle and joins are used. A node with very many edges is a hot key of the joins,
    which the adaptive planner has to split."""
    links = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct(), "links")
    labels = None
    for _ in range(rounds):
        if links.isEmpty():
            break
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")).select(F.col("a").alias("node"), "to")
        step = written(step, "step")
        for _ in range(2):
            ahead = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
            step = step.join(ahead, "to").select("node", F.col("further").alias("to"))
        step = written(step, "jump")
        if labels is None:
            labels = step.select("node", F.col("to").alias("root"))
        else:
            labels = written(labels.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        at_a, at_b = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        links = written(links.join(at_a, "a").join(at_b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
