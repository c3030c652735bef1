"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors, none close to another. A vector is described by its nearest pivots in order; the
inverted list of (label, pivot) holds the vectors that have the pivot among those. Two vectors of a list are candidates
when they share at least `shared` pivots; they are compared in the list of their smallest shared pivot only, so that
each pair counts once, by cosine in double precision. A list longer than a block is dealt out as pairs of blocks; no
pair leaves a task, only counts of links and a spanning forest. Equal vectors of a label collapse to one row first. Among
equally near pivots the order is that of the selection, the same for equal vectors.

Each length of vectors has pivots of its own. A length with at most BLOCK vectors has none: all of a label are one list,
where all pairs are compared. A vector is copied into the lists of its PREFIX pivots, and in a list of b blocks b times.

A vector that is null, empty or zero, or holds a null or a component that is not finite, or whose label or vec_id is
null, links with nothing: it has no links and is its own component (null for a null vec_id, then not kept). Vectors of
different lengths never link. Rows that share vec_id, label and vector are one vector. An empty table gives no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborfield.llm.components import components
from neighborfield.llm.runtime import written

THRESHOLD = 0.93
PREFIX, SHARED = 16, 2
#: Largest cosine between two pivots.
APART = 0.7
#: Pivots of a length: 4 * sqrt(vectors) within these bounds; the index is fitted on so many vectors, all are indexed.
PIVOTS = (64, 32_768)
BLOCK = 1024


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    size = column.value_lengths()[0].as_py() if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def units(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def spread(x: np.ndarray, closest: float = APART) -> np.ndarray:
    """Those rows that are no closer than a cosine of `closest` to one taken before: a group of near copies, however
    large its share of the sample, gets one pivot, which all of it has in common, instead of many that split it."""
    taken = np.zeros((0, x.shape[1]))
    for lo in range(0, len(x), 512):
        own = x[lo : lo + 512]
        own = own[~(own @ taken.T > closest).any(1)]
        free = np.zeros(len(own), bool)
        for i in range(len(own)):
            free[i] = not (own[:i][free[:i]] @ own[i] > closest).any()
        taken = np.concatenate([taken, own[free]])
    return taken


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of each row's nearest pivots, nearest first."""
    prefix = min(prefix, len(pivots))
    closeness = x @ pivots.T
    near = np.argpartition(-closeness, prefix - 1, axis=1)[:, :prefix]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(closeness, near, 1), axis=1, kind="stable"), 1)


def list_links(x: np.ndarray, prefixes: np.ndarray, pivot: int, left: np.ndarray, right: np.ndarray, shared: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (i, j), i in left and j in right, whose smallest shared pivot is this list's."""
    names, own = np.unique(prefixes, return_inverse=True)
    member = np.zeros((len(x), len(names)), np.float32)
    member[np.arange(len(x))[:, None], own.reshape(prefixes.shape)] = 1
    smaller = member[:, names < pivot]
    for lo in range(0, len(left), 512):
        a = left[lo : lo + 512]
        hit = (x[a] @ x[right].T >= threshold) & (member[a] @ member[right].T >= shared - 0.5) & (smaller[a] @ smaller[right].T < 0.5)
        i, j = np.nonzero(hit & (a[:, None] < right[None, :]))
        yield a[i], right[j]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, prefix: int = PREFIX, shared: int = SHARED, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.col(f"`{label_col}`").cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(usable, F.col("v")))
    points = written(rows.filter("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies")), "vectors")
    pivots: dict[int, np.ndarray] = {}
    for width, n in points.groupBy(F.size("v").alias("width")).count().filter(F.col("count") > BLOCK).collect():
        n_pivots = int(min(PIVOTS[1], max(PIVOTS[0], 4 * n**0.5)))
        share = min(1_000_000, int(1_000_000 * 2.6 * n_pivots / n) + 1)
        drawn = points.filter((F.size("v") == width) & (F.pmod(F.xxhash64("label", "v"), F.lit(1_000_000)) < share))
        sample = drawn.orderBy(F.xxhash64("label", "v")).limit(2 * n_pivots).select("v").toArrow()["v"].combine_chunks()
        if len(sample):
            pivots[width] = spread(units(matrix(sample)))[:n_pivots]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            widths = whole["v"].value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths).tolist():
                own = whole.filter(pa.array(widths == width))
                rows = max(1, (1 << 20) // len(pivots.get(width, [0])))
                for lo in range(0, own.num_rows, rows):
                    b = own.slice(lo, rows)
                    near = nearest_pivots(units(matrix(b["v"])), pivots[width], prefix) if width in pivots else np.zeros((b.num_rows, 1), np.int64)
                    at = pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([b["label"], b["v"], b["rep"], b["copies"], pa.ListArray.from_arrays(at, pa.array(near.reshape(-1).astype(np.int32)))], names=["label", "v", "rep", "copies", "near"])

    described = written(points.mapInArrow(describe, "label string, v array<double>, rep long, copies long, near array<int>"), "described")
    lists = described.select("label", F.size("v").alias("width"), F.explode("near").alias("pivot"))
    long_lists = lists.groupBy("label", "width", "pivot").count().filter(F.col("count") > BLOCK).select("label", "width", "pivot", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    key = ["label", "width", "pivot"]
    entries = described.withColumn("width", F.size("v")).withColumn("pivot", F.explode("near")).join(long_lists, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    entries = entries.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    entries = entries.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).select(*key, "i", "j", "own", "rep", "copies", "near", "v")

    def verify(part: pa.Table) -> pa.Table:
        pivot, i, j = (part[c][0].as_py() for c in ("pivot", "i", "j"))
        rep, copies = part["rep"].to_numpy(), part["copies"].to_numpy()
        order = np.argsort(rep, kind="stable")
        own = part["own"].to_numpy()[order]
        rep, copies = rep[order], copies[order]
        least = min(shared, len(pivots.get(part["width"][0].as_py(), [0])))  # up to PREFIX pivots are shared by all vectors
        x, near = units(matrix(part["v"].combine_chunks()))[order], matrix(part["near"].combine_chunks())[order].astype(np.int64)
        every = np.arange(len(rep))
        links, label = np.zeros(len(rep), np.int64), every.copy()
        sides = [(every, every)] if i == j else [(every[own == i], every[own == j]), (every[own == j], every[own == i])]
        for left, right in sides:
            for a, b in list_links(x, near, pivot, left, right, least, threshold):
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                while True:  # join what is linked: each takes the smallest label next to it
                    low = np.minimum(label[a], label[b])
                    before = label.copy()
                    np.minimum.at(label, a, low)
                    np.minimum.at(label, b, low)
                    np.minimum.at(label, before, label)
                    label = label[label]
                    if (label == before).all():
                        break
        hit, moved = np.flatnonzero(links), np.flatnonzero(label != every)
        return pa.table([np.concatenate([rep[hit], rep[moved]]), pa.array([None] * len(hit) + rep[label[moved]].tolist(), pa.int64()), np.concatenate([links[hit], np.zeros(len(moved), np.int64)])], names=["a", "b", "n"])

    found = written(entries.groupBy(*key, "i", "j").applyInArrow(verify, "a long, b long, n long"), "vector-links")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "root")
    done = points.join(counts, "rep", "left").join(roots, "rep", "left").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    return rows.join(done, ["label", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


#: The definition for DuckDB: all pairs of a label, and a recursion over links.
SQL = r"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: c::DOUBLE) AS x FROM embeddings
   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
