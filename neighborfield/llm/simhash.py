"""SimHash near duplicates: exact Hamming neighbours by sharded vantage-point trees.

Equal fingerprints collapse to one row first, so a group of copies of any size is one point. A top tree, fitted on a
bounded sample, sends each fingerprint to a leaf: inside when its distance to the vantage point is at most the radius.
By the triangle inequality two fingerprints within r of each other that a node separates lie within r of its boundary;
so an outer point with distance up to radius + r goes inside as well, and every such pair meets in some leaf. A leaf
task goes on splitting in the same way down to small buckets, compares those in full, and returns a spanning forest of
what it found instead of all pairs.

Nulls: a null text is empty; texts without words have fingerprint zero and link like any other. A null doc_id is in
its component but never names it, unless no row of the component has an id (component_id is then null). Repeated rows
stay. A very long text is one row, shingled in its task. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborfield.llm import shingle_links
from neighborfield.llm.components import components
from neighborfield.llm.runtime import documents, releasing, written

SEED = 42
LEAF_POINTS = 4096
BUCKET_POINTS = 256
#: The top tree is fitted on so many fingerprints at most (a 64th of them, until then); all are indexed.
SAMPLE_POINTS, SAMPLE_PER_LEAF = 200_000, 64


def fingerprint(text: str, words: int = 3) -> int:
    """Majority bits of the XXH64 of each shingle; A-Z in lower case."""
    found = text.encode().lower().split()  # bytes: ASCII case and ASCII white space only
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(found) - words + 1
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[lo:hi].tolist(), ends[lo + words - 1 : hi + words - 1].tolist(), strict=True)), np.uint64, hi - lo)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp), fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py() or "", words) for x in b["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def split(points: np.ndarray, radius: int, tries: int = 8) -> tuple[np.uint64, int] | None:
    """The vantage point and boundary that copy the fewest points; None if no boundary makes both sides smaller."""
    best = None
    probe = points if len(points) <= 4096 else points[:: len(points) // 4096]
    for i in range(tries):
        vantage = probe[(2 * i + 1) * len(probe) // (2 * tries)]
        count = np.bincount(np.bitwise_count(probe ^ vantage), minlength=65 + radius)
        within = np.cumsum(count)
        for at in range(64):
            inner, outer = within[at + radius], len(probe) - within[at]
            worst = max(inner, outer)
            if outer and worst < 0.85 * len(probe):
                cost = (inner + outer) * max(1.0, worst / (0.62 * len(probe)))
                if best is None or cost < best[0]:
                    best = cost, vantage, at
    return None if best is None else best[1:]


def top_tree(sample: np.ndarray, leaves: int, radius: int) -> list[tuple]:
    """Nodes (vantage, boundary, inner, outer) and leaves (-1, leaf, 0, 0); node 0 is the root."""
    least = max(16, len(sample) // max(1, leaves))
    nodes: list = [None]
    todo, n_leaves = [(0, np.sort(sample))], 0
    while todo:
        at, points = todo.pop()
        found = split(points, radius) if len(points) > least and leaves > 1 else None
        if found is None:
            nodes[at] = (0, -1, n_leaves, 0)
            n_leaves += 1
            continue
        vantage, boundary = found
        d = np.bitwise_count(points ^ vantage).astype(np.int64)
        nodes[at] = (int(vantage), boundary, len(nodes), len(nodes) + 1)
        todo += [(len(nodes), points[d <= boundary]), (len(nodes) + 1, points[d > boundary])]
        nodes += [None, None]
    return nodes


def route(points: np.ndarray, nodes: list[tuple], radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, points in it)."""
    todo = [(0, points)]
    while todo:
        at, own = todo.pop()
        vantage, boundary, inner, outer = nodes[at]
        if boundary < 0:
            if len(own):
                yield inner, own
            continue
        d = np.bitwise_count(own ^ np.uint64(vantage)).astype(np.int64)
        todo += [(inner, own[d <= boundary + radius]), (outer, own[d > boundary])]


def bucket_links(own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within own, as (point, smallest index's point) pairs."""
    near = np.bitwise_count(own[:, None] ^ own[None, :]) <= radius
    label = near.argmax(1)
    while True:
        new = np.where(near, label[None, :], len(own)).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(own)))
    return own[far], own[label[far]]


def leaf_links(points: np.ndarray, radius: int, bucket: int = BUCKET_POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join every two points within radius of each other, by a path inside this leaf."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [np.unique(points)]
    while todo:
        own = todo.pop()
        found = split(own, radius) if len(own) > bucket else None
        if found is not None:
            d = np.bitwise_count(own ^ found[0]).astype(np.int64)
            inner, outer = own[d <= found[1] + radius], own[d > found[1]]
            if max(len(inner), len(outer)) < len(own):
                todo += [inner, outer]
                continue
        if len(own) <= 2 * bucket:
            if len(own) > 1:
                out.append(bucket_links(own, radius))
            continue
        for lo in range(0, len(own), bucket):  # no boundary helps: all blocks against all
            for hi in range(lo, len(own), bucket):
                out.append(bucket_links(np.concatenate([own[lo : lo + bucket], own[hi : hi + bucket]]) if hi > lo else own[lo : lo + bucket], radius))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pairs = np.unique(np.stack([np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def near_fingerprints(points: DataFrame, radius: int = 2, leaf_points: int = LEAF_POINTS, sample_points: int = SAMPLE_POINTS) -> DataFrame:
    """points: (fp) distinct. Edges (a, b) whose components are those of all pairs within radius bits."""
    n = points.count()
    leaves = n // leaf_points
    nodes = [(0, -1, 0, 0)]  # one leaf
    if leaves > 1:
        share = min(sample_points, SAMPLE_PER_LEAF * leaves) / n
        sample = points.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).toArrow()["fp"].to_numpy()
        nodes = top_tree(sample.view(np.uint64), leaves, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for leaf, own in route(b["fp"].to_numpy(zero_copy_only=False).view(np.uint64), nodes, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), leaf, np.int64)), pa.array(own.view(np.int64))], names=["leaf", "fp"])

    def search(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        a, b = leaf_links(part["fp"].to_numpy().view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return points.select("fp").mapInArrow(deal, "leaf long, fp long").groupBy("leaf").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most radius bits."""
    rows = written(fingerprints(docs, words, id_col, text_col), "simhash")
    points = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    roots = components(near_fingerprints(points.select("fp"), radius))
    named = written(points.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def text_nodes(rows: DataFrame, hashed=F.xxhash64) -> DataFrame:
    """rows (text, text_sha256) with a number for each different text, node: its hash, or where different texts share one,
    which their SHA-256 tells, that hash for one of them and a hash of the SHA-256 for each other."""
    rows = rows.withColumn("node", hashed(F.col("text")))
    shared = rows.groupBy("node").agg(F.min("text_sha256").alias("first"), F.max("text_sha256").alias("last")).filter("first <> last").select("node", "first")
    shared = written(shared, "shared-hashes")
    if shared.isEmpty():
        return rows
    other = F.when(F.col("text_sha256") != F.col("first"), F.xxhash64("text_sha256")).otherwise(F.col("node"))
    return rows.join(shared, "node", "left").withColumn("node", other).drop("first")


def near_documents(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", hashed=F.xxhash64) -> DataFrame:
    """(doc_id, text_sha256, component_id): groups of texts whose five-word shingles have a Jaccard similarity of 0.8 or
    more. component_id is the smallest doc_id reachable over links. Texts are equal if their SHA-256 is.

    The trees give what fingerprints of five-word shingles link within radius bits. A similarity of 0.8 is about ten of
    64 bits, where no vantage point parts anything any more; so texts that agree on a band of minima are candidates as
    well (with probability 0.99995 at 0.8). Candidates whose sizes or low bits of the minima rule the similarity out
    (seven deviations away) are not read; each other one is verified by its
    shingles. First the members of a band's bucket meet its smallest node, which joins a group of any size without its
    pairs; then those in buckets with several groups go through an exact prefix filter."""
    rows = text_nodes(documents(docs, id_col, text_col).withColumn("text_sha256", F.sha2("text", 256)), hashed)
    made = written(rows.select("node", "text").mapInArrow(releasing(shingle_links.describe), shingle_links.DESCRIBED), "shingle-minima").dropDuplicates(["node"])
    kept = ["node", "size", "bits1", "bits2"]
    every = made.select("node", F.explode("bands").alias("bucket"))
    shared = written(every.groupBy("bucket").count().filter("count > 1").select("bucket"), "shingle-shared")
    members = written(made.select(*kept, F.explode("bands").alias("bucket")).join(shared, "bucket", "left_semi"), "shingle-buckets")

    points = written(made.groupBy("fp").agg(F.min("node").alias("head")), "points")
    same = made.join(points, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    close = near_fingerprints(points.select("fp"), radius).join(points.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(points.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    heads = written(members.groupBy("bucket").agg(F.min(F.struct(*kept)).alias("x")), "shingle-heads")
    met = members.select("bucket", F.struct(*kept).alias("y")).join(heads, "bucket").filter((F.col("x.node") != F.col("y.node")) & shingle_links.possible("x", "y"))
    pairs = written(reduce(DataFrame.union, [same, close.select("x", "y"), met.select("x.node", "y.node")]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    nodes = members.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    texts = written(rows.select("node", "text").join(nodes, "node", "left_semi").dropDuplicates(["node"]), "shingle-texts")
    links = shingle_links.linked(pairs, texts, "shingle-links")

    named = written(members.join(components(links), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"), "shingle-groups")
    several = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("bucket")
    left = written(named.join(written(several, "shingle-unsettled"), "bucket", "left_semi").select("node", "label", "bits1", "bits2").distinct(), "shingle-left")
    links = links.union(shingle_links.apart(left, texts))

    found = written(rows.select("doc_id", "text_sha256", "node").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), "shingle-roots")
    return found.join(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "text_sha256", "component_id")
