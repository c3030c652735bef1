"""What verifies near copies that SimHash can't tell: word shingles, minima of their hashes, and exact similarities.

A text's shingles are those of the fingerprints (bytes between ASCII white space, A-Z in lower case); a text of at most
`words` words is one shingle. Equal texts collapse to one node first. Two nodes that agree on a band of minima are
candidates: at similarity s that happens with probability 1 - (1 - s^ROWS)^BANDS, 0.99995 at 0.8. Candidates whose
sizes or low bits of the minima rule the similarity out (bits: seven deviations away) are not read. The rest are
verified by the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neighborfield.llm.runtime import releasing, slices, written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
#: Minima; those beyond the bands only give bits. Bits that may differ: 12.8 of 128 are expected at 0.8, deviation 3.4.
HASHES, BITS = 128, 37
#: Members of a shingle up to which they are paired as rows; beyond, members in a block, and shingles counted at a time.
FEW, BLOCK, COLUMNS = 32, 1024, 2048
#: Shingles hashed at a time.
PIECE = 1 << 15
_MIX = np.random.default_rng(42).integers(0, 1 << 32, (2, HASHES), dtype=np.uint32) | np.array([[1], [0]], np.uint32)


def shingles(text: str, words: int = WORDS) -> list[bytes]:
    """Each shingle of the text, repeated ones too; a text without words has one, the empty one."""
    found = text.encode().lower().split()  # bytes: ASCII case and ASCII white space only
    if len(found) <= words:
        return [b" ".join(found)]
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[a:b] for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of HASHES minima for each run of hashes; starts are where runs begin."""
    out = np.empty((len(starts), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(hashes * _MIX[0, k] + _MIX[1, k], starts)
    return out


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def signatures(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of different shingles, minima, SimHash fingerprint) of each text."""
    sizes, out = np.empty(len(texts), np.int64), np.full((len(texts), HASHES), (1 << 32) - 1, np.uint32)
    prints = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    rows: list[int] = []
    runs: list[np.ndarray] = []

    def flush() -> None:
        if runs:
            starts = np.cumsum([0] + [len(r) for r in runs[:-1]])
            least = minima(np.concatenate(runs), starts)
            for at, row in zip(rows, least, strict=True):  # a long text comes in several runs
                np.minimum(out[at], row, out=out[at])
            rows.clear()
            runs.clear()

    held = 0
    for i, text in enumerate(texts):
        own = shingles(text, words)
        h = np.fromiter((digest(s, 42) for s in own), np.uint64, len(own))
        prints[i] = majority(h) if own != [b""] else 0
        h = np.unique(h)
        sizes[i] = len(h)
        h = (h >> np.uint64(32)).astype(np.uint32) ^ h.astype(np.uint32)
        for lo in range(0, len(h), PIECE):
            rows.append(i)
            runs.append(h[lo : lo + PIECE])
            held += len(runs[-1])
            if held >= PIECE:
                flush()
                held = 0
    flush()
    return sizes, out, prints


def similarity(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


DESCRIBED = "node long, size long, fp long, bits1 long, bits2 long, bands array<long>"


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(iter([whole]), "text", 4 << 20):
            sizes, least, prints = signatures(b["text"].to_pylist())
            own = np.ascontiguousarray(least[:, : BANDS * ROWS]).view(np.uint8).reshape(len(sizes), BANDS, ROWS * 4)
            bands = np.array([[xxhash.xxh64_intdigest(own[i, k].tobytes(), k) for k in range(BANDS)] for i in range(len(sizes))], np.uint64).view(np.int64)
            bits = np.packbits((least & 1).astype(np.uint8), axis=1).view(np.int64)
            at = pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(sizes), pa.array(prints.view(np.int64)), pa.array(np.ascontiguousarray(bits[:, 0])), pa.array(np.ascontiguousarray(bits[:, 1])), pa.ListArray.from_arrays(at, pa.array(bands.reshape(-1)))], names=["node", "size", "fp", "bits1", "bits2", "bands"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[int | None, set[bytes]] = None, set()
    for p in batches:
        found = np.zeros(p.num_rows, bool)
        for i, (a, left, right) in enumerate(zip(p["a"].to_pylist(), p["left"], p["right"], strict=True)):
            if a != last[0]:
                last = a, set(shingles(left.as_py()))
            found[i] = similarity(last[1], set(shingles(right.as_py()))) >= SIMILARITY
        yield pa.RecordBatch.from_arrays([p["a"], p["b"]], names=["a", "b"]).filter(pa.array(found))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(iter([whole]), "text", 4 << 20):
            own = [np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles(t)), np.uint64)).view(np.int64) for t in b["text"].to_pylist()]
            sizes = np.array(list(map(len, own)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *own])))
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(sizes), lists], names=["node", "size", "h"])


def apart(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among members (node, label, bits1, bits2) whose labels differ; at least one for any two labels that
    have one.

    A prefix filter: similar sets share one of their rarest shingles, the first size - ceil(0.8 size) + 1 by frequency
    among the members. So texts that only have a frequent passage in common are no candidates, however many they are.
    Shingles that one member has are left out at once; they only shorten the rest of its prefix. The members of a shingle
    that few have are paired and verified; those of a hot one meet in blocks, and only links leave a task."""
    sets = written(texts.join(members.select("node"), "node", "left_semi").select("node", "text").mapInArrow(releasing(_sets), "node long, size long, h array<long>"), "shingle-sets")
    each = sets.select("node", "size", F.explode("h").alias("h"))
    several = written(each.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "shingle-counts")
    common = written(each.join(several, "h"), "shingle-common")
    rarest, own = Window.partitionBy("node").orderBy("n", "h"), Window.partitionBy("node")
    prefix = common.withColumn("rank", F.row_number().over(rarest)).withColumn("held", F.count("*").over(own))
    prefix = prefix.filter(F.col("rank") <= F.col("held") - F.ceil(SIMILARITY * F.col("size") - 1e-6) + 1)
    prefix = written(prefix.select("h", "node", "size").join(members, "node"), "shingle-prefixes")
    top = prefix.groupBy("h", "label").count().groupBy("h").agg(F.max(F.struct("count", "label")).alias("top"), F.count("*").alias("labels"), F.sum("count").alias("n"))
    top = written(top.filter("labels > 1").select("h", F.col("top.label").alias("top"), "n"), "shingle-tops")
    mixed = prefix.join(top.filter(F.col("n") <= FEW), "h")
    kept = ["label", "node", "size", "bits1", "bits2"]
    x, y = mixed.filter("label <> top").select("h", F.struct(*kept).alias("x")), mixed.select("h", F.struct(*kept).alias("y"))
    pairs = x.join(y, "h").filter((F.col("x.label") != F.col("y.label")) & possible("x", "y"))
    links = linked(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), texts, "shingle-few-links")

    many = top.filter(F.col("n") > FEW).select("h", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = prefix.select("h", "node", "label").join(many, "h").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.join(sets.select("node", F.col("h").alias("own_set")), "node").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "own_set")
    return links.union(written(dealt.groupBy("h", "i", "j").applyInArrow(releasing(_meet), "a long, b long"), "shingle-block-links"))


def _meet(part: pa.Table) -> pa.Table:
    """Links between two blocks of texts, one for each pair of labels: shared shingles are counted by products of 0-1
    matrices, some columns at a time."""
    i, own = part["i"][0].as_py(), part["own"].to_numpy()
    node, label = part["node"].to_numpy(), part["label"].to_numpy()
    sets = part["own_set"].combine_chunks()
    sizes = np.diff(sets.offsets.to_numpy())
    _, column, times = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    held = times[column] > 1
    row, column = np.repeat(np.arange(len(sizes)), sizes)[held], column[held]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = (np.flatnonzero(own == i), np.flatnonzero(own != i)) if part["j"][0].as_py() != i else (np.arange(len(own)),) * 2
    both = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        member = np.zeros((len(sizes), COLUMNS), np.float32)
        member[row[a:b], column[a:b] - lo] = 1
        both += member[left] @ member[right].T
    every = sizes[left][:, None] + sizes[right][None, :] - both.astype(np.float64)
    x, y = np.nonzero((both / every >= SIMILARITY) & (label[left][:, None] != label[right][None, :]))
    x, y = left[x], right[y]
    pairs = np.stack([np.minimum(label[x], label[y]), np.maximum(label[x], label[y])], 1)
    _, once = np.unique(pairs, axis=0, return_index=True)
    return pa.table([node[x[once]], node[y[once]]], names=["a", "b"])


def linked(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Those pairs (a, b) of nodes whose similarity is SIMILARITY or more."""
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("left")), texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").sortWithinPartitions("a")
    return written(both.mapInArrow(releasing(_verify), "a long, b long"), name)


def possible(x: str, y: str) -> Column:
    """Whether sizes and bits let rows x and y be similar enough."""
    size, other = F.col(f"{x}.size"), F.col(f"{y}.size")
    differ = sum(F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in ("bits1", "bits2"))
    return (F.least(size, other) >= SIMILARITY * F.greatest(size, other) - 1e-6) & (differ <= BITS)
