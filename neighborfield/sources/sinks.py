"""Layouts, graphs and measurements written out."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborfield.operators.forces import axes
from neighborfield.operators.formats import block_stats, row_stats
from neighborfield.params import EmbeddingParams


def layout_text(y: DataFrame, path: str, mode: str = "error") -> None:
    """A line for each point in order of i: range-sorted part files, to be read in name order."""
    y.orderBy("i").select(F.concat_ws(" ", *(F.col(c).cast("string") for c in axes(y)))).write.mode(mode).text(path)


def points_text(points: DataFrame, path: str, header: bool = True, mode: str = "error") -> None:
    """A header "n d", then a line for each point in order of i: one file, written by one task line by line."""
    lines = points.select(F.concat_ws(" ", F.transform("x", lambda v: v.cast("string"))).alias("value"), "i")
    if header:
        size = points.agg(F.concat_ws(" ", F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).alias("value"), F.lit(-1).cast("long").alias("i"))
        lines = size.unionByName(lines)
    lines.repartition(1).sortWithinPartitions("i").select("value").write.mode(mode).text(path)


def layout_parquet(y: DataFrame, path: str, mode: str = "error") -> None:
    y.write.mode(mode).parquet(path)


def layout_binary(y: DataFrame) -> DataFrame:
    """(first, content): rows as raw little-endian doubles, packed by ranges of i."""
    dims = axes(y)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = np.ascontiguousarray(np.stack([b[c].to_numpy() for c in dims], 1).astype("<f8")).tobytes()
                yield pa.RecordBatch.from_arrays([b["i"].slice(0, 1), pa.array([raw], pa.binary())], names=["first", "content"])

    return y.orderBy("i").select("i", *dims).mapInArrow(pack, "first long, content binary")


def _one_file(rows: DataFrame, path: str, pieces) -> None:
    """Rows with i, in order of it, through one task to one file: pieces(batches) gives its bytes, part by part."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        system.create_dir(where.rsplit("/", 1)[0], recursive=True)
        done = 0
        with system.open_output_stream(where) as out:
            for piece in pieces(batches):
                done += out.write(piece)
        yield pa.RecordBatch.from_arrays([pa.array([done])], names=["bytes"])

    rows.repartition(1).sortWithinPartitions("i").mapInArrow(write, "bytes long").collect()


def points_binary(points: DataFrame, path: str, theta: float = 0.5, perplexity: float = 30.0, dims: int = 2, iterations: int = 1000) -> None:
    """One binary file of points (i, x): int n, int d, double theta, double perplexity, int dims, int iterations, n * d doubles.
    The format is one file, so one task writes it, batch by batch in order of i."""
    size = points.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("d")).first()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        yield struct.pack("<iiddii", size.n, size.d, theta, perplexity, dims, iterations)
        for b in batches:
            yield np.ascontiguousarray(b["x"].flatten().to_numpy(zero_copy_only=False), "<f8").tobytes()

    _one_file(points.select("i", "x"), path, pieces)


def result_file(y: DataFrame, path: str) -> None:
    """One binary result file of a layout: int n, int d, the layout, n landmark numbers, n costs (zeros); in order of i."""
    dims = axes(y)
    n = y.count()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        yield struct.pack("<ii", n, len(dims))
        for b in batches:
            yield np.ascontiguousarray(np.stack([b[c].to_numpy() for c in dims], 1), "<f8").tobytes()
        for lo in range(0, n, 1 << 16):
            yield np.arange(lo, min(n, lo + (1 << 16)), dtype="<i4").tobytes()
        for lo in range(0, n, 1 << 16):
            yield bytes(8 * (min(n, lo + (1 << 16)) - lo))

    _one_file(y.select("i", *dims), path, pieces)


def result_binary(y: DataFrame, costs: DataFrame | None = None) -> bytes:
    """A whole result file (int n, int d, layout, landmarks, costs) for layouts that fit the driver; the format is one file."""
    dims = axes(y)
    both = y if costs is None else y.join(costs, "i", "left")
    t = both.orderBy("i").toArrow()
    n = t.num_rows
    flat = np.stack([t[c].to_numpy() for c in dims], 1).astype("<f8").tobytes() if n else b""
    cost = np.zeros(n) if costs is None else t["cost"].to_numpy()
    return np.array([n, len(dims)], "<i4").tobytes() + flat + np.arange(n, dtype="<i4").tobytes() + cost.astype("<f8").tobytes()


def graph_text(edges: DataFrame, n: int, path: str, mode: str = "error") -> None:
    """Header "n n nnz", then "i j v" from 1, by row: a coordinate file in parts; the first part begins with the header."""
    header = edges.agg(F.concat_ws(" ", F.lit(n), F.lit(n), F.count("*")).alias("value"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"))
    lines = edges.select(F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col("v")).alias("value"), "i", "j")
    header.select("value", "i", "j").unionByName(lines).orderBy("i", "j").select("value").write.mode(mode).text(path)


def snapshot(y: DataFrame, step: int, path: str) -> None:
    """Appends a layout under its iteration."""
    y.withColumn("iter", F.lit(step)).write.mode("append").partitionBy("iter").parquet(path)


def stage_times(metrics: DataFrame) -> DataFrame:
    """(stage, total_ms, n) of rows (iter, stage, ms)."""
    return metrics.groupBy("stage").agg(F.sum("ms").alias("total_ms"), F.count("*").alias("n"))


def times_csv(metrics: DataFrame, path: str, mode: str = "error") -> None:
    metrics.write.mode(mode).option("header", True).csv(path)


def describe(edges: DataFrame, show_up_to: int = 150) -> str:
    """Size of a matrix; all entries if there are fewer than show_up_to."""
    row = edges.agg(F.coalesce(F.max("i") + 1, F.lit(0)).alias("m"), F.coalesce(F.max("j") + 1, F.lit(0)).alias("n"), F.count("*").alias("nnz")).first()
    lines = [f"m = {row.m}, n = {row.n}, nnz = {row.nnz}"]
    if row.nnz < show_up_to:
        lines += [f"{r.i} {r.j} {r.v}" for r in edges.orderBy("i", "j").collect()]
    return "\n".join(lines)


def describe_blocks(edges: DataFrame, bits: int) -> str:
    return "; ".join(f"{k} = {v}" for r in (row_stats(edges).first(), block_stats(edges, bits).first()) for k, v in r.asDict().items())


def describe_params(p: EmbeddingParams) -> str:
    return "\n".join(f"{k} = {v}" for k, v in vars(p).items())
