"""Points, graphs and layouts from text, MatrixMarket and binary files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """(n, value): the file's non-empty lines without comments, numbered from 0 in file order.

    Lines carry where they begin: the order of partitions and lines in them; ranks come from one count for each
    partition, so that no task sees the whole file. One file is one path; splits come in order."""
    lines = spark.read.text(path).select("value", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_k"))
    lines = lines.filter(F.trim("value") != "")
    if comments:
        lines = lines.filter(~F.ltrim("value").startswith("%"))
    counts = lines.groupBy("_p").agg(F.count("*").alias("_c"))
    ahead = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_a"))
    inner = F.row_number().over(Window.partitionBy("_p").orderBy("_k")) - 1
    return lines.withColumn("_r", inner).join(F.broadcast(ahead), "_p").select((F.col("_r") + F.col("_a")).alias("n"), F.trim("value").alias("value"))


def _numbers(value):
    return F.transform(F.split(value, r"[\s,;]+"), lambda v: v.cast("double"))


def points_text(spark: SparkSession, path: str, limit: int | None = None, comments: bool = True) -> DataFrame:
    """Points (i, x): % comments, a header "n d", then n * d values in reading order, however they are wrapped.
    limit overrides the header's n."""
    lines = numbered_lines(spark, path, comments)
    n, d = (int(float(v)) for v in lines.filter("n = 0").first()["value"].split()[:2])
    n = limit or n
    values = lines.filter("n > 0").select("n", _numbers(F.col("value")).alias("x"))
    if values.filter(F.size("x") != d).isEmpty():
        return values.select((F.col("n") - 1).alias("i"), "x").filter(F.col("i") < n)
    sizes = values.select("n", F.size("x").alias("s")).withColumn("a", F.coalesce(F.sum("s").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("n", "a")
    flat = values.join(sizes, "n").select("a", F.posexplode("x").alias("k", "v")).withColumn("t", F.col("a") + F.col("k"))
    flat = flat.select(F.expr(f"t div {d}").alias("i"), (F.col("t") % d).alias("m"), "v").filter(F.col("i") < n)
    return flat.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "v"))), lambda z: z["v"]).alias("x"))


def points_plain(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Headerless rows of numbers (white space, commas or semicolons between them)."""
    rows = numbered_lines(spark, path, comments=False).select(F.col("n").alias("i"), _numbers(F.col("value")).alias("x"))
    return rows if limit is None else rows.filter(F.col("i") < limit)


def matrix_market(spark: SparkSession, path: str, symmetric: bool = False) -> DataFrame:
    """Edges (i, j, v), from 0, of a coordinate file: % comments, header "m n nnz", lines "row column [value]".
    symmetric: one triangle is stored."""
    entries = numbered_lines(spark, path).filter("n > 0").select(_numbers(F.col("value")).alias("x"))
    edges = entries.select((F.get("x", F.lit(0)) - 1).cast("long").alias("i"), (F.get("x", F.lit(1)) - 1).cast("long").alias("j"), F.coalesce(F.get("x", F.lit(2)), F.lit(1.0)).alias("v"))
    return edges.union(edges.filter("i <> j").select("j", "i", "v")) if symmetric else edges


def matrix_market_shape(spark: SparkSession, path: str) -> tuple[int, int, int]:
    m, n, nnz = numbered_lines(spark, path).filter("n = 0").first()["value"].split()[:3]
    return int(m), int(n), int(nnz)


def triples(spark: SparkSession, rows, symmetric: bool = False) -> DataFrame:
    """Edges from Python (i, j, v) rows; duplicates add up."""
    edges = spark.createDataFrame(rows, "i long, j long, v double")
    edges = edges.union(edges.filter("i <> j").select("j", "i", "v")) if symmetric else edges
    return edges.groupBy("i", "j").agg(F.sum("v").alias("v"))


def layout_text(spark: SparkSession, path: str) -> DataFrame:
    """A layout (i, y0, ..) from rows of numbers."""
    rows = points_plain(spark, path)
    d = len(rows.first()["x"])
    return rows.select("i", *(F.get("x", F.lit(m)).alias(f"y{m}") for m in range(d)))


def binary_points(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The parameters and points of a binary file: int n, int d, double theta, double perplexity, int dims, int
    iterations, n * d doubles, and perhaps an int seed, all little-endian."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 32).alias("h"), F.substring("content", -4, 4).alias("t"), "length").first()
    n, d, theta, perplexity, dims, iterations = struct.unpack("<iiddii", bytes(head["h"]))
    seeded = head["length"] >= 32 + 8 * n * d + 4
    params = {"n": n, "d": d, "theta": theta, "perplexity": perplexity, "dims": dims, "max_iter": iterations, "seed": struct.unpack("<i", bytes(head["t"]))[0] if seeded else None}

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b["content"]:
                x = np.frombuffer(content.as_buffer(), "<f8", n * d, 32).reshape(n, d)
                for lo in range(0, n, 8192):
                    part = x[lo : lo + 8192]
                    at = np.arange(0, part.size + 1, d, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part))), pa.ListArray.from_arrays(at, part.reshape(-1))], names=["i", "x"])

    return params, spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "i long, x array<double>")


def binary_result(spark: SparkSession, path: str) -> DataFrame:
    """(i, y, landmark, cost) of a binary result file: int n, int d, n * d doubles, n ints, n doubles."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b["content"]:
                raw = content.as_buffer()
                n, d = np.frombuffer(raw, "<i4", 2)
                y = np.frombuffer(raw, "<f8", n * d, 8)
                marks, costs = np.frombuffer(raw, "<i4", n, 8 + 8 * n * d), np.frombuffer(raw, "<f8", n, 8 + 8 * n * d + 4 * n)
                at = np.arange(0, n * d + 1, d, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.ListArray.from_arrays(at, y), pa.array(marks), pa.array(costs)], names=["i", "y", "landmark", "cost"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "i long, y array<double>, landmark int, cost double")
