"""Generated points, graphs and layouts; values depend on ids and the seed only, not on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neighborfield.functions.kernels import bind


#: Modulus of the integer hash; products of two remainders fit a signed long.
PRIME = 2147483647


def mixed(state: Column, key: Column) -> Column:
    """The next state of an integer hash: plain arithmetic, the same in any engine."""
    key = F.pmod(key, F.lit(PRIME))
    return bind(state, lambda x: (F.pmod(x + key * 7919 + 1, F.lit(PRIME)) * F.pmod(x + key * 104729 + 3, F.lit(PRIME))) % PRIME)


def uniform(seed: int, *keys: Column | str) -> Column:
    """U(0, 1) from a hash of integer keys."""
    state = F.lit(seed + 1).cast("long")
    for k in (*keys, F.lit(11), F.lit(5), F.lit(2)):
        state = mixed(state, (F.col(k) if isinstance(k, str) else k).cast("long"))
    return (state + 0.5) / float(PRIME)


def normal(seed: int, *keys: Column | str) -> Column:
    """N(0, 1) from two hashes."""
    return F.sqrt(-2 * F.ln(uniform(2 * seed + 1, *keys))) * F.cos(2 * math.pi * uniform(2 * seed + 2, *keys))


def _points(spark: SparkSession, n: int, d: int, value) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda m: value(F.col("id"), m)).alias("x"))


def two_blobs(spark: SparkSession, n: int, d: int, seed: int = 0) -> DataFrame:
    """First half N(-10, 1), second half N(10, 1)."""
    return _points(spark, n, d, lambda i, m: F.when(i < n // 2, -10.0).otherwise(10.0) + normal(seed, i, m))


def four_blobs(spark: SparkSession, n: int, d: int, seed: int = 0) -> DataFrame:
    """Quarters around -20, 20, 10 and -10, deviation 2."""
    quarter = max(1, n // 4)
    mean = lambda i: F.when(i < quarter, -20.0).when(i < 2 * quarter, 20.0).when(i < 3 * quarter, 10.0).otherwise(-10.0)
    return _points(spark, n, d, lambda i, m: mean(i) + 2 * normal(seed, i, m))


def clusters(spark: SparkSession, n: int, c: int, d: int = 50, seed: int = 0) -> DataFrame:
    """c clusters: component m is N(20, 2) where m >= cluster, else N(-20, 2)."""
    size = max(1, n // c)
    return _points(spark, n, d, lambda i, m: F.when(m >= F.least(F.floor(i / size), F.lit(c - 1)), 20.0).otherwise(-20.0) + 2 * normal(seed, i, m))


def uniform_points(spark: SparkSession, n: int, d: int, low: float = 0.0, high: float = 1.0, seed: int = 0) -> DataFrame:
    return _points(spark, n, d, lambda i, m: low + (high - low) * uniform(seed, i, m))


def layout(points: DataFrame, d: int) -> DataFrame:
    """Points (i, x) as a layout (i, y0, ..)."""
    return points.select("i", *(F.get("x", F.lit(m)).alias(f"y{m}") for m in range(d)))


def random_graph(spark: SparkSession, n: int, least: int = 2, most: int = 11, seed: int = 0) -> DataFrame:
    """Edges (i, j, v): least..most entries in each column with U(0, 1) values; equal places add up."""
    degree = F.floor(uniform(seed, F.col("id"), F.lit(1)) * (most - least + 1)).cast("int") + least
    each = spark.range(n).select(F.col("id").alias("j"), F.explode(F.sequence(F.lit(1), degree)).alias("k"))
    edges = each.select(F.floor(uniform(seed, "j", "k", F.lit(2)) * n).cast("long").alias("i"), "j", uniform(seed, "j", "k", F.lit(3)).alias("v"))
    return edges.groupBy("i", "j").agg(F.sum("v").alias("v"))


def charge_signal(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(i, y0, q): sin(10 x) + cos(2000 x) on U(0, 1)."""
    x = uniform(seed, F.col("id"))
    return spark.range(n).select(F.col("id").alias("i"), x.alias("y0"), (F.sin(10 * x) + F.cos(2000 * x)).alias("q"))


def random_rows(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n random points, by the order of a hash."""
    return points.orderBy(uniform(seed, "i"), "i").limit(n)
