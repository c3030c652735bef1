"""Matrix formats as views of an edge table (i, j, v), and what they say about its structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neighborfield.functions.kernels import morton


def _before(value: str, order: str) -> Column:
    return F.coalesce(F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def offsets(edges: DataFrame, by: str = "i", parts: int = 64) -> DataFrame:
    """(by, start, degree): where each row (or column) begins in the compressed matrix. Only rows that have entries.

    A running sum over the whole table would be one task; so rows are cut into ranges of the key, summed apart, and
    each range gets what stands before it from at most `parts` sums."""
    degrees = edges.groupBy(by).agg(F.count("*").alias("degree"))
    bounds = degrees.agg(F.min(by).alias("_lo"), F.max(by).alias("_hi"))
    dealt = degrees.crossJoin(F.broadcast(bounds)).withColumn("_part", F.expr(f"cast(({by} - _lo) div greatest(1, (_hi - _lo + {parts}) div {parts}) as int)"))
    sums = dealt.groupBy("_part").agg(F.sum("degree").alias("_n"))
    ahead = sums.select("_part", _before("_n", "_part").alias("_ahead"))
    inner = F.coalesce(F.sum("degree").over(Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_in", inner).join(F.broadcast(ahead), "_part").select(by, (F.col("_in") + F.col("_ahead")).cast("long").alias("start"), "degree")


def csr_offsets(edges: DataFrame) -> DataFrame:
    return offsets(edges, "i")


def csc_offsets(edges: DataFrame) -> DataFrame:
    return offsets(edges, "j")


def positions(edges: DataFrame) -> DataFrame:
    """Each entry's place in its row, from 0, by column."""
    return edges.withColumn("pos", F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1)


def ell_part(edges: DataFrame, width: int) -> DataFrame:
    """The first `width` entries of each row."""
    return positions(edges).filter(F.col("pos") < width)


def coo_tail(edges: DataFrame, width: int) -> DataFrame:
    return positions(edges).filter(F.col("pos") >= width)


def ell_arrays(edges: DataFrame, width: int) -> DataFrame:
    """(i, js, vs): rows packed into arrays."""
    return ell_part(edges, width).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("pos", "j", "v"))).alias("r")).select("i", F.transform("r", lambda z: z["j"]).alias("js"), F.transform("r", lambda z: z["v"]).alias("vs"))


def from_ell(rows: DataFrame) -> DataFrame:
    return rows.select("i", F.explode(F.arrays_zip("js", "vs")).alias("z")).select("i", F.col("z.js").alias("j"), F.col("z.vs").alias("v"))


def sum_duplicates(triples: DataFrame) -> DataFrame:
    return triples.groupBy("i", "j").agg(F.sum("v").alias("v"))


def row_stats(edges: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """One row: least, most, whole-number mean and population deviation of row lengths; points adds empty rows."""
    degrees = edges.groupBy("i").agg(F.count("*").alias("n"))
    if points is not None:
        degrees = points.select("i").join(degrees, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"))
    return degrees.agg(F.min("n").alias("min_nnz"), F.max("n").alias("max_nnz"), F.floor(F.avg("n")).alias("avg_nnz"), F.stddev_pop("n").alias("sd_nnz"))


def blocks(edges: DataFrame, bits: int) -> DataFrame:
    """Entries with their block of 2^bits rows and columns, and their order inside it."""
    low = F.lit((1 << bits) - 1).cast("long")
    return edges.withColumns({"block_row": F.shiftright("i", bits), "block_col": F.shiftright("j", bits), "inner": morton([F.col("j").bitwiseAND(low), F.col("i").bitwiseAND(low)], bits)})


def blocked(edges: DataFrame, bits: int) -> DataFrame:
    """The blocks as a layout: rows of blocks together, Morton order inside."""
    return blocks(edges, bits).repartition("block_row").sortWithinPartitions("block_row", "block_col", "inner")


def block_stats(edges: DataFrame, bits: int) -> DataFrame:
    sizes = blocks(edges, bits).groupBy("block_row", "block_col").agg(F.count("*").alias("nnz"))
    return sizes.agg(F.count("*").alias("n_blocks"), F.min("nnz").alias("min_nnz"), F.max("nnz").alias("max_nnz"), F.avg("nnz").alias("avg_nnz"), F.stddev_pop("nnz").alias("sd_nnz"))


def block_imbalance(edges: DataFrame, bits: int, by: str = "block_row") -> DataFrame:
    """Most entries of a row (or column) of blocks over the mean."""
    return blocks(edges, bits).groupBy(by).agg(F.count("*").alias("nnz")).agg((F.max("nnz") / F.avg("nnz")).alias("imbalance"))


def histogram(counts: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): bin 0 and bins + 1 hold what lies outside."""
    return counts.groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def permute(edges: DataFrame, permutation: DataFrame) -> DataFrame:
    """permutation (old, new). A(p, p)."""
    a, b = permutation.select(F.col("old").alias("i"), F.col("new").alias("_i")), permutation.select(F.col("old").alias("j"), F.col("new").alias("_j"))
    return edges.join(a, "i").join(b, "j").select(F.col("_i").alias("i"), F.col("_j").alias("j"), "v")


def inverse(permutation: DataFrame) -> DataFrame:
    return permutation.select(F.col("new").alias("old"), F.col("old").alias("new"))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def upper(edges: DataFrame) -> DataFrame:
    return edges.filter("i <= j")


def band(edges: DataFrame, width: int) -> DataFrame:
    return edges.filter(F.abs(F.col("i") - F.col("j")) <= width)


def full_from_upper(edges: DataFrame) -> DataFrame:
    """Both triangles of a matrix of which one is stored."""
    return edges.select("i", "j", "v").union(transpose(drop_loops(edges)))


def drop_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("i <> j")


def is_circulant(edges: DataFrame, n: int, anti: bool = False) -> DataFrame:
    """One row: do all entries of each (anti-)diagonal, wrapped at n, agree? Absent entries are zeros."""
    which = F.pmod(F.col("i") + F.col("j") if anti else F.col("j") - F.col("i"), F.lit(n))
    stored = edges.filter("v <> 0").groupBy(which.alias("w")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    return stored.agg(F.coalesce(F.bool_and((F.col("lo") == F.col("hi")) & (F.col("n") == n)), F.lit(True)).alias("circulant"))


def similar_order(edges: DataFrame) -> DataFrame:
    """A permutation by degree: rows with few neighbours first. (old, new), new dense from 0."""
    degrees = edges.groupBy("i").agg(F.count("*").alias("degree")).select(F.col("i").alias("old"), "degree")
    ranks = degrees.groupBy("degree").agg(F.count("*").alias("n")).select("degree", _before("n", "degree").alias("ahead"))
    inner = F.row_number().over(Window.partitionBy("degree").orderBy("old")) - 1
    return degrees.withColumn("r", inner).join(ranks, "degree").select("old", (F.col("r") + F.col("ahead")).alias("new"))
