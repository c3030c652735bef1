"""Snapshots and measurements of a running optimisation as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshots(spark: SparkSession, path: str, d: int) -> DataFrame:
    """Layouts that sinks.snapshot() appends, as they come: (i, y0, .., iter)."""
    schema = ", ".join(["i long", *(f"y{m} double" for m in range(d)), "iter int"])
    return spark.readStream.schema(schema).parquet(path)


def spread(stream: DataFrame) -> DataFrame:
    """(iter, n, width): points and the widest extent of each snapshot, kept up to date."""
    dims = [c for c in stream.columns if c.startswith("y")]
    width = [F.max(c) - F.min(c) for c in dims]
    return stream.groupBy("iter").agg(F.count("*").alias("n"), (F.greatest(*width) if len(width) > 1 else width[0]).alias("width"))
