"""Embeddings from the command line: python -m neighborfield points|graph|binary|blobs ... --out FOLDER.

points: a text file of points (--plain: without a header). graph: a coordinate file of a weighted graph. binary: a binary
file of points with its own parameters. blobs: generated clusters. The layout is written as text in order of the points,
with --parquet as a table, and for a binary file also as a binary result (result.dat); --snapshots keeps the layouts of every so many steps.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from neighborfield.functions.array_metrics import MEASURES, PREPARED
from neighborfield.params import EmbeddingParams
from neighborfield.plans import optimizer
from neighborfield.sources import readers, sinks, synthetic


def parser() -> argparse.ArgumentParser:
    default = EmbeddingParams()
    out = argparse.ArgumentParser(prog="neighborfield", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("kind", choices=["points", "graph", "binary", "blobs"])
    out.add_argument("path", nargs="?", help="the input file")
    out.add_argument("--out", required=True)
    out.add_argument("--plain", action="store_true", help="points without a header")
    out.add_argument("--symmetric", action="store_true", help="the graph file holds one triangle")
    out.add_argument("--points", type=int, default=None, help="at most so many points, or so many generated ones")
    out.add_argument("--clusters", type=int, default=4)
    out.add_argument("--neighbours", choices=["exact", "tree", "ivf", "ivfpq"], default="exact")
    out.add_argument("--distance", choices=sorted([*MEASURES, *PREPARED]), default="euclidean")
    out.add_argument("--standardise", action="store_true")
    out.add_argument("--pca", type=int, default=None)
    out.add_argument("--parquet", action="store_true")
    out.add_argument("--snapshots", type=int, default=None, metavar="STEPS")
    out.add_argument("--drop-leaf", action="store_true")
    out.add_argument("--stochastic", action="store_true", help="the graph's rows already sum to 1")
    out.add_argument("--repulsion", choices=["grid", "exact", "tree"], default=default.repulsion)
    for name in ("d", "max_iter", "early_iter", "momentum_iter", "seed"):
        out.add_argument(f"--{name.replace('_', '-')}", type=int, default=None)
    for name in ("u", "lam", "alpha", "eta", "h", "tol", "theta"):
        out.add_argument(f"--{name}", type=float, default=None)
    return out


def run(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """The layout, which is also written to given.out."""
    chosen = {k: getattr(given, k) for k in ("d", "max_iter", "early_iter", "momentum_iter", "seed", "u", "lam", "alpha", "eta", "h", "tol", "theta") if getattr(given, k) is not None}
    chosen |= {"drop_leaf": given.drop_leaf, "stochastic": given.stochastic, "repulsion": given.repulsion}
    if given.kind != "blobs" and not given.path:
        raise SystemExit(f"{given.kind}: no input file")
    if given.kind == "binary":
        header, points = readers.binary_points(spark, given.path)
        chosen = {"u": header["perplexity"], "d": header["dims"], "max_iter": header["max_iter"], "seed": header["seed"] or 0} | chosen
    elif given.kind == "blobs":
        points = synthetic.clusters(spark, given.points or 1000, given.clusters)
    elif given.kind == "points":
        points = readers.points_plain(spark, given.path, given.points) if given.plain else readers.points_text(spark, given.path, given.points)
    p = EmbeddingParams(**chosen)
    keep = {}
    if given.snapshots:
        keep = {"callback": lambda step, y, _: sinks.snapshot(y, step, f"{given.out}/snapshots"), "every": given.snapshots}
    if given.kind == "graph":
        y = optimizer.embed_graph(readers.matrix_market(spark, given.path, given.symmetric), p, **keep)
    else:
        y = optimizer.embed_points(points, p, given.neighbours, distance=given.distance, standardise=given.standardise, pca=given.pca, **keep)
    if given.kind == "binary":
        sinks.result_file(y, f"{given.out}/result.dat")
    (sinks.layout_parquet if given.parquet else sinks.layout_text)(y, f"{given.out}/layout")
    return y


def main() -> None:
    given = parser().parse_args()
    spark = SparkSession.builder.appName("neighborfield").getOrCreate()
    run(spark, given)
    spark.stop()


if __name__ == "__main__":
    main()
