import struct

import numpy as np
import pytest

from neighborfield.__main__ import parser, run
from neighborfield.plans import optimizer
from neighborfield.sources import readers, sinks, synthetic

SHORT = ["--max-iter", "60", "--early-iter", "20", "--u", "5"]


@pytest.fixture
def points(spark):
    return synthetic.two_blobs(spark, 40, 3)


def test_points_graph_and_blobs(spark, points, tmp_path):
    sinks.points_text(points, f"{tmp_path}/p")
    run(spark, parser().parse_args(["points", f"{tmp_path}/p", "--out", f"{tmp_path}/a", "--snapshots", "20", *SHORT]))
    assert readers.layout_text(spark, f"{tmp_path}/a/layout").count() == 40
    seen = spark.read.parquet(f"{tmp_path}/a/snapshots")
    assert {(r["iter"], r["count"]) for r in seen.groupBy("iter").count().collect()} == {(19, 40), (39, 40), (59, 40)}
    sinks.graph_text(synthetic.random_graph(spark, 30), 30, f"{tmp_path}/g")
    y = run(spark, parser().parse_args(["graph", f"{tmp_path}/g", "--out", f"{tmp_path}/b", "--parquet", "--lam", "2", "--eta", "5", *SHORT]))
    assert spark.read.parquet(f"{tmp_path}/b/layout").count() == 30 and y.columns == ["i", "y0", "y1"]
    run(spark, parser().parse_args(["blobs", "--points", "40", "--clusters", "2", "--d", "1", "--distance", "cosine", "--pca", "4", "--standardise", "--out", f"{tmp_path}/c", *SHORT]))
    assert readers.layout_text(spark, f"{tmp_path}/c/layout").columns == ["i", "y0"]


def test_binary_file_with_its_own_parameters(spark, points, tmp_path):
    x = np.array([r.x for r in points.orderBy("i").collect()])
    (tmp_path / "data.dat").write_bytes(struct.pack("<iiddii", 40, 3, 0.5, 6.0, 3, 30) + x.astype("<f8").tobytes() + struct.pack("<i", 7))
    y = run(spark, parser().parse_args(["binary", f"{tmp_path}/data.dat", "--out", f"{tmp_path}/out"]))
    assert y.columns == ["i", "y0", "y1", "y2"] and y.count() == 40
    with pytest.raises(SystemExit):
        run(spark, parser().parse_args(["graph", "--out", f"{tmp_path}/none"]))


def test_callback_stops_and_costs_fall(spark, points):
    from neighborfield.operators import affinity, knn

    edges = affinity.perplexity_edges(knn.exact_knn(points, 15), 5)
    steps = []
    last = optimizer.embed_graph(edges, max_iter=200, early_iter=50, eta=10.0, every=40, callback=lambda step, y, cost: steps.append((step, y.count(), cost["kl"])) or step >= 119)
    assert [(s, n) for s, n, _ in steps] == [(39, 40), (79, 40), (119, 40)] and last.count() == 40
    log = {r.iter: r.kl for r in optimizer.cost_log(edges, max_iter=200, early_iter=50, eta=10.0, every=40).collect()}
    assert log[199] < log[-1] and abs(log[119] - steps[-1][2]) < 1e-12 and len(log) == 6


@pytest.mark.parametrize("d, h", [(1, 0.05), (2, 0.08), (3, 0.13)])
def test_grid_repulsion_is_near_the_exact_one(d, h):
    from neighborfield.params import EmbeddingParams

    y = np.random.default_rng(d).random((1000, d))
    near, z = optimizer._repulsion(y, EmbeddingParams(d=d, h=h))
    exact, true = optimizer._repulsion(y - y.min(0), EmbeddingParams(d=d, repulsion="exact"))
    assert np.abs(near - exact).max() < 1e-7 and abs(z / true - 1) < 1e-4


def test_too_coarse_a_grid_falls_back_to_the_exact_sum():
    from neighborfield.params import EmbeddingParams

    same = 0
    for seed in range(20):
        y = np.random.default_rng(seed).normal(size=(25, 2)) * 5000
        push, z = optimizer._repulsion(y, EmbeddingParams())
        exact, true = optimizer._repulsion(y, EmbeddingParams(repulsion="exact"))
        assert z > 0 and np.isfinite(push).all()
        same += bool(z == true and (push == exact).all())
    assert same


def test_a_star_of_many_leaves_is_embedded():
    n = 1200
    leaf = np.arange(1, n)
    i, j = np.concatenate([np.zeros(n - 1, int), leaf]), np.concatenate([leaf, np.zeros(n - 1, int)])
    start = np.random.default_rng(0).normal(size=(n, 2)) * 1e-4
    from neighborfield.params import EmbeddingParams

    (_, before, _), *_, (_, after, y) = optimizer.descend(start, i, j, np.full(len(i), 0.5 / (n - 1)), EmbeddingParams(max_iter=60, early_iter=20))
    assert np.isfinite(y).all() and np.isfinite([before, after]).all()
