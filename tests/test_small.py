"""Small operators, the service and the command line's further options."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from neighborfield.__main__ import parser, run
from neighborfield.functions import array_metrics, kernels
from neighborfield.operators import affinity, forces, formats, knn, preprocess
from neighborfield.params import EmbeddingParams
from neighborfield.plans import optimizer
from neighborfield.sources import readers, sinks
from tests.test_scale import by_id, edge_frame, frame, point_frame


@pytest.fixture(scope="module")
def ring(spark):
    a = np.roll(np.eye(12), 1, 1) + np.roll(np.eye(12), -1, 1)
    return edge_frame(spark, a / a.sum())


@pytest.mark.parametrize("name", sorted(array_metrics.MEASURES))
def test_array_distances_equal_those_of_columns(spark, name):
    x = np.random.default_rng(1).integers(-2, 3, (12, 5)).astype(float)
    x[0] = 0
    found = array_metrics.MEASURES[name](x, x)
    both = point_frame(spark, x[1:]).crossJoin(point_frame(spark, x[1:]).select(F.col("i").alias("j"), F.col("x").alias("_x")))
    if name == "correlation":
        both = both.filter(F.size(F.array_distinct("x")) > 1).filter(F.size(F.array_distinct("_x")) > 1)
    for r in both.select("i", "j", kernels.metric(name, F.col("x"), F.col("_x")).alias("m")).collect():
        assert math.isclose(r.m, found[r.i + 1, r.j + 1], abs_tol=1e-9)
    if name == "cosine":
        assert (found[0] == 1).all()


@pytest.mark.parametrize("distance", ["euclidean", "seuclidean", "mahalanobis", "spearman", "cosine", "hamming"])
def test_neighbours_by_any_distance(spark, distance):
    x = np.random.default_rng(2).normal(size=(60, 4)) * [1, 5, 0.2, 3]
    if distance == "hamming":
        x = np.round(x)
    found = knn.metric_knn(point_frame(spark, x), 4, distance).collect()
    assert len(found) == 240
    if distance in ("seuclidean", "mahalanobis"):
        scale = np.diag(1 / x.var(0, ddof=1)) if distance == "seuclidean" else np.linalg.inv(np.cov(x.T))
        gap = x[:, None] - x[None]
        d2 = np.einsum("ijm,mn,ijn->ij", gap, scale, gap)
        np.fill_diagonal(d2, np.inf)
        assert {(r.i, r.j) for r in found} == {(i, int(j)) for i in range(60) for j in np.argsort(d2[i])[:4]}
    with pytest.raises(ValueError, match="no distance"):
        knn.metric_knn(point_frame(spark, x), 4, "none")


def test_embeddings_take_other_distances_and_the_tree(spark):
    points = point_frame(spark, np.random.default_rng(3).normal(size=(40, 5)))
    options = {"u": 5.0, "max_iter": 5, "early_iter": 2, "eta": 5.0}
    assert optimizer.embed_points(points, distance="cityblock", **options).count() == 40
    a = by_id(optimizer.embed_points(points, neighbours="tree", **options), "y0", "y1")
    b = by_id(optimizer.embed_points(points, **options), "y0", "y1")
    assert np.allclose(a, b)
    with pytest.raises(ValueError, match="no distance"):
        optimizer.embed_points(points, neighbours="ivf", distance="cityblock", **options)


def test_a_graph_that_is_stochastic_is_taken_as_it_is(spark, ring):
    rows = affinity.row_stochastic(ring)
    plain = optimizer.graph_weights(rows, EmbeddingParams(stochastic=True))
    again = optimizer.graph_weights(rows.withColumn("v", F.col("v") * 7), EmbeddingParams())
    assert np.allclose(sorted(map(tuple, plain.collect())), sorted(map(tuple, again.collect())))


def test_binary_results(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(30, 3))
    sinks.points_binary(point_frame(spark, x), f"{tmp_path}/data.dat", perplexity=4.0, iterations=10)
    y = run(spark, parser().parse_args(["binary", f"{tmp_path}/data.dat", "--out", f"{tmp_path}/out"]))
    raw = (tmp_path / "out" / "result.dat").read_bytes()
    assert struct.unpack("<ii", raw[:8]) == (30, 2) and len(raw) == 8 + 30 * (16 + 4 + 8)
    found = readers.binary_result(spark, f"{tmp_path}/out/result.dat").orderBy("i").collect()
    assert np.allclose([r.y for r in found], by_id(y, "y0", "y1")) and [r.landmark for r in found] == list(range(30))


def test_circulant_matrices(spark):
    ring = np.roll(np.eye(6), 1, 1) * 3 + np.roll(np.eye(6), 2, 1)
    turned = np.fliplr(ring)
    is_ = lambda a, anti: formats.is_circulant(edge_frame(spark, a), 6, anti).first()["circulant"]
    assert is_(ring, False) and is_(turned, True) and not is_(turned, False) and not is_(ring, True)
    ring[0, 1] = 4
    assert not is_(ring, False)


def test_permutations_blocks_and_row_limits(spark, ring):
    order = spark.createDataFrame([(k, (5 * k) % 12) for k in range(12)], "old long, new long")
    back = formats.permute(formats.permute(ring, order), formats.inverse(order))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ring.collect()))
    laid = formats.blocked(ring, 2).collect()
    assert len(laid) == 24 and {(r.block_row, r.block_col) for r in laid} == {(r.i >> 2, r.j >> 2) for r in laid}
    assert preprocess.first_points(point_frame(spark, np.ones((5, 2))), 3).count() == 3


def test_gradient_service_and_twin_errors(spark, ring):
    y = frame(spark, np.random.default_rng(5).normal(size=(12, 2)))
    service = optimizer.GradientService(ring, EmbeddingParams(repulsion="exact"))
    want = by_id(forces.gradient(forces.attraction(ring, y), forces.repulsion(y), 1.0), "d0", "d1")
    assert np.allclose(by_id(service.gradient(y), "d0", "d1"), want) and service.cost(y) > 0
    service.close()
    errors = optimizer.twin_errors(ring, y, EmbeddingParams(eta=1.0, h=0.2), 2)
    assert [e["iter"] for e in errors] == [0, 1] and all(e["error"] < 1e-2 for e in errors)


@pytest.mark.parametrize("name", sorted(array_metrics.PAIRS))
def test_distances_of_all_pairs_by_tiles(name):
    """Tiles and rows of pairs give a distance alike, equal points and far ones included, and no near pair is ruled out."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(-2, 3, (40, 20)), rng.normal(size=(40, 20)), np.full((3, 20), 2.0), rng.normal(size=(20, 20)) * 1e-3 + 1e5])
    pairs, plain = array_metrics.PAIRS[name], array_metrics.MEASURES[name](x, x)
    own = pairs.prepare(x)
    r, c = (v.ravel() for v in np.indices(plain.shape))
    assert np.allclose(pairs.tile(own, own), plain, rtol=1e-9, atol=1e-9)
    assert np.allclose(pairs.squared(own[r], own[c]), plain[r, c] ** 2, rtol=1e-9, atol=1e-9)
    limit = np.sqrt(np.sort(pairs.squared(own[r], own[c]).reshape(plain.shape), axis=1)[:, 7])
    near = pairs.near(own, pairs.ready(own), limit)
    assert near[pairs.squared(own[r], own[c]).reshape(plain.shape) <= (limit * limit)[:, None]].all()


def test_summaries_of_all_pairs_are_no_rows_of_pairs(spark):
    x = np.random.default_rng(2).normal(size=(300, 4))
    d = array_metrics.cityblock(x, x)
    apart = d[~np.eye(300, dtype=bool)].reshape(300, 299)
    found = knn.metric_summaries(point_frame(spark, x), "cityblock")
    got = {r.i: (r.least, r.most, r.total) for r in found.collect()}
    assert "Join" not in found._jdf.queryExecution().toString()
    assert all(np.allclose(got[i], (a.min(), a.max(), a.sum())) for i, a in enumerate(apart))


@pytest.mark.parametrize("name", ["cityblock", "chebychev", "minkowski"])
@pytest.mark.parametrize("odd", ["plain", "far", "equal", "wide", "shifted"])
def test_codes_rule_out_no_near_pair_and_most_others(name, odd):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(70, 64)) * 0.125, rng.normal(size=(4096, 64)) * 0.125
    if odd == "far":
        b[::100, 3] = 1e9
        a[1] = b[100]
    elif odd == "equal":
        a[:], b[:] = 0.25, 0.25
    elif odd == "wide":
        a, b = np.tile(a, 20), np.tile(b[:300], 20)
    elif odd == "shifted":
        a, b = a + 1e9, b + 1e9
    pairs = array_metrics.PAIRS[name]
    true = np.concatenate([array_metrics.MEASURES[name](a, b[lo : lo + 64]) for lo in range(0, len(b), 64)], 1)
    for part in (0.0, 0.001, 0.5):
        limit = np.quantile(true, part, axis=1)
        near = pairs.near(a, pairs.ready(b), limit)
        assert near[true <= limit[:, None]].all()
        assert part != 0.001 or odd != "plain" or near.mean() < 0.05
    assert pairs.near(a, pairs.ready(b), np.full(len(a), np.inf)).all()


def test_sums_of_differences_are_told_apart_by_whole_numbers(monkeypatch):
    """Floats, which take several times as long, are for components only that codes don't tell apart."""
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(30, 64)), rng.normal(size=(2000, 64))
    for name in ("cityblock", "chebychev", "minkowski"):
        pairs = array_metrics.PAIRS[name]
        monkeypatch.setattr(pairs, "_near_in_floats", None, raising=False)
        monkeypatch.setattr(pairs, "_add", None)
        assert pairs.near(a, pairs.ready(b), np.full(len(a), 0.1)).sum() == 0
