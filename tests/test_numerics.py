import numpy as np
import pytest
from pyspark.sql import functions as F

from neighborfield.functions import kernels
from neighborfield.operators import affinity, forces, formats, grid, knn, linalg, pair_blocks, preprocess
from neighborfield.params import EmbeddingParams, grid_size
from neighborfield.plans import optimizer
from neighborfield.sources import synthetic


def layout(spark, n, d, seed=1):
    y = np.random.default_rng(seed).random((n, d))
    return y, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(y)], ", ".join(["i long", *(f"y{m} double" for m in range(d))]))


def exact(y):
    gap = y[:, None] - y[None]
    q = 1 / (1 + (gap * gap).sum(2))
    z = q.sum() - len(y)
    return np.einsum("ij,ijm->im", q * q, gap) / z, z


@pytest.mark.parametrize(("d", "h"), [(1, 0.05), (2, 0.08), (2, 0.13)])
def test_grid_repulsion_is_near_exact(spark, d, h):
    y, df = layout(spark, 400, d)
    f, z = exact(y)
    phi = grid.nuconv(df, h, fft=True)
    zeta = grid.zeta_from_phi(phi)
    assert abs(zeta.first()["zeta"] - z) < 1e-4 * z
    got = np.array([[r[f"f{m}"] for m in range(d)] for r in forces.forces_from_phi(phi, zeta).orderBy("i").collect()])
    assert np.abs(got - f).max() < 1e-7


def test_fft_and_joined_convolution_agree(spark):
    _, df = layout(spark, 60, 2)
    cells = grid.scatter(grid.stencil(grid.placed(grid.shift_to_origin(df), 0.05)))
    a = {(r.c0, r.c1): r.phi1 for r in grid.convolve(cells).collect()}
    b = {(r.c0, r.c1): r.phi1 for r in grid.convolve_fft(cells).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_attraction_matches_a_loop(spark):
    y, df = layout(spark, 200, 2)
    edges = affinity.symmetrise(synthetic.random_graph(spark, 200))
    want = np.zeros((200, 2))
    for r in edges.collect():
        gap = y[r.i] - y[r.j]
        want[r.i] += r.v / (1 + gap @ gap) * gap
    got = {r.i: (r.f0, r.f1) for r in forces.attraction(edges, df).collect()}
    assert max(np.abs(want[i] - got[i]).max() for i in got) < 1e-10


def test_repulsion_sums_to_zero_and_weights_to_one(spark):
    _, df = layout(spark, 100, 3)
    r = forces.repulsion(df).agg(*(F.abs(F.sum(f"f{m}")).alias(f"f{m}") for m in range(3))).first()
    assert max(r) < 1e-12
    w = spark.range(11).select((F.col("id") / 10).alias("x")).select(kernels.total(kernels.lagrange_weights(F.col("x"))).alias("l"), kernels.total(kernels.keys_weights(F.col("x"))).alias("k"), kernels.total(kernels.box_basis(F.col("x"), 4)).alias("b")).collect()
    assert all(abs(v - 1) < 1e-12 for r in w for v in r)


def test_perplexity_has_the_entropy_asked_for(spark):
    p = synthetic.uniform_points(spark, 120, 4)
    rows = affinity.perplexity(knn.exact_knn(p, 30, block=50), 10).collect()
    assert len(rows) == 120
    for r in rows:
        v = np.array(r.p)
        assert abs(v.sum() - 1) < 1e-12 and abs(-(v * np.log(v)).sum() - np.log(10)) < 2e-5


def test_blocks_do_not_change_neighbours_and_ties_go_by_id(spark):
    same = spark.createDataFrame([(i, [float(i // 3), 0.0]) for i in range(30)], "i long, x array<double>")
    a = {tuple(r) for r in knn.exact_knn(same, 4, block=7).collect()}
    assert a == {tuple(r) for r in knn.cross_knn(same, 4).collect()}


def test_lambda_rescale_reaches_its_target(spark):
    e = affinity.row_stochastic(synthetic.random_graph(spark, 50, 6, 11))
    rows = e.join(affinity.lambda_rescale(e, 3.0).select("i", "j", "sigma"), ["i", "j"]).groupBy("i").agg(F.sum(F.exp(F.col("sigma") * F.ln("v"))).alias("s")).collect()
    assert all(abs(r.s - 3) < 1e-4 for r in rows)
    leaf = spark.createDataFrame([(0, 1, 1.0), (1, 0, 0.4), (1, 2, 0.6)], "i long, j long, v double")
    assert {(r.i, r.v) for r in affinity.lambda_rescale(leaf, 1.5, drop_leaf=True).filter("i = 0").collect()} == {(0, 0.0)}


def test_edge_cases_of_formats(spark):
    e = spark.createDataFrame([(0, 0, 1.0), (3, 1, 0.0), (3, 2, 2.0)], "i long, j long, v double")
    assert [tuple(r) for r in formats.csr_offsets(e).orderBy("i").collect()] == [(0, 0, 1), (3, 1, 2)]
    assert formats.csr_offsets(e.limit(0)).count() == 0
    zero = spark.createDataFrame([(0, 1, 0.0)], "i long, j long, v double")
    assert affinity.row_stochastic(zero).first()["v"] == 0
    ring = spark.createDataFrame([(i, (i + 1) % 5, 2.0) for i in range(5)], "i long, j long, v double")
    assert formats.is_circulant(ring, 5).first()["circulant"] and not formats.is_circulant(e, 5).first()["circulant"]
    assert linalg.spmv(e, spark.createDataFrame([(0, 1.0), (2, 3.0)], "i long, x double"), linalg.MIN_PLUS).filter("i = 3").first()["x"] == 5


def test_optimiser_lowers_the_cost_and_separates_blobs(spark):
    p = synthetic.two_blobs(spark, 80, 5)
    y = {r.i: np.array([r.y0, r.y1]) for r in optimizer.embed_points(p, u=8.0, max_iter=400, early_iter=100, repulsion="exact", seed=3).collect()}
    a, b = np.array([y[i] for i in range(40)]), np.array([y[i] for i in range(40, 80)])
    assert np.linalg.norm(a.mean(0) - b.mean(0)) > 2 * max(a.std(), b.std())


def test_array_loop_equals_dataframe_steps(spark):
    p = EmbeddingParams(max_iter=3, repulsion="exact", early_iter=1, momentum_iter=1)
    edges = affinity.joint(affinity.row_stochastic(synthetic.random_graph(spark, 40)))
    start = optimizer.initial_layout(spark.range(40).select(F.col("id").alias("i")), 2, scale=1.0)
    a = np.array([[r.y0, r.y1] for r in optimizer.optimise_one_task(edges, start, p).orderBy("i").collect()])
    b = np.array([[r.y0, r.y1] for r in optimizer.optimise(edges, start, p, checkpoint=2).orderBy("i").collect()])
    assert np.allclose(a, b, atol=1e-9)


def test_preparation(spark):
    p = synthetic.uniform_points(spark, 60, 4)
    x = np.array([r.x for r in p.orderBy("i").collect()])
    z = np.array([r.x for r in preprocess.standardise(p).orderBy("i").collect()])
    assert np.allclose(z, (x - x.mean(0)) / x.std(0, ddof=1))
    w = np.array([r.x for r in preprocess.whiten(p).orderBy("i").collect()])
    gap = x[0] - x[1]
    assert abs(np.linalg.norm(w[0] - w[1]) - np.sqrt(gap @ np.linalg.inv(np.cov(x.T)) @ gap)) < 1e-9
    assert grid_size(20.2, 0.7) == 30 and grid_size(0.1, 0.7) == 14 and grid_size(1e6, 0.7) == 510


def test_all_pairs_keep_ties_and_leave_out_what_is_not_finite(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 3, (150, 3)), np.full((1, 3), np.nan), rng.normal(size=(60, 3)) + 1e6]).astype(float)
    points = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "i long, x array<double>").repartition(7)
    d2 = ((x[:, None] - x[None]) ** 2).cumsum(2)[:, :, -1]
    np.fill_diagonal(d2, np.inf)
    want = {(i, int(j), r + 1) for i in range(len(x)) if i != 150 for r, j in enumerate([j for j in np.lexsort((np.arange(len(x)), d2[i])) if j != 150][:6])}
    assert want == {(r.i, r.j, r["rank"]) for r in knn.exact_knn(points, 6, block=40).collect()}


def test_all_pairs_send_points_to_a_bounded_number_of_chunks(spark, monkeypatch):
    """Blocks of a fixed size made the copies of a point grow with the points."""
    seen, pack = [], pair_blocks._packed
    monkeypatch.setattr(pair_blocks, "_packed", lambda p, chunks, asks: seen.append(chunks) or pack(p, chunks, asks))
    for n in (10, 20_000, 1_000_000):
        knn.exact_knn(spark.range(n).select(F.col("id").alias("i"), F.array(F.col("id").cast("double")).alias("x")), 3)
    assert seen == [1, 1, 48, 48, 48, 48]


def test_gram_of_rows_that_batches_cut(spark, monkeypatch):
    """Equal to the product, without a row for each pair of entries."""
    monkeypatch.setattr(linalg, "PRODUCTS", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        rng = np.random.default_rng(4)
        a = rng.integers(1, 9, (20, 11)) * (rng.random((20, 11)) < 0.5)
        i, j = np.nonzero(a)
        edges = spark.createDataFrame([(int(r), int(c), float(a[r, c])) for r, c in zip(i, j, strict=True)], "i long, j long, v double")
        found = linalg.gram(edges)
        assert "Join" not in found._jdf.queryExecution().toString()
        rows = found.collect()
        assert len(rows) == len({(r.i, r.j) for r in rows}) == np.count_nonzero(a.T @ a) and all(r.v == (a.T @ a)[r.i, r.j] for r in rows)
        assert linalg.gram(edges.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_gram_adds_up_rows_that_share_columns_before_they_are_sent(spark):
    """Entries that stand twice count as their sum, and what is sent grows with the result and not with the products."""
    rng = np.random.default_rng(6)
    rows, a = [], np.zeros((4000, 12))
    for i, j, v in zip(rng.integers(0, 4000, 30000).tolist(), rng.integers(0, 12, 30000).tolist(), rng.integers(1, 9, 30000).tolist(), strict=True):
        rows.append((i, j, float(v)))
        a[i, j] += v
    edges = spark.createDataFrame(rows, "i long, j long, v double").repartition(4)
    assert {(r.i, r.j): r.v for r in linalg.gram(edges).collect()} == {(i, j): (a.T @ a)[i, j] for i in range(12) for j in range(12)}
    assert sum(len(r.v) // 8 for r in linalg.packed_sums(edges).collect()) <= 4 * 78  # four ranges of rows, 78 sums with i <= j
