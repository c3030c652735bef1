"""Operators that divide what others do in one task or over all pairs."""

import struct
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from neighborfield.functions import array_metrics
from neighborfield.operators import blocked, forces, grid, knn, lowrank, metric_tree, nbody, pair_blocks, pencils, preprocess, separators, solvers, tree_forces
from neighborfield.params import EmbeddingParams
from neighborfield.plans import optimizer, queries, scale_queries  # noqa: F401  the last registers its queries
from neighborfield.sources import ranges, sinks
from neighborfield.tables import written
from tests.conftest import SF


def frame(spark, y):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(y)], ", ".join(["i long", *(f"y{m} double" for m in range(y.shape[1]))]))


def point_frame(spark, x):
    return spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "i long, x array<double>")


def edge_frame(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame(list(zip(i.tolist(), j.tolist(), a[i, j].tolist(), strict=True)), "i long, j long, v double")


def by_id(df, *columns):
    return np.array([[r[c] for c in columns] for r in df.orderBy("i").collect()])


@pytest.mark.parametrize("d, nodes, edge", [(2, 14, 5), (3, 7, 4), (3, 6, 100), (4, 3, 2)])
def test_pencils_equal_one_transform(spark, d, nodes, edge):
    y = frame(spark, np.random.default_rng(d).normal(size=(40, d)) * 3)
    cells = grid.scatter(grid.stencil(grid.placed(grid.shift_to_origin(y), nodes=nodes))).persist()
    key = [f"c{m}" for m in range(d)]
    phis = [f"phi{m}" for m in range(d + 1)]
    one = {tuple(r[c] for c in key): [r[p] for p in phis] for r in grid.convolve_fft(cells).collect()}
    parts = {tuple(r[c] for c in key): [r[p] for p in phis] for r in pencils.convolve_pencils(cells, edge=edge).collect()}
    assert one.keys() == parts.keys() and all(np.allclose(one[k], parts[k], rtol=1e-9, atol=1e-9) for k in one)
    assert pencils.convolve_pencils(cells.limit(0)).count() == 0
    with pytest.raises(ValueError, match="pencil"):
        pencils.convolve_pencils(cells.select("c0", "step", "q0"))


def test_pencil_blocks_are_bounded():
    for d, side, charges in ((2, 512, 3), (3, 512, 4), (4, 64, 5)):
        g = pencils._Grid(side, 0.1, d, charges, None)
        assert 1 <= g.edge <= side and 2 * side * g.edge ** (d - 1) * 16 * (charges + 1) <= pencils.PENCIL_BYTES


def test_tree_neighbours_are_exact_and_prune(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(900, 2)) * 20, np.zeros((120, 2)), rng.normal(size=(60, 2)) * 1e-3 + 50])  # equal points, a clump
    points = point_frame(spark, x)
    found, visits = metric_tree.tree_knn(points, 7, written, leaf=32)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    want = [(i, int(j), k + 1) for i in range(len(x)) for k, j in enumerate(np.lexsort((np.arange(len(x)), d2[i]))[:7])]
    got = sorted((r.i, r.j, r["rank"]) for r in found.collect())
    differing = [(a, b) for a, b in zip(sorted(want), got, strict=True) if a != b]
    assert all(abs(d2[a[0], a[1]] - d2[b[0], b[1]]) < 1e-12 for a, b in differing) and len(differing) < 20  # rounding of near ties
    even = np.concatenate([rng.uniform(size=(2000, 2)) * 50])
    _, visits = metric_tree.tree_knn(point_frame(spark, even), 10, written, leaf=32)
    assert (visits.count() + 2000) * 3 * 32 < 2000 * 2000 / 4  # leaves hold up to a few times 32 points


def test_tree_neighbours_of_few_points(spark):
    points = point_frame(spark, np.arange(10.0).reshape(5, 2))
    assert metric_tree.tree_knn(points, 10, written)[0].count() == 20
    assert metric_tree.tree_knn(points.limit(0), 10, written)[0].count() == 0


@pytest.mark.parametrize("d", [2, 3])
def test_tree_repulsion_is_near_the_exact_one(spark, d):
    rng = np.random.default_rng(d)
    y = np.concatenate([rng.normal(size=(500, d)) * 10, rng.normal(size=(200, d)) * 0.01 + 5, np.ones((50, d))])
    names = [f"f{m}" for m in range(d)]
    exact = by_id(forces.repulsion(frame(spark, y)), *names)
    error = lambda theta: np.linalg.norm(by_id(tree_forces.repulsion_tree(frame(spark, y), written, theta), *names) - exact) / np.linalg.norm(exact)
    assert error(0.5) < 5e-3
    assert error(0.0) < 1e-4  # every cell is opened; what is left is the width of the finest cells


def test_tree_of_one_place(spark):
    force = by_id(tree_forces.repulsion_tree(frame(spark, np.ones((5, 2))), written), "f0", "f1")
    assert force.shape == (5, 2) and np.abs(force).max() < 1e-12


def test_nbody_with_any_kernel(spark):
    y = np.random.default_rng(3).uniform(size=(150, 2)) * 6
    q = np.random.default_rng(4).normal(size=(150, 3))
    points = frame(spark, y).join(spark.createDataFrame([(i, *r) for i, r in enumerate(q.tolist())], "i long, q0 double, q1 double, q2 double"), "i")
    d2 = ((y[:, None] - y[None]) ** 2).sum(2)
    for freedom, power in ((1, 1), (0.5, 2), (7, 1)):
        got = by_id(nbody.nbody(points, nbody.student_kernel(freedom, power), 24, 7), "phi0", "phi1", "phi2")
        assert np.abs(got - (1 + d2 / freedom) ** (-power * (freedom + 1) / 2) @ q).max() < 1e-3


def test_triangular_systems(spark):
    rng = np.random.default_rng(5)
    a = np.tril(rng.normal(size=(30, 30)) * (rng.random((30, 30)) < 0.12), -1) + np.diag(rng.uniform(1, 2, 30))
    b = spark.createDataFrame([(i, float(i % 7)) for i in range(30)], "i long, x double")
    right = np.arange(30) % 7
    assert np.allclose(by_id(solvers.solve_lower(edge_frame(spark, a), b, written), "x")[:, 0], np.linalg.solve(a, right))
    assert np.allclose(by_id(solvers.solve_upper(edge_frame(spark, a.T), b, written), "x")[:, 0], np.linalg.solve(a.T, right))
    with pytest.raises(ValueError, match="triangular"):
        solvers.solve_lower(edge_frame(spark, a + np.eye(30, k=1) + np.eye(30, k=-1)), b, written)
    with pytest.raises(ValueError, match="diagonal"):
        solvers.solve_lower(edge_frame(spark, np.tril(np.ones((3, 3)), -1)), b, written)


def test_conjugate_gradients(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(12, 8))
    b = rng.normal(size=12)
    right = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "i long, x double")
    got = by_id(solvers.least_squares(edge_frame(spark, a), right, written), "x")[:, 0]
    assert np.allclose(got, np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-8)
    x, residual, steps = solvers.solve_cg(edge_frame(spark, np.eye(3)), right.withColumn("x", F.lit(0.0)).filter("i < 3"), written)
    assert (residual, steps) == (0.0, 0) and x.agg(F.sum("x")).first()[0] == 0
    with pytest.raises(RuntimeError, match="residual"):
        solvers.solve_cg(edge_frame(spark, a.T @ a), right.filter("i < 8"), written, tol=0.0, most=3)


def test_dissection_of_a_grid_graph(spark):
    n = 20
    at = lambda r, c: r * n + c
    pairs = [(at(r, c), at(r + dr, c + dc), 1.0) for r in range(n) for c in range(n) for dr, dc in ((0, 1), (1, 0)) if r + dr < n and c + dc < n]
    graph = spark.createDataFrame(pairs, "i long, j long, v double")
    path = {r.node: r.path for r in separators.dissect(graph, written, rounds=1).collect()}
    assert not [1 for i, j, _ in pairs if {path[i], path[j]} == {"0", "1"}]
    sizes = [sum(p == s for p in path.values()) for s in "012"]
    assert sizes[2] <= 2 * n and min(sizes[:2]) >= 0.3 * n * n  # a straight cut has n nodes
    order = {r.old: r.new for r in separators.order_of(spark.createDataFrame(list(path.items()), "node long, path string")).collect()}
    assert sorted(order.values()) == list(range(n * n))


def test_boxes_are_bounded_and_sum_what_the_plain_join_sums(spark):
    rng = np.random.default_rng(7)
    y = frame(spark, np.concatenate([rng.normal(size=(600, 2)) * 30, rng.normal(size=(300, 2)) * 1e-4, np.zeros((200, 2))])).persist()
    box = blocked.boxes(y, 50)
    counts = [r["count"] for r in box.groupBy("box").count().collect()]
    assert sum(counts) == 1100 and max(counts) <= 200 and len(counts) <= 120
    edges = spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in zip(rng.integers(0, 1100, 4000), rng.integers(0, 1100, 4000), rng.random(4000), strict=True)], "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    graph = blocked.block_graph(edges, box, 4)
    got, want = blocked.blocked_attraction(graph, y), forces.attraction(edges, y)
    assert np.allclose(by_id(got, "f0", "f1"), by_id(want, "f0", "f1"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("blocked_edges") - 400 : plan.index("blocked_edges")]
    assert "Exchange" not in scan.rsplit("FlatMapCoGroups", 1)[-1].split("Scan")[0]  # edges stay where they are
    assert sorted(r.new for r in blocked.box_order(y, box).collect()) == list(range(1100))
    assert blocked.box_counts(edges, box).agg(F.sum("n")).first()[0] == edges.count()
    graph.close()


def test_singular_values_of_a_kernel(spark):
    x = np.random.default_rng(8).uniform(size=(300, 2)) * 4
    kernel = lambda d2: 1 / (1 + d2)
    whole = kernel(((x[:, None] - x[None]) ** 2).sum(2))
    true = np.linalg.svd(whole, compute_uv=False)
    points = point_frame(spark, x).repartition(5)
    assert np.allclose(lowrank.singular_values(points, kernel, 6, written), true[:6], rtol=1e-4)
    got = {r["rank"]: r["error"] for r in lowrank.rank_errors(points, kernel, [1, 3], written).collect()}
    assert all(abs(got[k] - np.sqrt((true[k:] ** 2).sum() / (true**2).sum())) < 1e-5 for k in got)


def test_principal_components_both_ways(spark):
    rng = np.random.default_rng(9)
    for x, run in ((rng.normal(size=(60, 7)) @ np.diag(range(7, 0, -1)) + 100, preprocess.pca), (rng.normal(size=(9, 40)) * np.arange(1, 41), preprocess.pca_dual), (rng.normal(size=(9, 40)) * np.arange(1, 41), preprocess.pca)):
        u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
        v = v * np.where(v[np.arange(len(v)), np.abs(v).argmax(1)] < 0, -1, 1)[:, None]
        got = np.array([r.x for r in run(point_frame(spark, x), 4).orderBy("i").collect()])
        assert np.allclose(got, (x - x.mean(0)) @ v[:4].T, atol=1e-7)


def test_whitened_distances(spark):
    x = np.random.default_rng(10).normal(size=(50, 4)) @ np.random.default_rng(11).normal(size=(4, 4))
    w = np.array([r.x for r in preprocess.whiten(point_frame(spark, x)).orderBy("i").collect()])
    inverse = np.linalg.inv(np.cov(x.T))
    gap = x[:, None] - x[None]
    assert np.allclose(((w[:, None] - w[None]) ** 2).sum(2), np.einsum("ijm,mn,ijn->ij", gap, inverse, gap))


def test_binary_points_in_parts(spark, tmp_path):
    ranges.register(spark)
    x = np.random.default_rng(12).normal(size=(101, 3))
    path = str(tmp_path / "data.dat")
    sinks.points_binary(point_frame(spark, x).repartition(3), path)
    own = spark.read.format("binary_points").option("parts", 4).load(path)
    assert own.rdd.getNumPartitions() == 4 and np.array_equal(np.array([r.x for r in own.orderBy("i").collect()]), x)
    assert spark.read.format("binary_points").option("rows", 10).load("file://" + path).count() == 10
    assert own.select(F.size("x")).distinct().collect()[0][0] == 3


def element(kind, raw):
    if 0 < len(raw) <= 4:
        return struct.pack("<HH", kind, len(raw)) + raw.ljust(4, b"\0")
    return struct.pack("<II", kind, len(raw)) + raw + b"\0" * (-len(raw) % 8)


def matrix(name, body, shape, kind=6, extra=0):
    head = element(6, struct.pack("<II", kind | extra, 0)) + element(5, struct.pack("<2i", *shape)) + element(1, name.encode())
    return element(14, head + body)


def mat_file(path, *variables, compress=False):
    packed = [struct.pack("<II", 15, len(z := zlib.compress(v))) + z for v in variables] if compress else variables
    path.write_bytes(b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + b"".join(packed))
    return str(path)


@pytest.mark.parametrize("compress", [False, True])
def test_mat_files(spark, tmp_path, compress):
    ranges.register(spark)
    x = np.random.default_rng(13).normal(size=(23, 5))
    small = np.arange(12, dtype=np.uint8).reshape(4, 3)
    a = np.array([[0, 2.5, 0], [1.5, 0, 0], [0, -3.0, 4.0], [0, 0, 0]])
    i, j = np.nonzero(a.T)[::-1]
    sparse = element(5, i.astype("<i4").tobytes()) + element(5, np.searchsorted(j, range(4)).astype("<i4").tobytes()) + element(9, a[i, j].astype("<f8").tobytes())
    path = mat_file(
        tmp_path / "data.mat",
        matrix("train_X", element(9, x.T.astype("<f8").tobytes()), x.shape), matrix("n", element(2, small.T.tobytes()), small.shape, 9), matrix("A", sparse, a.shape, 5),
        compress=compress,
    )
    read = lambda kind, variable, **options: spark.read.format(kind).options(variable=variable, **options).load(path)
    own = read("mat_points", "train_X", parts=3)
    assert own.rdd.getNumPartitions() == (1 if compress else 3)
    assert np.array_equal(np.array([r.x for r in own.orderBy("i").collect()]), x)
    assert [r.x for r in read("mat_points", "n", rows=2).orderBy("i").collect()] == small[:2].astype(float).tolist()
    want = sorted((int(r), int(c), float(a[r, c])) for r, c in zip(*np.nonzero(a), strict=True))
    assert sorted(map(tuple, read("mat_entries", "A", parts=2).collect())) == want
    assert read("mat_entries", "n").count() == 11
    with pytest.raises(Exception, match="no variable"):
        read("mat_points", "none").count()


def test_a_loop_measures_its_stages_and_takes_the_tree(spark):
    rng = np.random.default_rng(14)
    a = np.triu(rng.random((40, 40)) * (rng.random((40, 40)) < 0.2), 1)
    edges = edge_frame(spark, (a + a.T) / (a + a.T).sum())
    start = frame(spark, rng.normal(size=(40, 2)))
    times = optimizer.StageTimes()
    grid_run = by_id(optimizer.optimise(edges, start, EmbeddingParams(max_iter=3, eta=10.0), times=times), "y0", "y1")
    rows = times.table(spark).groupBy("stage").agg(F.count("*").alias("n"), F.min("ms").alias("least")).collect()
    assert {r.stage: r.n for r in rows} == {"attractive": 3, "repulsive": 3, "update": 3} and all(r.least > 0 for r in rows)
    tree_run = by_id(optimizer.optimise(edges, start, EmbeddingParams(max_iter=3, eta=10.0, repulsion="tree", theta=0.0)), "y0", "y1")
    assert np.abs(tree_run - grid_run).max() < 1e-4


def test_a_stretched_grid_is_summed_by_the_tree(spark):
    layouts = (np.random.default_rng(seed).normal(size=(25, 2)) * 5000 for seed in range(20))
    p = EmbeddingParams(theta=0.0)
    bad = next(y for y in layouts if optimizer._repulsion(y, p)[1] == optimizer._exact(y)[1])  # where the grid's zeta isn't positive
    push, z = optimizer._exact(bad)
    got, zeta = optimizer.repulsive_sums(frame(spark, bad), p)
    assert abs(zeta.first()["zeta"] / z - 1) < 1e-3 and np.allclose(by_id(got, "f0", "f1"), push, rtol=1e-2, atol=1e-6 * np.abs(push).max())


@pytest.mark.parametrize("band", [16, 3])
def test_toeplitz_products_of_any_size(spark, monkeypatch, band):
    from neighborfield.operators import line_fft, linalg

    monkeypatch.setattr(line_fft, "BAND", band)
    rng = np.random.default_rng(15)
    lag, x = rng.normal(size=599), rng.normal(size=300)
    lags = spark.createDataFrame([(k - 299, float(v)) for k, v in enumerate(lag)] + [(500, 9.0)], "l0 long, v double")
    got = {r.i0: r.x for r in linalg.toeplitz_multiply(lags, spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i0 long, x double")).collect()}
    assert np.allclose([got[i] for i in range(300)], [sum(lag[i - j + 299] * x[j] for j in range(300)) for i in range(300)])
    grid2, far = rng.normal(size=(7, 11)), rng.normal(size=(13, 21))
    rows = spark.createDataFrame([(i, j, float(grid2[i, j])) for i in range(7) for j in range(11)], "i0 long, i1 long, x double")
    two = spark.createDataFrame([(a - 6, b - 10, float(far[a, b])) for a in range(13) for b in range(21)], "l0 long, l1 long, v double")
    got = {(r.i0, r.i1): r.x for r in linalg.toeplitz_multiply(two, rows).collect()}
    want = {(i, j): sum(far[i - a + 6, j - b + 10] * grid2[a, b] for a in range(7) for b in range(11)) for i in range(7) for j in range(11)}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert linalg.toeplitz_multiply(two, rows.limit(0)).count() == 0


@pytest.mark.parametrize("edge, most", [(32, 65_536), (3, 20)])
def test_points_gather_from_blocks_of_cells(spark, edge, most):
    rng = np.random.default_rng(16)
    y = frame(spark, np.concatenate([rng.normal(size=(150, 2)) * 5, np.full((90, 2), 3.0)]))
    points = grid.placed(grid.shift_to_origin(y), nodes=14)
    rows = grid.stencil(points)
    cells = {(r.c0, r.c1): (r.q0, r.q1, r.q2) for r in grid.scatter(rows).collect()}
    fast = {(r.c0, r.c1): (r.q0, r.q1, r.q2) for r in grid.scatter_points(points).collect()}
    assert cells.keys() == fast.keys() and all(np.allclose(cells[k], fast[k]) for k in cells)
    phi = grid.convolve_fft(grid.scatter(rows)).persist()
    names = ("phi0", "phi1", "phi2")
    assert np.allclose(by_id(grid.gather_points(points, phi, edge, most), *names), by_id(grid.gather(rows, phi), *names))


def test_neighbours_in_hot_cells(spark):
    from neighborfield.operators import knn

    x = np.random.default_rng(17).normal(size=(90, 3))
    listed = point_frame(spark, x).withColumn("cell", F.when(F.col("i") < 70, 0).otherwise(F.col("i") % 2 + 1))
    found = knn.ranked(knn.in_cells(listed.withColumn("reach", F.lit(float("inf"))), listed, 4, block=16), 4)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    cell = np.where(np.arange(90) < 70, 0, np.arange(90) % 2 + 1)
    d2[cell[:, None] != cell[None]] = np.inf
    np.fill_diagonal(d2, np.inf)
    assert {(r.i, r.j) for r in found.collect()} == {(i, int(j)) for i in range(90) for j in np.argsort(d2[i])[:4]}


@pytest.mark.parametrize("options", [{"repulsion": "exact"}, {"repulsion": "tree"}, {"repulsion": "exact", "tol": 1e-30}])
def test_a_loop_drops_what_it_wrote(spark, options):
    import os

    from neighborfield.tables import shared_folder

    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    ring = np.roll(np.eye(12), 1, 1) + np.roll(np.eye(12), -1, 1)
    seen = []
    y = optimizer.optimise(edge_frame(spark, ring / ring.sum()), frame(spark, np.random.default_rng(5).normal(size=(12, 2))), EmbeddingParams(max_iter=5, eta=1.0, **options), lambda step, own, cost: seen.append((step, own.count())), every=2, checkpoint=3)
    assert y.count() == 12 and seen == [(1, 12), (3, 12), (4, 12)]
    left = {x.split("-")[0] for x in set(os.listdir(folder)) - before}
    assert left == {"layout"}


def test_tree_points_that_visit_most_leaves_are_not_sent_to_them(spark, monkeypatch):
    seen, cells = [], metric_tree.in_cells
    monkeypatch.setattr(metric_tree, "in_cells", lambda q, *a: seen.append(q.count()) or cells(q, *a))
    x = np.random.default_rng(4).normal(size=(800, 12))
    found, visits = metric_tree.tree_knn(point_frame(spark, x), 3, written, leaf=8)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    assert {(r.i, r.j, r["rank"]) for r in found.collect()} == {(i, int(j), k + 1) for i in range(800) for k, j in enumerate(np.argsort(d2[i])[:3])}
    assert visits.count() > 800 * 50 and seen[1] < 800 * 20


@pytest.mark.parametrize("bucket", [0.05, 6.0])
def test_coarse_and_fine_buckets_give_what_shares_one(spark, monkeypatch, bucket):
    from neighborfield.operators import knn, pair_blocks

    passed, own = [], pair_blocks.nearest
    monkeypatch.setattr(pair_blocks, "nearest", lambda *a: passed.append(1) or own(*a))
    points = point_frame(spark, np.random.default_rng(6).normal(size=(300, 5)))
    rows = lambda df: {(r.i, r.j, r["rank"], round(r.d2, 9)) for r in df.collect()}
    found = rows(knn.lsh_knn(points, 4, bucket, tables=3))
    assert bool(passed) == (bucket > 1)
    monkeypatch.setattr(knn, "MEET", 0 if passed else 1e9)  # the other way
    assert found == rows(knn.lsh_knn(points, 4, bucket, tables=3))


def test_kernel_products_of_equal_points_meet_once(spark):
    x = np.repeat(np.arange(5.0), 20)[:, None]
    u = np.random.default_rng(3).normal(size=(100, 2))

    def kernel(d2):
        assert d2.size <= 25  # five different points
        return 1 / (1 + d2)

    found = lowrank.kernel_times(point_frame(spark, x), spark.createDataFrame([(i, r) for i, r in enumerate(u.tolist())], "i long, u array<double>"), kernel)
    assert np.allclose(by_id(found, "u")[:, 0], 1 / (1 + (x - x.T) ** 2) @ u)


def test_components_as_points_are_gathered_from_runs(spark):
    x = np.random.default_rng(9).normal(size=(37, 4))
    found = preprocess.turned(point_frame(spark, x).repartition(3), run=5)
    assert {r.i: r.x for r in found.collect()} == {m: x[:, m].tolist() for m in range(4)}
    assert "posexplode" not in found._jdf.queryExecution().toString()  # no row for a value
    assert preprocess.turned(point_frame(spark, x).limit(0)).count() == 0


def test_axes_of_few_points_are_signed_by_blocks(spark):
    x = np.random.default_rng(10).normal(size=(6, 50))
    own = x - x.mean(0)
    axes = np.linalg.svd(own, full_matrices=False)[2][:3]
    axes *= np.sign(axes[np.arange(3), np.abs(axes).argmax(1)])[:, None]
    got = by_id(preprocess.pca_dual(point_frame(spark, x), 3, block=7), "x")[:, 0]
    assert np.allclose(got, own @ axes.T)


def noted_rows(df, folder):
    """df, and how many of its rows have been made so far."""
    folder.mkdir()

    def note(batches):
        for b in batches:
            with open(folder / uuid.uuid4().hex, "w") as f:
                f.write(str(b.num_rows))
            yield b

    return df.mapInArrow(note, df.schema), lambda: sum(int(f.read_text()) for f in folder.iterdir())


@pytest.mark.parametrize("name, k", [("gradient_step", 10), ("attractive_blocked", 10), ("dist_max_normalised", 10), ("joint_affinity", 90)])
def test_neighbours_are_found_once(spark, monkeypatch, tmp_path, name, k):
    seen, find = [], knn.exact_knn

    def found(points, k):
        df, rows = noted_rows(find(points, k), tmp_path / str(len(seen)))
        seen.append(rows)
        return df

    monkeypatch.setattr(knn, "exact_knn", found)
    n = queries.QUERIES[name](spark, SF).select("i").distinct().count()
    queries.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    assert seen[1]() == k * n


@pytest.mark.parametrize("name", ["gradient_step", "repulsive_exact"])
def test_pairs_of_a_layout_are_summed_once(spark, monkeypatch, tmp_path, name):
    seen, sums = [], forces.kernel_sums

    def summed(y):
        df, rows = noted_rows(sums(y), tmp_path / str(len(seen)))
        seen.append(rows)
        return df

    monkeypatch.setattr(forces, "kernel_sums", summed)
    n = queries.layout(spark, SF).count()
    queries.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    assert [rows() for rows in seen] == [n]


def test_kernel_sums_of_chunks_and_blocks(spark, monkeypatch):
    """Each point is sent once to each chunk of queries, however many blocks there are."""
    monkeypatch.setattr(pair_blocks, "PACKED", 32)
    y = np.random.default_rng(2).normal(size=(300, 3)) * 5
    rows = by_id(forces.kernel_sums(frame(spark, y), block=70), "phi0", "phi1", "phi2", "phi3", "z")
    q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
    want = np.concatenate([(q * q).sum(1)[:, None], (q * q) @ y, q.sum(1)[:, None] - 1], 1)
    assert np.allclose(rows, want, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("size, middle", [(1.0, 0.0), (1.0, 3e4), (1e-25, 0.0), (1e25, 0.0), (1e-3, 1e14)])
def test_float_products_rule_no_neighbour_out(size, middle):
    x = np.random.default_rng(3).normal(size=(400, 8)) * size + middle
    own = pair_blocks.Nearest(np.arange(400), x, 5, array_metrics.PAIRS["euclidean"])
    own.see(np.arange(400), x)
    gaps = x[:, None] - x[None]
    d2 = np.cumsum(gaps * gaps, axis=2)[:, :, -1]
    d2[np.diag_indices(400)] = np.inf
    j = np.lexsort((np.broadcast_to(np.arange(400), d2.shape), d2), axis=-1)[:, :5]
    own._settle()
    assert (own.j == j).all() and (own.d2 == np.take_along_axis(d2, j, 1)).all()


def test_two_steps_are_those_of_the_sql_beyond_few_points(spark, duck, monkeypatch):
    made = []
    monkeypatch.setattr(optimizer, "EXACT_POINTS", 100)
    monkeypatch.setattr(optimizer, "written", lambda df, name: made.append(name) or written(df, name))
    found = {r["i"]: (r["y0"], r["y1"]) for r in queries.QUERIES["optimise_two_steps"](spark, SF).collect()}
    want = {i: y for i, *y in duck.execute(queries.ORACLE_SQL["optimise_two_steps"]).fetchall()}
    assert len(found) > 100 and found.keys() == want.keys()
    assert max(abs(a - b) for i in want for a, b in zip(found[i], want[i], strict=True)) < 1.5e-5  # the last digit at most
    assert [n for n in made if n.startswith(("exact-sums", "grid", "state-"))] == ["exact-sums", "state-0", "exact-sums", "state-1"]


@pytest.mark.parametrize("spread", [20.0, 1e7])
def test_kernel_sums_are_exact_however_far_points_are(spread):
    rng = np.random.default_rng(3)
    y = np.repeat(rng.uniform(0, spread, size=(150, 2)), 2, 0) + 1e6
    y[1::2] += rng.normal(size=(150, 2))  # a near one for each
    sums = forces.KernelSums(np.arange(300), y)
    for lo in range(0, 300, 128):
        sums.see(np.arange(lo, min(lo + 128, 300)), y[lo : lo + 128])
    gap = y[:, None] - y[None]
    q = 1 / (1 + (gap * gap).sum(2))
    want = np.concatenate([(q * q).sum(1, keepdims=True), q * q @ y, q.sum(1, keepdims=True)], 1)
    assert np.allclose(sums.sums, want, rtol=1e-11, atol=0)


def test_neighbours_of_a_block_are_looked_for_in_few_rows(monkeypatch):
    rng, looked = np.random.default_rng(4), []
    x = rng.normal(size=(16_384, 16))
    own = pair_blocks.Nearest(np.arange(64), x[:64], 1, array_metrics.PAIRS["euclidean"])
    find = np.flatnonzero
    monkeypatch.setattr(pair_blocks.np, "flatnonzero", lambda v: looked.append(np.size(v)) or find(v))
    for lo in range(0, len(x), 1024):
        own.see(np.arange(lo, lo + 1024), x[lo : lo + 1024])
    own._settle()
    d2 = ((x[:64, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2[:, :64], np.inf)
    assert (own.j[:, 0] == d2.argmin(1)).all()
    assert sum(looked) < 64 * len(x) / 2  # of all pairs


@pytest.mark.parametrize("different", [7, 3000])
def test_interpolation_errors_compare_different_points_in_blocks(spark, different):
    rng = np.random.default_rng(different)
    x, q = rng.uniform(size=different)[np.arange(3000) % different], rng.normal(size=3000)
    charges = spark.createDataFrame(list(enumerate(q.tolist())), "i long, q double")
    found = lowrank.interpolation_errors(point_frame(spark, x[:, None]), charges, lambda d2: 1 / (1 + d2), [1, 3], 0.0, 1.0)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan  # a row for each pair of points
    f = (1 / (1 + (x[:, None] - x) ** 2)) @ q
    for n, z in ((1, np.zeros(1)), (3, np.array([0.0, 0.5, 1.0]))):
        w = np.stack([np.prod([(x - z[m]) / (z[k] - z[m]) for m in range(n) if m != k], axis=0) * np.ones(len(x)) for k in range(n)], 1)
        g = w @ ((1 / (1 + (z[:, None] - z) ** 2)) @ (w.T @ q))
        assert np.isclose(found.filter(F.col("nodes") == n).first()["error"], np.sqrt(((f - g) ** 2).sum() / (f * f).sum()), rtol=1e-9)


@pytest.mark.parametrize("repulsion", ["grid", "exact"])
def test_rounds_of_tasks_equal_one_task(spark, monkeypatch, repulsion):
    monkeypatch.setattr(optimizer, "EXACT_POINTS", 0)
    monkeypatch.setattr(optimizer, "SOME_EDGES", 64)  # edges and points come in several parts
    rng = np.random.default_rng(5)
    a = np.triu((rng.uniform(size=(90, 90)) < 0.1) * rng.uniform(size=(90, 90)), 1)
    a = (a + a.T) / (2 * a.sum())
    y = rng.normal(size=(90, 2)) * 8
    p = EmbeddingParams(max_iter=4, early_iter=2, eta=10.0, repulsion=repulsion)
    known = optimizer.descend(y, *np.nonzero(a), a[np.nonzero(a)], p, 2)
    found = list(optimizer.rounds(edge_frame(spark, a), frame(spark, y), p, 2, tasks=3))
    for (step, cost, layout), (true_step, true_cost, true) in zip(found, known, strict=True):
        assert step == true_step and abs(cost - true_cost) < 1e-9 and np.allclose(by_id(layout, "y0", "y1"), true, atol=1e-9)


def test_graphs_beyond_one_task_run_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(optimizer, "ONE_TASK_POINTS", 10)
    monkeypatch.setattr(optimizer, "optimise", None)
    monkeypatch.setattr(optimizer, "optimise_one_task", None)
    edges = edge_frame(spark, np.ones((30, 30)) - np.eye(30))
    assert optimizer.embed_graph(edges, max_iter=3).count() == 30
    steps = []
    optimizer.embed_graph(edges, max_iter=4, every=2, callback=lambda step, y, cost: steps.append((step, y.count())) or True)
    assert steps == [(1, 30)]
    assert {r.iter for r in optimizer.cost_log(edges, max_iter=4, every=2).collect()} == {-1, 1, 3}


def test_costs_beyond_rounds_are_logged_from_the_start(spark, monkeypatch):
    edges = edge_frame(spark, np.ones((12, 12)) - np.eye(12))
    known = {r.iter: r.kl for r in optimizer.cost_log(edges, max_iter=2, early_iter=1, every=1).collect()}
    monkeypatch.setattr(optimizer, "ROUNDS_POINTS", 1)
    found = {r.iter: r.kl for r in optimizer.cost_log(edges, max_iter=2, early_iter=1, every=1).collect()}
    assert sorted(found) == [-1, 0, 1] and all(abs(found[k] - known[k]) < 1e-9 for k in known)
