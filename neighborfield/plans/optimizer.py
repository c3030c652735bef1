"""The gradient-descent loop, as DataFrame steps, and whole embeddings from points or graphs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neighborfield.functions.kernels import dot, lagrange_terms
from neighborfield.operators import affinity, forces, grid, knn, metric_tree, preprocess, tree_forces
from neighborfield.sources.synthetic import normal, uniform
from neighborfield.params import FLT_MIN, EmbeddingParams, grid_size
from neighborfield.tables import drop, noted, written

#: Points and edges up to which a whole optimisation is one task's, about 50 MB; beyond, each step is distributed.
ONE_TASK_POINTS, ONE_TASK_EDGES = 20_000, 2_000_000
#: Points whose places are sent whole to all tasks of a step, 8 MB in two dimensions (what Spark broadcasts by itself);
#: beyond, places are joined with edges. Edges of a block, and how many of them are looked at at once.
ROUNDS_POINTS, BLOCK_EDGES, SOME_EDGES = 500_000, 1_000_000, 1 << 16
#: Points up to which repulsion is the exact sum: a grid that few points stretch over has too few in a cell, and its sum
#: of interpolated kernels can even be negative.
EXACT_POINTS = 1024


def initial_layout(ids: DataFrame, d: int, scale: float = 1e-4, seed: int = 0, gaussian: bool = True) -> DataFrame:
    """(i, y0, ..): scale * N(0, 1) (or U(0, 1)) from a hash of i and the seed, the same in any partitioning."""
    value = lambda m: (normal if gaussian else uniform)(seed, "i", F.lit(m)) * scale
    return ids.select("i", *(value(m).alias(f"y{m}") for m in range(d)))


def update(state: DataFrame, gradient: DataFrame, p: EmbeddingParams, momentum: float) -> DataFrame:
    """state (i, y0.., u0.., g0..) after one step, centred."""
    dims = [c[1:] for c in state.columns if c.startswith("y")]
    out = state.join(gradient, "i")
    gains = {f"g{m}": F.greatest(F.when(F.signum(f"d{m}") != F.signum(f"u{m}"), F.col(f"g{m}") + p.gain_up).otherwise(F.col(f"g{m}") * p.gain_down), F.lit(p.least_gain)) for m in dims}
    out = out.withColumns(gains)
    out = out.withColumns({f"u{m}": momentum * F.col(f"u{m}") - p.eta * F.col(f"g{m}") * F.col(f"d{m}") for m in dims})
    out = out.withColumns({f"y{m}": F.col(f"y{m}") + F.col(f"u{m}") for m in dims}).select(*state.columns)
    means = out.agg(*(F.avg(f"y{m}").alias(f"_m{m}") for m in dims))
    return out.crossJoin(F.broadcast(means)).withColumns({f"y{m}": F.col(f"y{m}") - F.col(f"_m{m}") for m in dims}).select(*state.columns)


def by_size(p: EmbeddingParams, n: int) -> EmbeddingParams:
    return replace(p, repulsion="exact") if n <= EXACT_POINTS and p.repulsion == "grid" else p


def repulsive_sums(y: DataFrame, p: EmbeddingParams) -> tuple[DataFrame, DataFrame]:
    """Repulsive force (i, f0, ..) and zeta (one row), by pairs, by the grid or by the tree.

    A grid that few points stretch over can give a zeta that is not positive; such a layout is summed by the tree."""
    if p.repulsion == "exact":
        phi = written(forces.kernel_sums(y), "exact-sums")
        zeta = forces.zeta_from_pairs(phi)
        return forces.forces_from_phi(phi, zeta), zeta
    if p.repulsion == "grid":
        phi = written(grid.nuconv(y, p.spacing, p.grid, fft=True), "grid-sums")
        zeta = forces.zeta_from_phi(phi)
        if (zeta.first()["zeta"] or 0) > 0:
            return forces.forces_from_phi(phi, zeta), zeta
    sums = written(tree_forces.tree_sums(y, written, p.theta), "tree-sums")
    zeta = sums.agg(F.sum("z").alias("zeta"))
    return sums.crossJoin(F.broadcast(zeta)).select("i", *((F.col(f"p{c[1:]}") / F.col("zeta")).alias(f"f{c[1:]}") for c in forces.axes(y))), zeta


def step_gradient(edges: DataFrame, y: DataFrame, p: EmbeddingParams, alpha: float) -> DataFrame:
    return forces.gradient(forces.attraction(edges, y), repulsive_sums(y, p)[0], alpha)


class StageTimes:
    """What a running optimisation measures: rows (iter, stage, ms), one for each stage of a step."""

    def __init__(self):
        self.rows: list[tuple[int, str, float]] = []

    def written(self, df: DataFrame, step: int, stage: str) -> DataFrame:
        began = time.perf_counter()
        out = written(df, stage)
        self.rows.append((step, stage, 1000 * (time.perf_counter() - began)))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "iter int, stage string, ms double")


def start_state(y: DataFrame) -> DataFrame:
    dims = [c[1:] for c in forces.axes(y)]
    return y.select("i", *(f"y{m}" for m in dims), *(F.lit(0.0).alias(f"u{m}") for m in dims), *(F.lit(1.0).alias(f"g{m}") for m in dims))


def schedule(p: EmbeddingParams, step: int) -> tuple[float, float]:
    """(alpha, momentum) of a step: both change after the step of their number."""
    return (p.alpha if step <= p.early_iter else 1.0), (p.momentum if step <= p.momentum_iter else p.late_momentum)


def optimise(edges: DataFrame, y: DataFrame, p: EmbeddingParams, callback: Callable[[int, DataFrame, dict], bool | None] | None = None, every: int = 50, checkpoint: int = 5, times: StageTimes | None = None) -> DataFrame:
    """The loop with one job chain for each few steps; edges and state stay distributed. callback may stop it by True.

    times: each step's attraction, repulsion and update are written and measured apart. What a step has written is dropped
    when the next state is there, so a layout given to callback is to be read while it is called."""
    with noted() as made:
        edges = written(edges.select("i", "j", "v"), "edges")
        kept = made.pop()  # the edges, until the end
        state = written(start_state(y), "state")
        layout = written(_steps(edges, state, p, callback, every, checkpoint, times, made).select("i", *forces.axes(y)), "layout")
        drop(layout.sparkSession, [*made[:-1], kept])
    return layout


def _steps(edges: DataFrame, state: DataFrame, p: EmbeddingParams, callback, every: int, checkpoint: int, times: StageTimes | None, made: list[str]) -> DataFrame:
    """The state after all steps. made: paths of what was written; only the newest state is kept."""
    n = state.count()
    p = by_size(p, n)
    chained = p.repulsion == "exact" and n <= EXACT_POINTS  # so few points that a step costs less than its files
    dims = [c for c in state.columns if c.startswith("y")]
    for step in range(p.max_iter):
        alpha, momentum = schedule(p, step)
        own = state.select("i", *dims)
        if times is None:
            gradient = step_gradient(edges, own, p, alpha)
        else:
            pull = times.written(forces.attraction(edges, own), step, "attractive")
            push = times.written(repulsive_sums(own, p)[0], step, "repulsive")
            gradient = forces.gradient(pull, push, alpha)
        if p.tol > 0:
            gradient = written(gradient, "gradient")  # the state and the norm read it
        state = update(state, gradient, p, momentum)
        last = step == p.max_iter - 1
        settled = times is not None or last or not chained or (step + 1) % checkpoint == 0 or bool(callback) and (step + 1) % every == 0
        if settled:
            state = written(state, f"state-{step}") if times is None else times.written(state, step, "update")
        small = p.tol > 0 and gradient.agg(F.max(sum(F.abs(f"d{c[1:]}") for c in dims))).first()[0] < p.tol
        if settled:
            drop(state.sparkSession, made[:-1])
            del made[:-1]
        if small:
            break
        if callback and ((step + 1) % every == 0 or last):
            own = state.select("i", *dims)
            cost = forces.kl_cost(edges, own, repulsive_sums(own, p)[1], alpha).first()["kl"]
            if callback(step, own, {"iter": step, "kl": cost, "alpha": alpha}):
                break
    return state


def _exact(y: np.ndarray, own: slice) -> tuple[np.ndarray, float]:
    mine = y[own]
    f, z = np.zeros_like(mine), 0.0
    for lo in range(0, len(mine), 512):
        for at in range(0, len(y), SOME_EDGES):
            gap = mine[lo : lo + 512, None] - y[None, at : at + SOME_EDGES]
            q = 1 / (1 + (gap * gap).sum(2))
            z += q.sum()
            f[lo : lo + 512] += np.einsum("ij,ijm->im", q * q, gap)
    return f, z - len(mine)


def _sums(y: np.ndarray, p: EmbeddingParams, own: slice = slice(None)) -> tuple[np.ndarray, float]:
    """Repulsion times zeta on some of all points, and their part of zeta: exact, or by the padded transform of the grid."""
    n, d = y.shape
    if p.repulsion == "exact":
        return _exact(y, own)
    y = y - y.min(0)
    spread = float(y.max())
    if spread <= 0:
        return np.zeros_like(y[own]), float(len(y[own]) * (n - 1)) or 1.0
    g = p.grid or grid_size(spread, p.spacing)
    h = spread / (g - 1 - 2.220446049250313e-16)
    t = np.minimum(y / spread, 1 - 2.220446049250313e-16) * (g - 1)
    f = np.floor(t).astype(int)
    x = t - f
    w = np.stack(lagrange_terms(x), 2)  # n, d, 4
    side = g + 2
    cell, weight = np.zeros((n, 1), int), np.ones((n, 1))
    for m in range(d):
        cell = (cell[:, :, None] * side + (f[:, m, None] + np.arange(4))[:, None, :]).reshape(n, -1)
        weight = (weight[:, :, None] * w[:, m][:, None, :]).reshape(n, -1)
    lags = (np.fft.fftfreq(2 * side) * 2 * side) * h
    kernel = np.fft.rfftn(1 / (1 + sum(np.meshgrid(*[lags * lags] * d, indexing="ij"))) ** 2)
    mine, phi = y[own], np.zeros((len(y[own]), d + 1))
    for c in range(d + 1):
        charge = weight if c == 0 else weight * y[:, c - 1, None]
        cells = np.bincount(cell.ravel(), weights=charge.ravel(), minlength=side**d).reshape([side] * d)
        padded = np.fft.irfftn(np.fft.rfftn(cells, [2 * side] * d, range(d)) * kernel, [2 * side] * d, range(d))
        phi[:, c] = (weight[own] * padded[tuple(slice(0, side) for _ in range(d))].ravel()[cell[own]]).sum(1)
    z = float(((1 + 2 * (mine * mine).sum(1)) * phi[:, 0] - 2 * (mine * phi[:, 1:]).sum(1)).sum() - len(mine))
    return mine * phi[:, :1] - phi[:, 1:], z


def _repulsion(y: np.ndarray, p: EmbeddingParams) -> tuple[np.ndarray, float]:
    """Repulsive force and zeta in one process."""
    f, z = _sums(y, p)
    if not z > 0:  # few points on a far stretched grid: the layout is summed exactly
        f, z = _exact(y, slice(None))
    return f / z, z


def _moved(y: np.ndarray, u: np.ndarray, gains: np.ndarray, dy: np.ndarray, p: EmbeddingParams, momentum: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, steps and gains after a step by the gradient dy."""
    gains = np.maximum(np.where(np.sign(dy) != np.sign(u), gains + p.gain_up, gains * p.gain_down), p.least_gain)
    u = momentum * u - p.eta * gains * dy
    y = y + u
    return y - y.mean(0), u, gains


def descend(y: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray, p: EmbeddingParams, every: int = 50) -> list[tuple[int, float, np.ndarray]]:
    """The same loop on arrays: (step, cost, layout) before the first step, after each `every`-th and after the last. The
    costs are those without exaggeration."""
    u, gains, seen = np.zeros_like(y), np.ones_like(y), []
    n, d = y.shape
    p = by_size(p, n)

    def look(step: int) -> None:
        gap = y[i] - y[j]
        q = 1 / (1 + (gap * gap).sum(1))
        seen.append((step, float((v * np.log((v + FLT_MIN) / (q / _repulsion(y, p)[1] + FLT_MIN))).sum()), y))

    look(-1)
    for step in range(p.max_iter):
        alpha, momentum = schedule(p, step)
        gap = y[i] - y[j]
        q = 1 / (1 + (gap * gap).sum(1))
        pull = np.stack([np.bincount(i, weights=v * q * gap[:, m], minlength=n) for m in range(d)], 1)
        push, _ = _repulsion(y, p)
        dy = alpha * pull - push
        y, u, gains = _moved(y, u, gains, dy, p, momentum)
        done = step == p.max_iter - 1 or p.tol > 0 and np.abs(dy).sum(1).max() < p.tol
        if done or (step + 1) % every == 0:
            look(step)
        if done:
            break
    return seen


def optimise_one_task(edges: DataFrame, y: DataFrame, p: EmbeddingParams, every: int | None = None) -> DataFrame:
    """(i, y0, ..) for graphs that fit a task: the loop runs where the edges are gathered, not on the driver.

    every: rows (iter, kl, i, y0, ..) of the start (iter -1), each `every`-th step and the last one instead."""
    dims = forces.axes(y)
    both = edges.select(F.col("i").alias("a"), F.col("j").alias("b"), "v", *(F.lit(None).cast("double").alias(c) for c in dims)).unionByName(y.select(F.col("i").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("v"), *dims))

    def run(part: pa.Table) -> pa.Table:
        b = part["b"].to_numpy()
        point = np.isnan(b.astype(float))
        ids = part["a"].to_numpy()[point]
        order = np.argsort(ids)
        ids = ids[order]
        start = np.stack([part[c].to_numpy()[point] for c in dims], 1)[order]
        a, b, v = part["a"].to_numpy()[~point], b[~point].astype(np.int64), part["v"].to_numpy()[~point]
        sort = np.lexsort((b, a))
        seen = descend(start, np.searchsorted(ids, a[sort]), np.searchsorted(ids, b[sort]), v[sort], p, every or p.max_iter)
        if every is None:
            return pa.table([ids, *seen[-1][2].T], names=["i", *dims])
        n = len(ids)
        parts = [pa.table([np.full(n, step, np.int32), np.full(n, kl), ids, *out.T], names=["iter", "kl", "i", *dims]) for step, kl, out in seen]
        return pa.concat_tables(parts)

    schema = ["i long", *(f"{c} double" for c in dims)]
    return both.groupBy(F.lit(0).alias("whole")).applyInArrow(run, ", ".join(schema if every is None else ["iter int", "kl double", *schema]))


def _edge_blocks(edges: DataFrame, numbers: DataFrame, tasks: int) -> DataFrame:
    """(task, a, b, v): each task's edges between points' numbers, by a, in blocks of bytes."""
    ends = edges.join(numbers.select("i", "task", F.col("k").alias("a")), "i").join(numbers.select(F.col("i").alias("j"), F.col("k").alias("b")), "j")
    ends = ends.select("task", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "v").repartitionById(tasks, "task").sortWithinPartitions("task", "a", "b")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            part = pa.Table.from_batches(held)
            own = [pa.array([part[c].to_numpy().tobytes()], pa.binary()) for c in ("a", "b", "v")]
            held.clear()
            return pa.RecordBatch.from_arrays([part["task"].combine_chunks().slice(0, 1), *own], names=["task", "a", "b", "v"])

        for batch in batches:
            if held and held[0]["task"][0] != batch["task"][0]:
                yield block()
            held.append(batch)
            if sum(len(b) for b in held) >= BLOCK_EDGES:
                yield block()
        if held:
            yield block()

    return ends.mapInArrow(pack, "task int, a binary, b binary, v binary")


def _pull(y: np.ndarray, blocks, own: slice, z: float | None) -> tuple[np.ndarray, float]:
    """Attraction of a task's points without exaggeration; with zeta its part of the cost instead."""
    pull, cost, columns = np.zeros_like(y[own]), 0.0, list(np.ascontiguousarray(y.T))
    for a, b, v in blocks:
        a, b, v = np.frombuffer(a, np.int32), np.frombuffer(b, np.int32), np.frombuffer(v)
        for lo in range(0, len(a), SOME_EDGES):
            i, j, w = a[lo : lo + SOME_EDGES].astype(np.intp), b[lo : lo + SOME_EDGES].astype(np.intp), v[lo : lo + SOME_EDGES]
            gaps = [c.take(i, mode="clip") - c.take(j, mode="clip") for c in columns]
            q = 1 / (1 + sum(gap * gap for gap in gaps))
            if z is not None:
                cost += float((w * np.log((w + FLT_MIN) / (q / z + FLT_MIN))).sum())
                continue
            q *= w
            first = i[0]
            i -= first
            for m, gap in enumerate(gaps):
                part = np.bincount(i, weights=q * gap)
                pull[first - own.start : first - own.start + len(part), m] += part
    return pull, cost


def rounds(edges: DataFrame, y: DataFrame, p: EmbeddingParams, every: int | None = None, tasks: int | None = None) -> Iterator[tuple[int, float | None, DataFrame]]:
    """(step, cost, layout) as descend(), of each `every`-th step or (None) of the last one without its cost.

    Each step is one job: tasks hold their points' edges, are told the places of all points (a broadcast, 16 bytes a point
    in two dimensions) and give the forces on their own; only places, steps and gains are moved where the loop is."""
    spark, dims, n = y.sparkSession, forces.axes(y), y.count()
    context, p = spark.sparkContext, by_size(p, n)
    tasks = tasks or max(1, min(context.defaultParallelism, -(-n // 1024)))
    dealt = y.select("i", F.pmod(F.xxhash64("i"), F.lit(tasks)).cast("int").alias("task"))
    counts = dict(dealt.groupBy("task").count().collect())
    starts = [sum(counts.get(t, 0) for t in range(task)) for task in range(tasks + 1)]
    place = F.row_number().over(Window.partitionBy("task").orderBy("i")) - 1 + F.get(F.array(*map(F.lit, starts)), F.col("task"))
    numbers = written(dealt.withColumn("k", place), "numbers")
    blocks = _edge_blocks(edges, numbers, tasks).rdd.map(lambda r: (r.task, bytes(r.a), bytes(r.b), bytes(r.v))).persist(StorageLevel.MEMORY_AND_DISK)

    def ask(at: np.ndarray, how: EmbeddingParams, zeta: float | None = None) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Attraction, repulsion times zeta, zeta and cost; with zeta the cost alone."""
        told = context.broadcast(at)

        def run(part: int, rows) -> Iterator[tuple]:
            own = slice(starts[part], starts[part + 1])
            pull, cost = _pull(told.value, (r[1:] for r in rows), own, zeta)
            push, z = (np.zeros((0, 0)), 0.0) if zeta is not None else _sums(told.value, how, own)
            yield part, pull.tobytes(), push.tobytes(), z, cost

        try:
            found = sorted(blocks.mapPartitionsWithIndex(run).collect())
        finally:
            told.destroy()
        shaped = lambda c: np.frombuffer(b"".join(r[c] for r in found)).reshape(-1, len(dims))
        return shaped(1), shaped(2), sum(r[3] for r in found), sum(r[4] for r in found)

    def forces_at(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        pull, push, z, _ = ask(at, p)
        if not z > 0:
            pull, push, z, _ = ask(at, replace(p, repulsion="exact"))
        return pull, push / z, z

    def layout(at: np.ndarray) -> DataFrame:
        known = spark.createDataFrame(pa.table([np.arange(n), *np.ascontiguousarray(at.T)], names=["k", *dims]))
        return written(numbers.select("i", "k").join(known, "k").select("i", *dims), "layout")

    try:
        first = numbers.join(y, "i").select("k", *dims).toArrow()
        order = np.argsort(first["k"].to_numpy())
        at = np.stack([first[c].to_numpy()[order] for c in dims], 1)
        u, gains = np.zeros_like(at), np.ones_like(at)
        pull, push, z = forces_at(at)
        if every:
            yield -1, ask(at, p, z)[3], layout(at)
        for step in range(p.max_iter):
            alpha, momentum = schedule(p, step)
            dy = alpha * pull - push
            at, u, gains = _moved(at, u, gains, dy, p, momentum)
            done = step == p.max_iter - 1 or p.tol > 0 and np.abs(dy).sum(1).max() < p.tol
            if done and not every:
                yield step, None, layout(at)
                break
            pull, push, z = forces_at(at)
            if done or (step + 1) % every == 0 if every else False:
                yield step, ask(at, p, z)[3], layout(at)
            if done:
                break
    finally:
        blocks.unpersist()


def loop_kind(points: int, edges: int, p: EmbeddingParams) -> str:
    """How a graph is optimised: whole in one task, in rounds of tasks that are told all places, or by joins."""
    if p.repulsion == "tree" or points > ROUNDS_POINTS:
        return "joins"
    return "whole" if points <= ONE_TASK_POINTS and edges <= ONE_TASK_EDGES else "rounds"


def graph_weights(edges: DataFrame, p: EmbeddingParams) -> DataFrame:
    """The joint weights of a weighted graph (i, j, v): stochastic (unless it is said to be), rescaled, symmetric, total 1."""
    rows = edges.select("i", "j", "v") if p.stochastic else affinity.row_stochastic(affinity.drop_diagonal(edges))
    if p.lam != 1:
        rows = affinity.lambda_rescale(rows, p.lam, drop_leaf=p.drop_leaf).select("i", "j", "v")
    return affinity.joint(rows, written)


def embed_graph(edges: DataFrame, p: EmbeddingParams | None = None, y0: DataFrame | None = None, callback: Callable[[int, DataFrame, dict], bool | None] | None = None, every: int = 50, **overrides) -> DataFrame:
    """(i, y0, ..) of a weighted graph (i, j, v): its joint weights, optimised.

    callback(step, layout, {"iter", "kl"}) is given each `every`-th layout in order; where it returns True that layout is
    the result. A graph of one task is run to its end first, a larger one stops there."""
    p = replace(p or EmbeddingParams(), **overrides)
    weights = written(graph_weights(edges, p), "joint")
    ids = weights.select("i").distinct()
    start = y0 if y0 is not None else initial_layout(ids, p.d, seed=p.seed)
    kind = loop_kind(start.count(), weights.count(), p)
    if kind == "joins":
        return optimise(weights, start, p, callback, every)
    if kind == "rounds":
        for step, cost, own in rounds(weights, start, p, every if callback else None):
            if callback and step >= 0 and callback(step, own, {"iter": step, "kl": cost}):
                break
        return own
    if callback is None:
        return optimise_one_task(weights, start, p)
    seen = written(optimise_one_task(weights, start, p, every), "snapshots")
    for step, cost in seen.filter("iter >= 0").select("iter", "kl").distinct().orderBy("iter").toLocalIterator():
        own = seen.filter(F.col("iter") == step).drop("iter", "kl")
        if callback(step, own, {"iter": step, "kl": cost}):
            break
    return own


def cost_log(edges: DataFrame, p: EmbeddingParams | None = None, every: int = 50, **overrides) -> DataFrame:
    """(iter, kl) along the optimisation of a graph; iter -1 is the start."""
    p = replace(p or EmbeddingParams(), **overrides)
    weights = written(graph_weights(edges, p), "joint")
    start = initial_layout(weights.select("i").distinct(), p.d, seed=p.seed)
    n = start.count()
    kind = loop_kind(n, weights.count(), p)
    if kind == "whole":
        return optimise_one_task(weights, start, p, every).groupBy("iter").agg(F.first("kl").alias("kl"))
    if kind == "rounds":
        rows = [(step, cost) for step, cost, _ in rounds(weights, start, p, every)]
    else:
        cost = lambda y: forces.kl_cost(weights, y, repulsive_sums(y, by_size(p, n))[1]).first()["kl"]
        rows = [(-1, cost(start))]
        optimise(weights, start, p, lambda step, y, _: rows.append((step, cost(y))), every)
    return start.sparkSession.createDataFrame(rows, "iter int, kl double")


def embed_points(points: DataFrame, p: EmbeddingParams | None = None, neighbours: str = "exact", y0: DataFrame | None = None, callback=None, every: int = 50, distance: str = "euclidean", standardise: bool = False, pca: int | None = None, **overrides) -> DataFrame:
    """(i, y0, ..) of points (i, x): prepared, neighbours, perplexity, then embed_graph.

    distance: one of array_metrics', for exact neighbours; cells take euclidean, cosine (of unit vectors; a zero vector
    stays zero) and mahalanobis (of whitened ones). pca: so many components first. neighbours: exact, tree, ivf or ivfpq."""
    p = replace(p or EmbeddingParams(), **overrides)
    if standardise:
        points = preprocess.standardise(points)
    if pca:
        points = preprocess.pca(points, pca)
    if neighbours == "exact" and distance != "euclidean":
        return embed_graph(affinity.perplexity_edges(knn.metric_knn(points, p.k, distance), p.u), p, y0, callback, every)
    if distance == "cosine":
        size = F.sqrt(dot(F.col("x"), F.col("x")))
        points = points.select("i", F.transform("x", lambda v: F.when(size > 0, v / size).otherwise(0.0)).alias("x"))
    elif distance == "mahalanobis":
        points = preprocess.whiten(points)
    elif distance != "euclidean":
        raise ValueError(f"{neighbours} neighbours know no distance {distance}")
    find = {"exact": knn.exact_knn, "tree": lambda x, k: metric_tree.tree_knn(x, k, written)[0], "ivf": knn.ivf_knn, "ivfpq": knn.ivfpq_knn}[neighbours]
    return embed_graph(affinity.perplexity_edges(find(points, p.k), p.u), p, y0, callback, every)


class GradientService:
    """Holds a graph and answers for layouts: its gradient and its cost."""

    def __init__(self, edges: DataFrame, p: EmbeddingParams | None = None):
        self.edges, self.p = edges.select("i", "j", "v").persist(), p or EmbeddingParams()

    def gradient(self, y: DataFrame, alpha: float = 1.0) -> DataFrame:
        return step_gradient(self.edges, y, self.p, alpha)

    def cost(self, y: DataFrame) -> float:
        return forces.kl_cost(self.edges, y, repulsive_sums(y, self.p)[1]).first()["kl"]

    def close(self) -> None:
        self.edges.unpersist()


def twin_errors(edges: DataFrame, y: DataFrame, p: EmbeddingParams, steps: int) -> list[dict]:
    """Exact and grid repulsion side by side along one optimisation: relative errors of each step."""
    out, state = [], start_state(y)
    dims = forces.axes(y)
    for step in range(steps):
        own = state.select("i", *dims)
        error = forces.relative_error(grid.repulsion_grid(own, p.spacing, p.grid, fft=True), forces.repulsion(own)).first()
        out.append({"iter": step, "error": error["error"]})
        alpha, momentum = schedule(p, step)
        state = written(update(state, step_gradient(edges, own, p, alpha), p, momentum), "twin")
    return out
