"""Kernel sums through an interpolation grid: scatter to cells, convolve cells, gather from cells.

A grid has at most 512 nodes a side whatever the number of points, so cells are a small table; points are aggregated
into it with map-side combine and never meet each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neighborfield.functions.kernels import box_basis, box_of, grid_coordinate, grid_nodes, lagrange_terms, lagrange_weights, linear_index, student
from neighborfield.operators.forces import axes, forces_from_phi, zeta_from_phi
from neighborfield.operators.linalg import kernel_product
from neighborfield.params import BOX_POINTS, EPS, box_count


def centre(y: DataFrame) -> DataFrame:
    """Coordinates less their means."""
    dims = axes(y)
    means = y.agg(*(F.avg(c).alias(f"_{c}") for c in dims))
    return y.crossJoin(F.broadcast(means)).select("i", *((F.col(c) - F.col(f"_{c}")).alias(c) for c in dims))


def shift_to_origin(y: DataFrame) -> DataFrame:
    """Coordinates less their minima; a copy, the layout itself stays."""
    dims = axes(y)
    least = y.agg(*(F.min(c).alias(f"_{c}") for c in dims))
    return y.crossJoin(F.broadcast(least)).select("i", *((F.col(c) - F.col(f"_{c}")).alias(c) for c in dims))


def placed(y: DataFrame, h: float | None = None, nodes: int | None = None) -> DataFrame:
    """y with (nodes, step, t0, ..): grid nodes a side (from spacing h, or given), their distance and the places on it."""
    dims = axes(y)
    spread = y.agg(F.max(F.greatest(*dims) if len(dims) > 1 else F.col(dims[0])).alias("_most"))
    side = F.lit(nodes) if nodes is not None else grid_nodes(F.col("_most"), h)
    spread = spread.withColumn("nodes", side.cast("int")).withColumn("step", F.col("_most") / (F.col("nodes") - 1 - EPS))
    both = y.crossJoin(F.broadcast(spread))
    return both.withColumns({f"t{c[1:]}": grid_coordinate(F.col(c), F.col("_most"), F.col("nodes")) for c in dims}).drop("_most")


def stencil(points: DataFrame, weights: Callable[[Column], Column] = lagrange_weights) -> DataFrame:
    """Each placed point's 4^d cells: (i, y0.., nodes, step, c0.., w)."""
    dims = axes(points)
    out = points
    for c in dims:
        m = c[1:]
        out = out.withColumn(f"f{m}", F.floor(f"t{m}").cast("int"))
        out = out.select("*", F.posexplode(weights(F.col(f"t{m}") - F.col(f"f{m}"))).alias(f"k{m}", f"w{m}")).withColumn(f"c{m}", F.col(f"f{m}") + F.col(f"k{m}"))
    w = F.lit(1.0)
    for c in dims:
        w = w * F.col(f"w{c[1:]}")
    return out.select("i", *dims, "nodes", "step", *(f"c{c[1:]}" for c in dims), w.alias("w"))


def scatter(stencils: DataFrame) -> DataFrame:
    """Cells (c0.., nodes, step, q0, q1..) with the charges 1 and y."""
    dims = axes(stencils)
    cells = [f"c{c[1:]}" for c in dims]
    charges = [F.sum("w").alias("q0"), *(F.sum(F.col("w") * F.col(c)).alias(f"q{m + 1}") for m, c in enumerate(dims))]
    return stencils.groupBy(*cells).agg(F.first("nodes").alias("nodes"), F.first("step").alias("step"), *charges)


def _cell_axes(cells: DataFrame) -> list[str]:
    return sorted(c for c in cells.columns if c.startswith("c") and c[1:].isdigit())


def convolve(cells: DataFrame) -> DataFrame:
    """(c0.., phi0..): sums of q^2 kernel times charge over all cells, cell by cell; the definition."""
    places, charges = _cell_axes(cells), sorted(c for c in cells.columns if c.startswith("q"))
    numbered = cells.withColumn("i", linear_index([F.col(c).cast("long") for c in places], 1024)).withColumns({f"p{c[1:]}": F.col(c) * F.col("step") for c in places})
    sums = kernel_product(numbered, lambda d2: student(d2, 2), [f"p{c[1:]}" for c in places], charges)
    return numbered.select("i", *places).join(sums, "i").select(*places, *(F.col(c).alias(f"phi{c[1:]}") for c in charges))


def _padded(grid: np.ndarray, step: float) -> np.ndarray:
    lags = (np.fft.fftfreq(2 * len(grid)) * 2 * len(grid)) * step
    kernel = np.fft.rfftn(1 / (1 + sum(np.meshgrid(*[lags * lags] * grid.ndim, indexing="ij"))) ** 2)
    size, every = [2 * len(grid)] * grid.ndim, range(grid.ndim)
    return np.fft.irfftn(np.fft.rfftn(grid, size, every) * kernel, size, every)[tuple(slice(0, n) for n in grid.shape)]


def _unpadded(grid: np.ndarray, step: float) -> np.ndarray:
    """The same sums without padding. Along an axis a Toeplitz matrix is half the sum of a circulant one and a
    skew-circulant one, which modulation makes circulant; so 2^d transforms of the grid's own size replace one of 2^d
    times its size."""
    side, d = len(grid), grid.ndim
    lag = np.arange(side) * step
    twist = np.exp(1j * np.pi * np.arange(side) / side)
    shaped = lambda v, m: v.reshape([-1 if k == m else 1 for k in range(d)])
    out = np.zeros(grid.shape)
    for skew in product((False, True), repeat=d):
        kernel = np.zeros(grid.shape)
        for wrapped in product((False, True), repeat=d):
            d2 = sum(shaped((lag - side * step * w) ** 2, m) for m, w in enumerate(wrapped))
            kernel += (-1) ** sum(s and w for s, w in zip(skew, wrapped, strict=True)) / (1 + d2) ** 2
        turn = np.ones([1] * d)
        for m, s in enumerate(skew):
            if s:
                turn = turn * shaped(twist, m)
        out += (np.fft.ifftn(np.fft.fftn(grid * turn) * np.fft.fftn(kernel * turn)) / turn).real
    return out / 2**d


def convolve_fft(cells: DataFrame, padded: bool = True) -> DataFrame:
    """The same by Fourier transforms; the grid's bounded table is one task's. padded: one transform of twice the side,
    else 2^d of the grid's own, with a 2^d-th of the memory."""
    places, charges = _cell_axes(cells), sorted(c for c in cells.columns if c.startswith("q"))
    schema = ", ".join([*(f"{c} int" for c in places), *(f"phi{c[1:]} double" for c in charges)])

    def transform(part: pa.Table) -> pa.Table:
        at = tuple(part[c].to_numpy() for c in places)
        step = part["step"][0].as_py()
        out = []
        for c in charges:
            grid = np.zeros([max(int(a.max()) for a in at) + 1] * len(places))
            grid[at] = part[c].to_numpy()
            out.append((_padded if padded else _unpadded)(grid, step)[at])
        return pa.table([*(a.astype(np.int32) for a in at), *out], names=[*places, *(f"phi{c[1:]}" for c in charges)])

    return cells.groupBy(F.lit(0).alias("whole")).applyInArrow(transform, schema)


def gather(stencils: DataFrame, potentials: DataFrame) -> DataFrame:
    """(i, y0.., phi0..): potentials interpolated back to the points."""
    dims = axes(stencils)
    cells, phis = [f"c{c[1:]}" for c in dims], sorted(c for c in potentials.columns if c.startswith("phi"))
    return stencils.join(potentials, cells).groupBy("i", *dims).agg(*(F.sum(F.col("w") * F.col(p)).alias(p) for p in phis))


def _stencils(batch: pa.RecordBatch | pa.Table, dims: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """First cell of each placed point's stencil along each axis, and its 4^d weights."""
    t = np.stack([batch[f"t{c[1:]}"].to_numpy() for c in dims], 1)
    first = np.floor(t).astype(np.int64)
    each = np.stack(lagrange_terms(t - first), 2)
    weight = np.ones((len(t), 1))
    for m in range(len(dims)):
        weight = (weight[:, :, None] * each[:, m][:, None, :]).reshape(len(t), -1)
    return first, weight


def scatter_points(points: DataFrame) -> DataFrame:
    """scatter() of placed points' stencils: a task's batch is summed into its cells before any row is made."""
    dims = axes(points)
    d = len(dims)
    places, charges = [f"c{c[1:]}" for c in dims], [f"q{m}" for m in range(d + 1)]
    shape = np.indices([4] * d).reshape(d, -1).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            first, weight = _stencils(b, dims)
            cells, own = np.unique((first[:, None, :] + shape).reshape(-1, d), axis=0, return_inverse=True)
            sums = [np.bincount(own.reshape(-1), (weight * (1 if m == 0 else b[dims[m - 1]].to_numpy()[:, None])).reshape(-1), len(cells)) for m in range(d + 1)]
            n = len(cells)
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in cells.T), pa.array(np.full(n, b["nodes"][0].as_py(), np.int32)), pa.array(np.full(n, b["step"][0].as_py())), *map(pa.array, sums)], names=[*places, "nodes", "step", *charges])

    schema = ", ".join([*(f"{c} int" for c in places), "nodes int, step double", *(f"{q} double" for q in charges)])
    cells = points.select("nodes", "step", *dims, *(f"t{c[1:]}" for c in dims)).mapInArrow(run, schema)
    return cells.groupBy(*places).agg(F.first("nodes").alias("nodes"), F.first("step").alias("step"), *(F.sum(q).alias(q) for q in charges))


def gather_points(points: DataFrame, potentials: DataFrame, edge: int = 32, most: int = 65_536) -> DataFrame:
    """gather() for placed points: points go to the block of `edge` cells a side that they lie in, cells to the at most 2^d
    blocks whose points reach them, and a task sums in the point's row. A block of more than `most` points is several chunks."""
    dims = axes(points)
    d = len(dims)
    phis = sorted(c for c in potentials.columns if c.startswith("phi"))
    block = [F.expr(f"cast(floor(t{c[1:]}) div {edge} as int)").alias(f"b{c[1:]}") for c in dims]
    names = [f"b{c[1:]}" for c in dims]
    placed_in = points.select("i", *dims, *(f"t{c[1:]}" for c in dims), *block)
    full = placed_in.groupBy(*names).agg(F.ceil(F.count("*") / most).cast("int").alias("chunks"))
    own = placed_in.join(full, names).withColumn("chunk", F.pmod(F.xxhash64("i"), F.col("chunks")).cast("int"))
    cells = potentials
    for c in dims:
        m = c[1:]
        cells = cells.withColumn(f"b{m}", F.explode(F.array_distinct(F.array(F.expr(f"cast(greatest(c{m} - 3, 0) div {edge} as int)"), F.expr(f"cast(c{m} div {edge} as int)")))))
    cells = cells.join(full.select(*names, "chunks"), names).withColumn("part", F.explode(F.expr("sequence(0, chunks - 1)"))).drop("chunks")
    cells = cells.select("part", *(F.col(n).alias(f"o{n[1:]}") for n in names), *(f"c{c[1:]}" for c in dims), *phis)
    offsets = np.indices([4] * d).reshape(d, -1).T

    def run(rows: pa.Table, grid: pa.Table) -> pa.Table:
        n = rows.num_rows
        out = np.zeros((len(phis), n))
        if n and grid.num_rows:
            corner = np.array([rows[b][0].as_py() for b in names]) * edge
            dense = np.zeros((len(phis), *[edge + 3] * d))
            at = tuple(grid[f"c{c[1:]}"].to_numpy() - k for c, k in zip(dims, corner, strict=True))
            for k, p in enumerate(phis):
                dense[k][at] = grid[p].to_numpy()
            for lo in range(0, n, 16_384):
                first, weight = _stencils(rows.slice(lo, 16_384), dims)
                place = np.moveaxis((first - corner)[:, None, :] + offsets, 2, 0)
                for k in range(len(phis)):
                    out[k, lo : lo + 16_384] = (weight * dense[k][tuple(place)]).sum(1)
        return pa.table([rows["i"], *(rows[c] for c in dims), *out], names=["i", *dims, *phis])

    schema = ", ".join(["i long", *(f"{c} double" for c in dims), *(f"{p} double" for p in phis)])
    return own.groupBy(*names, "chunk").cogroup(cells.groupBy(*(f"o{n[1:]}" for n in names), "part")).applyInArrow(run, schema)


def nuconv(y: DataFrame, h: float | None = None, nodes: int | None = None, fft: bool = False, weights: Callable[[Column], Column] = lagrange_weights, padded: bool = True) -> DataFrame:
    """(i, y0.., phi0..) of the points shifted to the origin: the fast kernel sum."""
    points = placed(shift_to_origin(y), h, nodes)
    if weights is lagrange_weights:
        cells = scatter_points(points)
        return gather_points(points, convolve_fft(cells, padded) if fft else convolve(cells))
    own = stencil(points, weights)
    cells = scatter(own)
    return gather(own, convolve_fft(cells, padded) if fft else convolve(cells))


def repulsion_grid(y: DataFrame, h: float | None = None, nodes: int | None = None, fft: bool = False) -> DataFrame:
    """Repulsive force through the grid: (i, f0, ..)."""
    phi = nuconv(y, h, nodes, fft)
    return forces_from_phi(phi, zeta_from_phi(phi))


def shifted_average(y: DataFrame, shifts: int, nodes: int) -> DataFrame:
    """Mean potentials of shifts + 1 grids of `nodes`, each moved by a further part of a cell."""
    at_origin = shift_to_origin(y)
    dims = axes(y)
    most = at_origin.agg(F.max(F.greatest(*dims) if len(dims) > 1 else F.col(dims[0])).alias("_most"))
    step = F.col("_most") / (nodes - 1)
    every = None
    for s in range(shifts + 1):
        moved = at_origin.crossJoin(F.broadcast(most)).select("i", *((F.col(c) + step * (s / (shifts + 1))).alias(c) for c in dims))
        own = stencil(placed(moved, nodes=nodes + 1))
        cells = scatter(own)
        # charges move with the points; put the potentials of y back to the unmoved ones
        phi = gather(own, convolve_fft(cells)).crossJoin(F.broadcast(most))
        phi = phi.select("i", "phi0", *((F.col(f"phi{m + 1}") - F.col("phi0") * step * (s / (shifts + 1))).alias(f"phi{m + 1}") for m in range(len(dims))))
        every = phi if every is None else every.unionByName(phi)
    names = [f"phi{m}" for m in range(len(dims) + 1)]
    return at_origin.join(every.groupBy("i").agg(*(F.avg(n).alias(n) for n in names)), "i")


def box_interpolation(y: DataFrame, boxes: int | None = None, nodes: int | None = None) -> DataFrame:
    """(i, y0.., phi0..) through equal boxes with `nodes` interpolation points a side each; up to four dimensions."""
    dims = axes(y)
    d = len(dims)
    k = nodes or BOX_POINTS[d]
    own = shift_to_origin(y)
    if boxes is None:
        boxes = box_count(max(own.agg(*(F.max(c) for c in dims)).first()), d)
    most = own.agg(F.max(F.greatest(*dims) if d > 1 else F.col(dims[0])).alias("_most")).withColumn("step", (F.col("_most") + EPS) / boxes)
    out = own.crossJoin(F.broadcast(most))
    for c in dims:
        m = c[1:]
        out = out.withColumn(f"b{m}", box_of(F.col(c), F.lit(0.0), F.col("step"), boxes))
        out = out.select("*", F.posexplode(box_basis(F.col(c) / F.col("step") - F.col(f"b{m}"), k)).alias(f"k{m}", f"w{m}")).withColumn(f"c{m}", F.col(f"b{m}") * k + F.col(f"k{m}"))
    w = F.lit(1.0)
    for c in dims:
        w = w * F.col(f"w{c[1:]}")
    # nodes are equispaced over all boxes, so that cell c stands at (c + 1/2) * step / k and gaps are those of a grid
    own = out.select("i", *dims, F.lit(boxes * k).alias("nodes"), (F.col("step") / k).alias("step"), *(f"c{c[1:]}" for c in dims), w.alias("w"))
    return gather(own, convolve_fft(scatter(own), padded=d < 3))
