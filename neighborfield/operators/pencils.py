"""Convolution on grids that no task holds: Fourier transforms axis by axis over blocks of pencils.

A grid is rows (channel, block of each axis, values); a block has `edge` indices of each axis. A step groups the blocks
that differ in one axis only, so that a task has whole pencils along it, transforms them, and cuts the result into blocks
again: the shuffle to the next step's grouping is the transpose. Axis 0 is transformed first (of real numbers, so half is
enough), the last axis is transformed, multiplied by the kernel's transform and transformed back in one step, then the
other axes follow in reverse. The kernel is one more channel of the same steps, made in the tasks. 2d - 1 shuffles in all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborfield.operators.grid import _cell_axes, gather_points, placed, scatter_points, shift_to_origin

#: Bytes of the pencils that a task holds at once, about.
PENCIL_BYTES = 32 << 20
Kernel = Callable[[np.ndarray], np.ndarray]


def student2(d2: np.ndarray) -> np.ndarray:
    """The squared Student kernel of squared distances."""
    return 1 / (1 + d2) ** 2


class _Grid:
    """Sizes of a convolution: `side` nodes an axis, padded to twice that, in blocks of `edge`."""

    def __init__(self, side: int, step: float, d: int, charges: int, edge: int | None):
        self.side, self.step, self.d, self.charges = side, step, d, charges
        room = PENCIL_BYTES / (32 * side * (charges + 1))
        self.edge = edge or max(1, min(side, int(room ** (1 / max(1, d - 1)))))
        self.schema = ", ".join(["channel int", *(f"b{m} int" for m in range(d)), "data binary"])
        self.names = ["channel", *(f"b{m}" for m in range(d)), "data"]

    def length(self, axis: int, done: int, kernel: bool) -> int:
        """Of an axis when axes below `done` are transformed."""
        if axis < done:
            return self.side + 1 if axis == 0 else 2 * self.side
        return 2 * self.side if kernel else self.side

    def sizes(self, blocks: list[int], done: int, kernel: bool, whole: int) -> list[int]:
        """Shape of a block, or of its pencils along `whole`."""
        lengths = [self.length(m, done, kernel) for m in range(self.d)]
        return [n if m == whole else min(self.edge, n - b * self.edge) for m, (n, b) in enumerate(zip(lengths, blocks, strict=True))]

    def cut(self, channel: int, blocks: list[int], axis: int, values: np.ndarray) -> Iterator[tuple]:
        """Pencils as rows of blocks along the axis."""
        for b in range(-(-values.shape[axis] // self.edge)):
            own = [*blocks]
            own[axis] = b
            part = np.take(values, range(b * self.edge, min((b + 1) * self.edge, values.shape[axis])), axis)
            yield (channel, *own, np.ascontiguousarray(part, np.complex128).tobytes())

    def table(self, rows: list[tuple]) -> pa.Table:
        kinds = [pa.int32()] * (self.d + 1) + [pa.binary()]
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=self.names)

    def pencils(self, part: pa.Table, axis: int, done: int) -> tuple[list[int], dict[int, np.ndarray]]:
        """(blocks, {channel: pencils along the axis}) of a group; blocks that are not there are zeros."""
        out: dict[int, np.ndarray] = {}
        columns = [part[f"b{m}"].to_pylist() for m in range(self.d)]
        for channel, blocks, raw in zip(part["channel"].to_pylist(), zip(*columns, strict=True), part["data"], strict=True):
            kernel = channel < 0
            if channel not in out:
                out[channel] = np.zeros(self.sizes(list(blocks), done, kernel, axis), np.complex128)
            own = np.frombuffer(raw.as_buffer(), np.complex128).reshape(self.sizes(list(blocks), done, kernel, -1))
            place = [slice(None)] * self.d
            place[axis] = slice(blocks[axis] * self.edge, blocks[axis] * self.edge + own.shape[axis])
            out[channel][tuple(place)] = own
        return [c[0] for c in columns], out


def _others(g: _Grid, axis: int) -> list[str]:
    return [f"b{m}" for m in range(g.d) if m != axis]


def _charges_first(g: _Grid, cells: DataFrame, places: list[str], charges: list[str]) -> DataFrame:
    """The first axis' transform of the charges, from cells."""

    def run(part: pa.Table) -> pa.Table:
        at = np.stack([part[c].to_numpy() for c in places])
        blocks = [0, *(int(part[f"b{m}"][0].as_py()) for m in range(1, g.d))]
        local = at - np.array([b * g.edge for b in blocks])[:, None]
        rows = []
        for k, c in enumerate(charges):
            values = np.zeros(g.sizes(blocks, 0, False, 0))
            values[tuple(local)] = part[c].to_numpy()
            rows += g.cut(k, blocks, 0, np.fft.rfft(values, 2 * g.side, axis=0))
        return g.table(rows)

    dealt = cells.withColumns({f"b{m}": F.expr(f"cast({c} div {g.edge} as int)") for m, c in enumerate(places) if m})
    return dealt.groupBy(*_others(g, 0)).applyInArrow(run, g.schema)


def _kernel_first(g: _Grid, cells: DataFrame, kernel: Kernel) -> DataFrame:
    """The first axis' transform of the kernel on the padded grid: each task makes the pencils of its numbers."""
    blocks = -(-2 * g.side // g.edge)
    lag = np.minimum(np.arange(2 * g.side), 2 * g.side - np.arange(2 * g.side)) * g.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch["id"].to_pylist():
                own = [0]
                for _ in range(g.d - 1):
                    own.append(n % blocks)
                    n //= blocks
                d2 = (lag * lag).reshape(-1, *[1] * (g.d - 1))
                for m in range(1, g.d):
                    part = lag[own[m] * g.edge : (own[m] + 1) * g.edge]
                    d2 = d2 + (part * part).reshape([-1 if k == m else 1 for k in range(g.d)])
                yield from g.table(list(g.cut(-1, own, 0, np.fft.rfft(kernel(d2), axis=0)))).to_batches()

    numbers = cells.sparkSession.range(blocks ** (g.d - 1))
    return numbers.mapInArrow(run, g.schema)


def _forward(g: _Grid, rows: DataFrame, axis: int) -> DataFrame:
    def run(part: pa.Table) -> pa.Table:
        blocks, values = g.pencils(part, axis, axis)
        return g.table([r for c, v in values.items() for r in g.cut(c, blocks, axis, np.fft.fft(v, 2 * g.side, axis=axis))])

    return rows.groupBy("channel", *_others(g, axis)).applyInArrow(run, g.schema)


def _multiplied(g: _Grid, rows: DataFrame) -> DataFrame:
    """The last axis there, times the kernel, and back."""
    axis = g.d - 1

    def run(part: pa.Table) -> pa.Table:
        blocks, values = g.pencils(part, axis, axis)
        kernel = np.fft.fft(values.pop(-1), 2 * g.side, axis=axis)
        done = []
        for c, v in values.items():
            back = np.fft.ifft(np.fft.fft(v, 2 * g.side, axis=axis) * kernel, axis=axis)
            done += g.cut(c, blocks, axis, np.take(back, range(g.side), axis))
        return g.table(done)

    return rows.groupBy(*_others(g, axis)).applyInArrow(run, g.schema)


def _back(g: _Grid, rows: DataFrame, axis: int) -> DataFrame:
    def run(part: pa.Table) -> pa.Table:
        blocks, values = g.pencils(part, axis, axis + 1)
        return g.table([r for c, v in values.items() for r in g.cut(c, blocks, axis, np.take(np.fft.ifft(v, axis=axis), range(g.side), axis))])

    return rows.groupBy("channel", *_others(g, axis)).applyInArrow(run, g.schema)


def _at_cells(g: _Grid, rows: DataFrame, cells: DataFrame, places: list[str], phis: list[str]) -> DataFrame:
    """The first axis back, read at the cells."""

    def run(part: pa.Table, own: pa.Table) -> pa.Table:
        at = [own[c].to_numpy() for c in places]
        out = np.zeros((g.charges, own.num_rows))
        if part.num_rows and own.num_rows:
            blocks, values = g.pencils(part, 0, 1)
            local = tuple(a - (b * g.edge if m else 0) for m, (a, b) in enumerate(zip(at, blocks, strict=True)))
            for c, v in values.items():
                out[c] = np.fft.irfft(v, 2 * g.side, axis=0)[: g.side][local]
        return pa.table([*(a.astype(np.int32) for a in at), *out], names=[*places, *phis])

    dealt = cells.select(*places, *(F.expr(f"cast({c} div {g.edge} as int)").alias(f"o{m}") for m, c in enumerate(places) if m))
    schema = ", ".join([*(f"{c} int" for c in places), *(f"{p} double" for p in phis)])
    return rows.groupBy(*_others(g, 0)).cogroup(dealt.groupBy(*(f"o{m}" for m in range(1, g.d)))).applyInArrow(run, schema)


def convolve_pencils(cells: DataFrame, kernel: Kernel = student2, edge: int | None = None) -> DataFrame:
    """(c0.., phi0..) of cells (c0.., step, q0..): sums of kernel(squared distance) * charge over all cells, for grids of two
    or more dimensions and any size. cells are read twice. edge: indices of a block along an axis, by PENCIL_BYTES unless
    given; a task holds 2 * side * edge^(d-1) values of each channel at most."""
    places, charges = _cell_axes(cells), sorted(c for c in cells.columns if c.startswith("q"))
    if len(places) < 2:
        raise ValueError("one dimension is one pencil: use convolve_fft")
    phis = [f"phi{c[1:]}" for c in charges]
    size = cells.agg((F.max(F.greatest(*places)) + 1).alias("side"), F.first("step").alias("step")).first()
    if size.side is None:
        return cells.select(*places, *(F.lit(0.0).alias(p) for p in phis))
    g = _Grid(size.side, size.step, len(places), len(charges), edge)
    rows = _charges_first(g, cells, places, charges).unionByName(_kernel_first(g, cells, kernel))
    for axis in range(1, g.d - 1):
        rows = _forward(g, rows, axis)
    rows = _multiplied(g, rows)
    for axis in range(g.d - 2, 0, -1):
        rows = _back(g, rows, axis)
    return _at_cells(g, rows, cells, places, phis)


def nuconv_pencils(y: DataFrame, h: float | None = None, nodes: int | None = None, edge: int | None = None) -> DataFrame:
    """(i, y0.., phi0..): the grid's fast kernel sum for grids beyond a task."""
    points = placed(shift_to_origin(y), h, nodes)
    return gather_points(points, convolve_pencils(scatter_points(points), edge=edge))
