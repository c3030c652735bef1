"""Sums of a kernel over all points for several charges at once, with kernels of any degree of freedom.

Points carry charges q0, q1, ...; boxes with `nodes` interpolation points a side take them, one transform of the kernel
serves all charges, and the potentials are interpolated back. Grids of two and more dimensions are transformed in blocks
of pencils, one of a single dimension is one pencil.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborfield.functions.kernels import box_basis, box_of
from neighborfield.operators.forces import axes
from neighborfield.operators.grid import shift_to_origin
from neighborfield.operators.pencils import Kernel, convolve_pencils
from neighborfield.params import EPS


def student_kernel(freedom: float = 1.0, power: float = 1.0) -> Kernel:
    """(1 + d2 / freedom)^(-power * (freedom + 1) / 2): power 1 is the density's shape, 2 its square."""
    return lambda d2: (1 + d2 / freedom) ** (-power * (freedom + 1) / 2)


def charges_of(points: DataFrame) -> list[str]:
    return sorted(c for c in points.columns if c.startswith("q") and c[1:].isdigit())


def _line(cells: DataFrame, charges: list[str], kernel: Kernel) -> DataFrame:
    """The one-dimensional grid: its only pencil in a task; as many rows as there are nodes."""

    def run(part: pa.Table) -> pa.Table:
        at, step = part["c0"].to_numpy(), part["step"][0].as_py()
        side = int(at.max()) + 1
        lag = np.minimum(np.arange(2 * side), 2 * side - np.arange(2 * side)) * step
        spectrum = np.fft.rfft(kernel(lag * lag))
        out = []
        for c in charges:
            values = np.zeros(2 * side)
            values[at] = part[c].to_numpy()
            out.append(np.fft.irfft(np.fft.rfft(values) * spectrum, 2 * side)[at])
        return pa.table([at.astype(np.int32), *out], names=["c0", *(f"phi{c[1:]}" for c in charges)])

    return cells.groupBy(F.lit(0).alias("pencil")).applyInArrow(run, ", ".join(["c0 int", *(f"phi{c[1:]} double" for c in charges)]))


def nbody(points: DataFrame, kernel: Kernel, boxes: int, nodes: int, edge: int | None = None) -> DataFrame:
    """(i, phi0, ..) of points (i, y0.., q0..): for each charge the sum over all points, the own one included, of the
    kernel of the squared distance times the charge."""
    dims, charges = axes(points), charges_of(points)
    own = shift_to_origin(points.select("i", *dims)).join(points.select("i", *charges), "i")
    most = own.agg(F.max(F.greatest(*dims) if len(dims) > 1 else F.col(dims[0])).alias("_most")).withColumn("box", (F.col("_most") + EPS) / boxes)
    out = own.crossJoin(F.broadcast(most))
    for c in dims:
        m = c[1:]
        out = out.withColumn(f"b{m}", box_of(F.col(c), F.lit(0.0), F.col("box"), boxes))
        out = out.select("*", F.posexplode(box_basis(F.col(c) / F.col("box") - F.col(f"b{m}"), nodes)).alias(f"k{m}", f"w{m}")).withColumn(f"c{m}", (F.col(f"b{m}") * nodes + F.col(f"k{m}")).cast("int"))
    w = F.lit(1.0)
    for c in dims:
        w = w * F.col(f"w{c[1:]}")
    places = [f"c{c[1:]}" for c in dims]
    own = out.select("i", *charges, (F.col("box") / nodes).alias("step"), *places, w.alias("w"))
    cells = own.groupBy(*places).agg(F.first("step").alias("step"), *(F.sum(F.col("w") * F.col(q)).alias(q) for q in charges))
    potentials = convolve_pencils(cells, kernel, edge) if len(dims) > 1 else _line(cells, charges, kernel)
    phis = [f"phi{q[1:]}" for q in charges]
    return own.join(potentials, places).groupBy("i").agg(*(F.sum(F.col("w") * F.col(p)).alias(p) for p in phis))
