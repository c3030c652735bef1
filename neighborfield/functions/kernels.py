"""Column expressions: distances, kernels and scalar rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from neighborfield.params import DBL_MIN, EPS, FAST_GRID_SIZES, LEAST_GRID


def total(values: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for the row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _centred(a: Column) -> Column:
    return bind(total(a) / F.size(a), lambda mean: F.transform(a, lambda v: v - mean))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def metric(name: str, a: Column, b: Column, p: float = 3.0, scale: Column | None = None) -> Column:
    """A distance by name. seuclidean needs scale, an array of standard deviations; spearman needs ranks as a and b;
    mahalanobis needs whitened vectors, for which it is euclidean."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if name == "sqeuclidean":
        return squared_l2(a, b)
    if name in ("euclidean", "mahalanobis"):
        return F.sqrt(squared_l2(a, b))
    if name == "seuclidean":
        return F.sqrt(total(F.zip_with(F.zip_with(a, b, lambda x, y: x - y), scale, lambda g, s: (g / s) * (g / s))))
    if name == "cityblock":
        return total(gaps)
    if name == "chebychev":
        return F.array_max(gaps)
    if name == "minkowski":
        return F.pow(total(F.transform(gaps, lambda g: F.pow(g, F.lit(p)))), F.lit(1 / p))
    if name == "cosine":
        return cosine_distance(a, b)
    if name in ("correlation", "spearman"):
        return bind(F.struct(_centred(a).alias("a"), _centred(b).alias("b")), lambda z: cosine_distance(z["a"], z["b"]))
    if name == "hamming":
        return _share(a, b, lambda x, y: x != y, lambda x, y: F.lit(True))
    if name == "jaccard":
        return _share(a, b, lambda x, y: x != y, lambda x, y: (x != 0) | (y != 0))
    raise ValueError(f"no metric {name}")


def _share(a: Column, b: Column, counts, among) -> Column:
    hits = total(F.zip_with(a, b, lambda x, y: F.when(among(x, y) & counts(x, y), 1.0).otherwise(0.0)))
    every = total(F.zip_with(a, b, lambda x, y: F.when(among(x, y), 1.0).otherwise(0.0)))
    return F.when(every == 0, 0.0).otherwise(hits / every)


def student(d2: Column, power: int = 1) -> Column:
    return 1 / (1 + d2) if power == 1 else 1 / ((1 + d2) * (1 + d2))


def gaussian(d2: Column, beta: Column | float) -> Column:
    return F.exp(-F.lit(beta) * d2 if isinstance(beta, (int, float)) else -beta * d2)


def entropy_term(x: Column) -> Column:
    """x ln x, 0 where that is not a number."""
    return F.when(x > 0, x * F.ln(x)).otherwise(0.0)


def to_distance(p: Column) -> Column:
    """-ln p of a probability; null where p is not above 0."""
    return F.when(p > 0, -F.ln(p))


def floor_at_realmin(x: Column) -> Column:
    return F.greatest(x, F.lit(DBL_MIN))


def grid_coordinate(y: Column, spread: Column, nodes: Column | int) -> Column:
    """y from 0 to spread as a place from 0 to below nodes - 1; 0 when nothing spreads."""
    return F.when(spread > 0, F.least(y / spread, F.lit(1 - EPS)) * (nodes - 1)).otherwise(0.0)


def grid_nodes(spread: Column, h: float) -> Column:
    """The fast grid size for a spread."""
    want = F.greatest(F.ceil(spread / h), F.lit(LEAST_GRID)) + 2
    sizes = F.array(*map(F.lit, FAST_GRID_SIZES))
    return (F.coalesce(F.get(F.filter(sizes, lambda s: s >= want), F.lit(0)), F.lit(FAST_GRID_SIZES[-1])) - 2).cast("int")


def lagrange_terms(delta):
    """Weights of the four nodes around a point that lies delta after the second, of columns or arrays; they sum to 1."""
    near = lambda x: ((0.5 * x - 1) * x - 0.5) * x + 1
    far = lambda x: ((-x / 6 + 1) * x - 11 / 6) * x + 1
    return [far(1 + delta), near(delta), near(1 - delta), far(2 - delta)]


def lagrange_weights(delta: Column) -> Column:
    return F.array(*lagrange_terms(delta))


def keys_weights(delta: Column, a: float = -0.5) -> Column:
    """Keys' cubic convolution weights, the other choice."""
    near = lambda x: ((a + 2) * x - (a + 3)) * x * x + 1
    far = lambda x: ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    return F.array(far(1 + delta), near(delta), near(1 - delta), far(2 - delta))


def box_basis(x: Column, nodes: int) -> Column:
    """Lagrange basis of `nodes` equispaced points in a box, at x from 0 to 1."""
    spots = [(2 * i + 1) / (2 * nodes) for i in range(nodes)]
    terms = [reduce(lambda s, m: s * ((x - spots[m]) / (spots[i] - spots[m])), [m for m in range(nodes) if m != i], F.lit(1.0)) for i in range(nodes)]
    return F.array(*terms)


def box_of(y: Column, low: Column, width: Column, boxes: int) -> Column:
    return F.least(F.greatest(F.floor((y - low) / width), F.lit(0)), F.lit(boxes - 1)).cast("int")


def morton(coordinates: list[Column], bits: int) -> Column:
    """Interleaved bits of non-negative integers, the first coordinate lowest."""
    n = len(coordinates)
    parts = [F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * n + m) for b in range(bits) for m, c in enumerate(coordinates)]
    return reduce(lambda s, x: s.bitwiseOR(x), parts)


def linear_index(coordinates: list[Column], size: int) -> Column:
    """Row-major number of a cell."""
    return reduce(lambda s, c: s * size + c, coordinates)
