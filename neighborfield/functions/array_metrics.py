"""Distances between the rows of two arrays, by name: what kernels.metric is for columns, for blocks of points in a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gaps = a[:, None, :] - b[None]
    return np.sqrt(np.einsum("ijm,ijm->ij", gaps, gaps))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One less the cosine; a zero vector is at 1 from all."""
    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
    return 1 - unit(a) @ unit(b).T


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return cosine(a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True))


def cityblock(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a[:, None, :] - b[None]).sum(2)


def chebychev(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a[:, None, :] - b[None]).max(2)


def minkowski(a: np.ndarray, b: np.ndarray, p: float = 3.0) -> np.ndarray:
    return (np.abs(a[:, None, :] - b[None]) ** p).sum(2) ** (1 / p)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, None, :] != b[None]).mean(2)


def jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the components that are not zero in both, the share that differ; 0 where there are none."""
    among = (a[:, None, :] != 0) | (b[None] != 0)
    return (among & (a[:, None, :] != b[None])).sum(2) / np.maximum(among.sum(2), 1)


MEASURES: dict[str, Measure] = {f.__name__: f for f in (euclidean, cosine, correlation, cityblock, chebychev, minkowski, hamming, jaccard)}
#: Those that are another of points which are prepared first.
PREPARED = {"seuclidean": "euclidean", "mahalanobis": "euclidean", "spearman": "correlation"}


class Pairs:
    """A distance for the two uses of all pairs: near() says of a tile which pairs may be within a limit (it never rules out
    one that is) and squared() is the exact square for pairs of rows; tile() is the distance for a whole tile. All take what
    prepare() makes of points, near() also ready() of a block."""

    def prepare(self, x: np.ndarray) -> np.ndarray:
        return x

    def ready(self, b: np.ndarray):
        return b

    def near(self, a: np.ndarray, ready, limit: np.ndarray) -> np.ndarray:
        return ~(self.tile(a, ready) > (limit * (1 + 1e-9) + 1e-12)[:, None])

    def squared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def tile(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        raise NotImplementedError


def _along(terms: np.ndarray) -> np.ndarray:
    """Sums of rows, one component after the other as SQL sums a list."""
    return np.add.reduce(np.ascontiguousarray(terms.T), axis=0)


#: Components up to which squares and their sums are far from what floats hold at most, and squares that they hold at least.
MODERATE, LEAST_FLOAT = 1e15, 1e-35


def _moderate(x: np.ndarray) -> bool:
    return float(np.abs(x).max(initial=0)) <= MODERATE


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


class Euclidean(Pairs):
    def squared(self, a, b):
        gap = a - b
        gap *= gap
        return _along(gap)

    def ready(self, b):
        lengths = _lengths(b)
        return b, np.concatenate([b, lengths[:, None]], 1).astype(np.float32).T if _moderate(b) else None, lengths.max(initial=0)

    def near(self, a, ready, limit):
        """From products in floats where components allow it, in doubles otherwise, less what rounding can add to them."""
        b, columns, most = ready
        kind = np.float32 if columns is not None and _moderate(a) else np.float64
        if kind is np.float64:
            columns = np.concatenate([b, _lengths(b)[:, None]], 1).T
        own = _lengths(a)
        rounding = 4 * (a.shape[1] + 8) * float(np.finfo(kind).eps) * (own + most) + LEAST_FLOAT
        bound = (limit * limit * (1 + 1e-12) - own + rounding).astype(kind)
        lengths = np.concatenate([-2 * a, np.ones((len(a), 1))], 1).astype(kind) @ columns
        return ~(lengths > np.nextafter(bound, kind(np.inf))[:, None])

    def tile(self, a, b):
        size_a, size_b = (a * a).sum(1), (b * b).sum(1)
        d2 = a @ (-2 * b.T)
        d2 += size_a[:, None]
        d2 += size_b
        r, c = np.nonzero(~(d2 > 1e-6 * (size_a[:, None] + size_b.max(initial=0))))  # products cancel: near ones from gaps
        for lo in range(0, len(r), 1 << 16):
            at = r[lo : lo + (1 << 16)], c[lo : lo + (1 << 16)]
            d2[at] = self.squared(a[at[0]], b[at[1]])
        return np.sqrt(d2, out=d2)


EUCLIDEAN = Euclidean()


class Sharing(Euclidean):
    """Points whose last components are `tables` hashes: those that share none are infinitely far from each other."""

    def __init__(self, tables: int):
        self.tables = tables

    def ready(self, b):
        return super().ready(b[:, : -self.tables])

    def near(self, a, ready, limit):
        return super().near(a[:, : -self.tables], ready, limit)

    def squared(self, a, b):
        t = self.tables
        return np.where((a[:, -t:] == b[:, -t:]).any(1), super().squared(a[:, :-t], b[:, :-t]), np.inf)


class Cosine(Pairs):
    """zero: what a zero vector becomes, so what distance it has from all."""

    def __init__(self, centred: bool = False, zero: float = 1.0):
        self.centred, self.zero = centred, zero

    def prepare(self, x):
        if self.centred:
            x = x - x.mean(1, keepdims=True)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            return x / np.where(size > 0, size, self.zero)

    def squared(self, a, b):
        return (1 - _along(a * b)) ** 2

    def tile(self, a, b):
        d = a @ b.T
        return np.subtract(1, d, out=d)


#: Elements of a tile that is summed component by component, and of one of small integers.
CACHED, CACHED_CODES = 1 << 14, 1 << 16
#: Standard deviations to both sides that codes tell apart; what is farther has the last code, which only brings it nearer.
TOLD_APART = 4.0


class Components(Pairs):
    """Distances summed (or the most) over components, a component of a tile at a time. Limits are compared in small
    integers (codes) or by products first, in floats otherwise, all widened by more than their rounding.

    Codes are rounded, so they differ by up to one more than components do in steps of the codes."""

    def __init__(self, term: str):
        self.term = term

    def _size(self, x: np.ndarray) -> np.ndarray:
        x = np.abs(x)
        return {"sum": lambda: x.sum(1), "most": lambda: x.max(1, initial=0), "cubes": lambda: (x**3).sum(1) ** (1 / 3)}[self.term]()

    def _add(self, out: np.ndarray, a: np.ndarray, columns: np.ndarray, dims: range) -> None:
        """The terms of some components onto what is in out, a few rows at a time so that they stay in the cache."""
        rows = max(1, CACHED // columns.shape[1])
        for lo in range(0, len(a), rows):
            part, own = out[lo : lo + rows], a[lo : lo + rows]
            gap, cube = np.empty_like(part), np.empty_like(part)
            for m in dims:
                np.subtract(own[:, m, None], columns[m], out=gap)
                np.abs(gap, out=gap)
                if self.term == "most":
                    np.maximum(part, gap, out=part)
                    continue
                if self.term == "cubes":
                    np.multiply(gap, gap, out=cube)
                    np.multiply(gap, cube, out=gap)
                part += gap

    def ready(self, b):
        if self.term != "cubes":
            return b, self._codes(b)
        with np.errstate(over="ignore"):
            return b, (EUCLIDEAN.ready(b), b.astype(np.float32), self._size(b).max(initial=0))

    def _codes(self, b: np.ndarray) -> tuple | None:
        """Least value, step, greatest code and codes by component, where components are such that codes tell them apart."""
        most = 127 if self.term == "most" else min(32767, 65535 // max(1, b.shape[1]))
        with np.errstate(over="ignore", invalid="ignore"):
            mean, spread = (float(b.mean()), float(b.std())) if b.size else (0.0, 0.0)
        if most < 64 or not (np.isfinite(spread) and spread > max(1e-6 * abs(mean), 1e-150)):
            return None
        known = mean - TOLD_APART * spread, 2 * TOLD_APART * spread / most, most
        return *known, np.ascontiguousarray(self._coded(b, *known).T)

    def _coded(self, x: np.ndarray, low: float, step: float, most: int) -> np.ndarray:
        return np.rint((np.clip(x, low, low + step * most) - low) / step).astype(np.uint8 if self.term == "most" else np.int16)

    def near(self, a, ready, limit):
        b, known = ready
        if self.term == "cubes":
            return self._near_cubes(a, b, known, limit)
        if known is None:
            return self._near_in_floats(a, b, limit)
        return self._near_most(a, known, limit) if self.term == "most" else self._near_sum(a, known, limit)

    def _near_cubes(self, a: np.ndarray, b: np.ndarray, known: tuple, limit: np.ndarray) -> np.ndarray:
        """Of a given sum of cubes, squares are the largest where all components are equal; what they leave is summed in floats."""
        products, points, size = known
        near = EUCLIDEAN.near(a, products, limit * a.shape[1] ** (1 / 6) * (1 + 1e-9))
        if np.count_nonzero(near) * 8 >= near.size:
            return self._near_in_floats(a, b, limit)
        r, c = np.divmod(np.flatnonzero(near), near.shape[1])
        with np.errstate(over="ignore", invalid="ignore"):
            wide = (((limit + 1e-5 * (self._size(a) + size)) * (1 + 1e-5)) ** 3 * (1 + 1e-4)).astype(np.float32)
            own = a.astype(np.float32)
            for lo in range(0, len(r), 1 << 10):
                rows, columns = r[lo : lo + (1 << 10)], c[lo : lo + (1 << 10)]
                gap = own.take(rows, 0)
                gap -= points.take(columns, 0)
                np.abs(gap, out=gap)
                near[rows, columns] = ~(np.einsum("ij,ij,ij->i", gap, gap, gap) > wide[rows])
        return near

    def _near_sum(self, a: np.ndarray, known: tuple, limit: np.ndarray) -> np.ndarray:
        """Sums of differences of codes stay below 65,536."""
        low, step, most, columns = known
        own = self._coded(a, low, step, most)
        wide = np.minimum(limit / step * (1 + 1e-9) + a.shape[1] + 1, 65535).astype(np.uint16)
        near = np.empty((len(a), columns.shape[1]), bool)
        rows = max(1, CACHED_CODES // columns.shape[1])
        both, one = np.empty((min(rows, len(a)), columns.shape[1]), np.uint16), np.empty((min(rows, len(a)), columns.shape[1]), np.int16)
        for lo in range(0, len(a), rows):
            part = own[lo : lo + rows]
            total, gap = both[: len(part)], one[: len(part)]
            total.fill(0)
            for m in range(a.shape[1]):
                np.subtract(part[:, m, None], columns[m], out=gap)
                np.abs(gap, out=gap)
                total += gap.view(np.uint16)
            np.less_equal(total, wide[lo : lo + rows, None], out=near[lo : lo + rows])
        return near

    def _near_most(self, a: np.ndarray, known: tuple, limit: np.ndarray) -> np.ndarray:
        """Codes are at most 127, so a difference and the limit, in bytes, are beyond twice the limit where the difference is beyond it."""
        low, step, most, columns = known
        wide = np.minimum(limit / step * (1 + 1e-9) + 1 + 1e-6, 127).astype(np.uint8)
        own = self._coded(a, low, step, most) + wide[:, None]
        near = np.empty((len(a), columns.shape[1]), bool)
        rows = max(1, CACHED_CODES // columns.shape[1])
        both, one = np.empty((2, min(rows, len(a)), columns.shape[1]), np.uint8)
        for lo in range(0, len(a), rows):
            part, twice = own[lo : lo + rows], 2 * wide[lo : lo + rows, None]
            total, gap = both[: len(part)], one[: len(part)]
            total.fill(0)
            for m in range(a.shape[1]):
                np.subtract(part[:, m, None], columns[m], out=gap)
                np.maximum(total, gap, out=total)
                if m % 16 == 15 and np.count_nonzero(total <= twice) * 1024 < total.size:
                    break  # those that are left are few enough to be looked at one by one
            np.less_equal(total, twice, out=near[lo : lo + rows])
        return near

    def _near_in_floats(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            columns, size = np.ascontiguousarray(b.T.astype(np.float32)), self._size(b).max(initial=0)
        wide = (limit + 1e-5 * (self._size(a) + size)) * (1 + 1e-5)
        with np.errstate(over="ignore", invalid="ignore"):
            wide = wide**3 * (1 + 1e-4) if self.term == "cubes" else wide
            out, a = np.zeros((len(a), columns.shape[1]), np.float32), a.astype(np.float32)
            for lo in range(0, a.shape[1], 16):
                self._add(out, a, columns, range(lo, min(lo + 16, a.shape[1])))
                near = ~(out > wide[:, None].astype(np.float32))
                if np.count_nonzero(near) * 64 < near.size:
                    break  # terms only add: those that are left are few enough to be looked at one by one
            return near

    def squared(self, a, b):
        gap = np.abs(a - b)
        return (gap.max(1, initial=0) if self.term == "most" else _along(gap) if self.term == "sum" else _along(gap * gap * gap) ** (1 / 3)) ** 2

    def tile(self, a, b):
        d = np.zeros((len(a), len(b)))
        self._add(d, a, np.ascontiguousarray(b.T), range(a.shape[1]))
        return np.cbrt(d, out=d) if self.term == "cubes" else d


class Unequal(Pairs):
    """The share of components that differ, of all or (among) of those that are not zero in both."""

    def __init__(self, among: bool):
        self.among = among

    def squared(self, a, b):
        differ = (a != b).sum(1)
        return (differ / (np.maximum(((a != 0) | (b != 0)).sum(1), 1) if self.among else max(1, a.shape[1]))) ** 2

    def tile(self, a, b):
        values, codes = np.unique(np.concatenate([a, b]), return_inverse=True, equal_nan=False)
        codes = codes.reshape(-1, a.shape[1]).astype(np.uint8 if len(values) <= 256 else np.uint32)
        own, columns = codes[: len(a)], np.ascontiguousarray(codes[len(a) :].T)
        kind = np.uint8 if a.shape[1] < 256 else np.uint32
        differ, one = np.zeros((len(a), len(b)), kind), np.empty((len(a), len(b)), bool)
        for m in range(a.shape[1]):
            np.not_equal(own[:, m, None], columns[m], out=one)
            differ += one.view(np.uint8)
        if not self.among:
            return differ / max(1, a.shape[1])
        # where components differ one of them isn't zero
        return differ / np.maximum(a.shape[1] - ((a == 0).astype(np.float32) @ (b == 0).astype(np.float32).T).astype(float), 1)


PAIRS: dict[str, Pairs] = {"euclidean": EUCLIDEAN, "cosine": Cosine(), "correlation": Cosine(True), "cityblock": Components("sum"), "chebychev": Components("most"), "minkowski": Components("cubes"), "hamming": Unequal(False), "jaccard": Unequal(True)}
