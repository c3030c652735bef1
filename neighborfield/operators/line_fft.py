"""Convolution of vectors that no task holds, by a Fourier transform in two steps.

A vector of N = rows * columns numbers is a matrix, number n in row n div columns. Tasks that hold some columns transform
these and turn each entry by its angle; after a shuffle tasks that hold some rows transform these, multiply by the other
vector's, and go back; after another shuffle tasks that hold columns end. A task holds about the root of N times BAND numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns or rows of the matrix that a task holds.
BAND = 16
_ROWS = "band int, other int, left boolean, data binary"


def _table(rows: list[tuple]) -> pa.Table:
    kinds = {"band": pa.int32(), "other": pa.int32(), "left": pa.bool_(), "data": pa.binary()}
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def shape_of(n: int) -> tuple[int, int]:
    """Rows and columns, powers of two, for at least n numbers."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    return 1 << (bits // 2), 1 << (bits - bits // 2)


def circular_convolution(left: DataFrame, right: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """(i, x) at the places of wanted (i): sum over j of right[(i - j) mod n] * left[j], for vectors (i, x) without repeated
    places from 0 to n - 1; absent places are zeros. n is a product that shape_of gave."""
    rows, columns = shape_of(n)
    if rows * columns != n:
        raise ValueError(f"{n} is not a size of shape_of")
    bands = -(-columns // BAND)
    turn = lambda k, m: np.exp(-2j * np.pi * np.outer(k, m) / n)

    def there(part: pa.Table) -> pa.Table:
        band, own = part["band"][0].as_py(), part["left"][0].as_py()
        i = part["i"].to_numpy()
        first, width = band * BAND, min(BAND, columns - band * BAND)
        values = np.zeros((rows, width))
        values[i // columns, i % columns - first] = part["x"].to_numpy()
        done = np.fft.fft(values, axis=0) * turn(np.arange(rows), first + np.arange(width))
        return _table([(band, k, own, np.ascontiguousarray(done[k * BAND : (k + 1) * BAND]).tobytes()) for k in range(-(-rows // BAND))])

    def across(part: pa.Table) -> pa.Table:
        k = part["other"][0].as_py()
        first, height = k * BAND, min(BAND, rows - k * BAND)
        both = {True: np.zeros((height, columns), np.complex128), False: np.zeros((height, columns), np.complex128)}
        for band, own, raw in zip(part["band"].to_pylist(), part["left"].to_pylist(), part["data"], strict=True):
            both[own][:, band * BAND : (band + 1) * BAND] = np.frombuffer(raw.as_buffer(), np.complex128).reshape(height, -1)
        back = np.fft.ifft(np.fft.fft(both[True], axis=1) * np.fft.fft(both[False], axis=1), axis=1)
        back = back * turn(first + np.arange(height), np.arange(columns)).conj()
        return _table([(b, k, True, np.ascontiguousarray(back[:, b * BAND : (b + 1) * BAND]).tobytes()) for b in range(bands)])

    def back(part: pa.Table, places: pa.Table) -> pa.Table:
        i, x = places["i"].to_numpy(), np.zeros(places.num_rows)
        if part.num_rows and places.num_rows:
            band = part["band"][0].as_py()
            values = np.zeros((rows, min(BAND, columns - band * BAND)), np.complex128)
            for k, raw in zip(part["other"].to_pylist(), part["data"], strict=True):
                values[k * BAND : (k + 1) * BAND] = np.frombuffer(raw.as_buffer(), np.complex128).reshape(-1, values.shape[1])
            x = np.fft.ifft(values, axis=0).real[i // columns, i % columns - band * BAND]
        return pa.table([i, x], names=["i", "x"])

    band = F.expr(f"cast((i % {columns}) div {BAND} as int)")
    both = left.select("i", "x", F.lit(True).alias("left")).unionByName(right.select("i", "x", F.lit(False).alias("left"))).withColumn("band", band)
    spectra = both.groupBy("band", "left").applyInArrow(there, _ROWS)
    products = spectra.groupBy("other").applyInArrow(across, _ROWS)
    places = wanted.select("i", band.alias("at"))
    return products.groupBy("band").cogroup(places.groupBy("at")).applyInArrow(back, "i long, x double")
