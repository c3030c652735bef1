"""Python data sources that read one large binary file in parts: point files and level-5 MAT files.

    register(spark)
    spark.read.format("binary_points").load(path)                          # (i, x)
    spark.read.format("mat_points").option("variable", "train_X").load(path)   # (i, x), a row of the matrix each
    spark.read.format("mat_entries").option("variable", "A").load(path)        # (i, j, v), entries that are not zero

A partition is a range of rows (of columns, for entries), read by its bytes through pyarrow's file systems, so that no task
reads a whole file. A compressed variable of a MAT file can't be entered in the middle: it is one partition, which is
inflated as it is read. option("rows") and option("parts") bound rows and set the number of partitions.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a partition, and values of a batch.
PART_BYTES, BATCH_VALUES = 32 << 20, 1 << 20
#: Types of numbers in MAT files by their code, classes of matrices, and element codes.
KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
SPARSE, MATRIX, COMPRESSED = 5, 14, 15


def opened(path: str) -> pa.NativeFile:
    if "://" in path or path.startswith("file:"):
        system, where = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    else:
        system, where = fs.LocalFileSystem(), path
    return system.open_input_file(where)


def batch_of_rows(first: int, x: np.ndarray) -> pa.RecordBatch:
    at = pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(x), dtype=np.int64)), pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(x, np.float64).reshape(-1)))], names=["i", "x"])


class Range(InputPartition):
    """Rows or columns from first to last, last not included; None: all, in one pass."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def ranges(n: int, width_bytes: int, parts: str | None) -> list[InputPartition]:
    count = int(parts) if parts else max(1, -(-n * width_bytes // PART_BYTES))
    step = max(1, -(-n // count))
    return [Range(lo, min(n, lo + step)) for lo in range(0, n, step)] or [Range(0, 0)]


class _Source(DataSource):
    SCHEMA, READER = "i long, x array<double>", DataSourceReader

    def schema(self) -> str:
        return self.SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return self.READER(dict(self.options))


class BinaryPointsReader(DataSourceReader):
    """int n, int d, double theta, double perplexity, int dims, int iterations, then n * d doubles, little-endian."""

    HEAD = 32

    def __init__(self, options: dict):
        self.path, self.parts = options["path"], options.get("parts")
        with opened(self.path) as f:
            self.n, self.d = struct.unpack("<ii", f.read_at(8, 0))
        self.n = min(self.n, int(options.get("rows", self.n)))

    def partitions(self) -> list[InputPartition]:
        return ranges(self.n, 8 * self.d, self.parts)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH_VALUES // max(1, self.d))
        with opened(self.path) as f:
            for lo in range(partition.first, partition.last, step):
                rows = min(step, partition.last - lo)
                raw = f.read_at(8 * self.d * rows, self.HEAD + 8 * self.d * lo)
                yield batch_of_rows(lo, np.frombuffer(raw, "<f8").reshape(rows, self.d))


class BinaryPoints(_Source):
    READER = BinaryPointsReader

    @classmethod
    def name(cls) -> str:
        return "binary_points"


class _Inflated:
    """A compressed element as a file that is only read forwards."""

    def __init__(self, file: pa.NativeFile, at: int, size: int):
        self.file, self.at, self.end, self.inflate, self.ready, self.place = file, at, at + size, zlib.decompressobj(), b"", 0

    def read_at(self, n: int, place: int) -> bytes:
        if place < self.place:
            raise ValueError("a compressed variable is read forwards only")
        while self.place + len(self.ready) < place + n and self.at < self.end:
            raw = self.file.read_at(min(1 << 20, self.end - self.at), self.at)
            self.at += len(raw)
            self.ready += self.inflate.decompress(raw)
            skip = min(len(self.ready), place - self.place)
            self.ready, self.place = self.ready[skip:], self.place + skip
        skip = place - self.place
        out, self.ready, self.place = self.ready[skip : skip + n], self.ready[skip + n :], place + n
        return out


def tag(f, at: int) -> tuple[int, int, int, int]:
    """(type, bytes, where the data begins, where the next element begins)."""
    kind, size = struct.unpack("<II", f.read_at(8, at))
    if kind >> 16:  # a small element: type and size share four bytes, the data follows in the other four
        return kind & 0xFFFF, kind >> 16, at + 4, at + 8
    return kind, size, at + 8, at + 8 + (size if kind == COMPRESSED else -(-size // 8) * 8)


class Matrix:
    """Where the parts of a real, two-dimensional matrix lie: values (and indexes, if sparse) in column order."""

    def __init__(self, f, at: int, names_only: bool = False):
        _, _, body, _ = tag(f, at)
        _, _, flags, after = tag(f, body)
        self.kind = struct.unpack("<I", f.read_at(4, flags))[0]
        self.complex, self.kind = bool(self.kind & 0x800), self.kind & 0xFF
        _, size, dims, after = tag(f, after)
        self.shape = struct.unpack(f"<{size // 4}i", f.read_at(size, dims))
        # a small element's data must not be read again in a compressed stream, so names come in order
        _, size, name, after = tag_here(f, after)
        self.name = bytes(name if isinstance(name, bytes) else f.read_at(size, name)).decode()
        self.after = after

    def values(self, f) -> list[tuple[str, int, int]]:
        """(type, bytes, place) of what follows: values, or row indexes, column starts and values."""
        out, at = [], self.after
        for _ in range(3 if self.kind == SPARSE else 1):
            kind, size, place, at = tag(f, at)
            out.append((KINDS[kind], size, place))
        return out


def tag_here(f, at: int) -> tuple[int, int, bytes | int, int]:
    """tag(), with the data of a small element itself: its eight bytes are read at once."""
    raw = f.read_at(8, at)
    kind, size = struct.unpack("<II", raw)
    if kind >> 16:
        return kind & 0xFFFF, kind >> 16, raw[4 : 4 + (kind >> 16)], at + 8
    return kind, size, at + 8, at + 8 + -(-size // 8) * 8


class MatReader(DataSourceReader):
    """A variable of a level-5 MAT file."""

    def __init__(self, options: dict):
        self.path, self.parts, self.variable, self.rows = options["path"], options.get("parts"), options.get("variable"), options.get("rows")
        with opened(self.path) as f:
            if f.read_at(4, 124)[2:] != b"IM":
                raise ValueError(f"{self.path} is not a little-endian level-5 MAT file")
            at, size = 128, f.size()
            while at < size:
                kind, length, body, after = tag(f, at)
                own = _Inflated(f, body, length) if kind == COMPRESSED else f
                if kind in (MATRIX, COMPRESSED):
                    m = Matrix(own, 0 if kind == COMPRESSED else at)
                    if self.variable in (None, m.name):
                        self.packed, self.at, self.length = kind == COMPRESSED, body if kind == COMPRESSED else at, length
                        self.matrix = m
                        break
                at = after
            else:
                raise ValueError(f"{self.path} has no variable {self.variable}")
        if self.matrix.complex or len(self.matrix.shape) != 2:
            raise ValueError(f"{self.matrix.name} is not a real matrix")

    def source(self, f) -> tuple[object, Matrix]:
        """The file or the inflated variable, behind the matrix' header."""
        own = _Inflated(f, self.at, self.length) if self.packed else f
        return own, Matrix(own, 0 if self.packed else self.at)


class MatPointsReader(MatReader):
    def partitions(self) -> list[InputPartition]:
        n = self.matrix.shape[0] if self.rows is None else min(int(self.rows), self.matrix.shape[0])
        if self.matrix.kind == SPARSE:
            raise ValueError(f"{self.matrix.name} is sparse: read its entries")
        return [Range(0, n)] if self.packed else ranges(n, 8 * self.matrix.shape[1], self.parts)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        n, d = self.matrix.shape
        with opened(self.path) as f:
            own, m = self.source(f)
            ((kind, _, place),) = m.values(own)
            width = np.dtype(kind).itemsize
            if self.packed:  # forwards only: the whole variable, column by column
                x = np.stack([np.frombuffer(own.read_at(n * width, place + k * n * width), f"<{kind}") for k in range(d)], 1)
                yield batch_of_rows(0, x[: partition.last])
                return
            step = max(1, BATCH_VALUES // max(1, d))
            for lo in range(partition.first, partition.last, step):
                rows = min(step, partition.last - lo)
                columns = [np.frombuffer(own.read_at(rows * width, place + (k * n + lo) * width), f"<{kind}") for k in range(d)]
                yield batch_of_rows(lo, np.stack(columns, 1) if d else np.zeros((rows, 0)))


class MatPoints(_Source):
    READER = MatPointsReader

    @classmethod
    def name(cls) -> str:
        return "mat_points"


class MatEntriesReader(MatReader):
    def partitions(self) -> list[InputPartition]:
        n = self.matrix.shape[1]
        return [Range(0, n)] if self.packed else ranges(n, 8 * self.matrix.shape[0] if self.matrix.kind != SPARSE else 64, self.parts)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows = self.matrix.shape[0]
        with opened(self.path) as f:
            own, m = self.source(f)
            if m.kind != SPARSE:
                ((kind, _, place),) = m.values(own)
                width = np.dtype(kind).itemsize
                for j in range(partition.first, partition.last):
                    column = np.frombuffer(own.read_at(rows * width, place + j * rows * width), f"<{kind}").astype(np.float64)
                    i = np.flatnonzero(column)
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.full(len(i), j)), pa.array(column[i])], names=["i", "j", "v"])
                return
            if self.packed:
                i, at, v = (np.frombuffer(own.read_at(size, place), f"<{kind}") for kind, size, place in self.in_order(own, m))
                yield from self.columns(0, i, at, v)
                return
            (ki, _, pi), (kj, _, pj), (kv, _, pv) = m.values(own)
            at = np.frombuffer(own.read_at(4 * (partition.last - partition.first + 1), pj + 4 * partition.first), f"<{kj}")
            a, z, w = int(at[0]), int(at[-1]), np.dtype(kv).itemsize
            yield from self.columns(partition.first, np.frombuffer(own.read_at(4 * (z - a), pi + 4 * a), f"<{ki}"), at - a, np.frombuffer(own.read_at(w * (z - a), pv + w * a), f"<{kv}"))

    @staticmethod
    def in_order(f, m: Matrix) -> Iterator[tuple[str, int, int]]:
        """As values(), each element when those before it have been read."""
        at = m.after
        for _ in range(3):
            kind, size, place, at = tag(f, at)
            yield KINDS[kind], size, place

    @staticmethod
    def columns(first: int, i: np.ndarray, at: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        j = np.repeat(np.arange(first, first + len(at) - 1), np.diff(at))
        yield pa.RecordBatch.from_arrays([pa.array(i[: len(j)].astype(np.int64)), pa.array(j), pa.array(v[: len(j)].astype(np.float64))], names=["i", "j", "v"])


class MatEntries(_Source):
    SCHEMA, READER = "i long, j long, v double", MatEntriesReader

    @classmethod
    def name(cls) -> str:
        return "mat_entries"


def register(spark: SparkSession) -> None:
    for source in (BinaryPoints, MatPoints, MatEntries):
        spark.dataSource.register(source)
