"""What the text operators share: the shared folder, written tables and Arrow views of texts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from inspect import isgeneratorfunction, signature

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch between the JVM and Python: both hold it several times, and 10,000 texts can be very long.
BATCH_BYTES = 8 << 20
#: Order of rows without an id: after all others.
NULL_ID = (1 << 63) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset (tests, one machine), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here and a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives back what a worker has freed: workers live on after a task, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # only glibc has it
        trim(0)


def releasing(run: Callable) -> Callable:
    """run, a function of a task's batches or of one or two tables of a group, with release() after it."""
    if isgeneratorfunction(run):

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from run(batches)
            finally:
                release()

        return each

    def one(a: pa.Table) -> pa.Table:
        try:
            return run(a)
        finally:
            release()

    def two(a: pa.Table, b: pa.Table) -> pa.Table:
        try:
            return run(a, b)
        finally:
            release()

    return two if len(signature(run).parameters) == 2 else one


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), so that no other column's name can clash; a null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids of any integer type for comparisons; null counts as the largest."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, and where each text starts (one entry more than texts)."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def places(texts: list[str], mark: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at mark: the different chunks, the number of the one at each place, and where each text's places start."""
    cut = pc.split_pattern(pa.array(texts, pa.string()), mark)
    coded = cut.values.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), cut.offsets.to_numpy()


class Remembered:
    """What chunks gave, for the last `entries` chunks or more: two halves, of which the older is dropped when the newer
    is full, so that chunks that keep coming stay."""

    def __init__(self, entries: int):
        self.most, self.new, self.old = entries // 2, {}, {}

    def missing(self, chunks: list[str]) -> list[str]:
        """Those chunks that aren't here; the others count as new again."""
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, []
        for c in chunks:
            if c not in new:
                if (known := old.get(c)) is None:
                    out.append(c)
                else:
                    new[c] = known
        return out

    def clear(self) -> None:
        self.new, self.old = {}, {}

    def forget(self, chunks: list[str], longer: int) -> None:
        for c in chunks:
            if len(c) > longer:
                del self.new[c]


def laid_out(parts: list[bytes], numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """parts[k] for each k of numbers, one after the other, as 32-bit ids; and where each text starts among them."""
    values = np.frombuffer(b"".join(parts), np.int32)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    starts = np.cumsum(sizes) - sizes
    ends = np.concatenate([[0], np.cumsum(sizes[numbers])])
    out = np.empty(ends[-1], np.int32)
    for lo in range(0, len(numbers), 1 << 18):  # places at a time: memory stays bounded in a long text
        own = numbers[lo : lo + (1 << 18)]
        n = sizes[own]
        a, b = ends[lo], ends[lo + len(own)]
        out[a:b] = values[np.repeat(starts[own] + a - ends[lo : lo + len(own)], n) + np.arange(b - a)]
    return out, ends[at]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut to about `most` bytes of a column each (a single longer text stays whole)."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield b.slice(at, to - at)
            at, done = to, int(ends[to - 1])


#: Keys with more than this part of all rows count as hot.
HOT_SHARE = 1000


def looked_up(rows: DataFrame, lookup: DataFrame, key: list[str], count: str, total: int) -> DataFrame:
    """rows joined with lookup, which has one row for each key and in `count` how many of `total` rows have the key.

    Keys of more than a thousandth of all rows are fewer than a thousand for each column that takes part with `total`
    rows, so they are broadcast; the others meet in a shuffle, where none is hot. Both tables are read twice."""
    hot = F.col(count) * HOT_SHARE > total
    near = rows.join(F.broadcast(lookup.filter(hot)), key)
    far = rows.join(F.broadcast(lookup.filter(hot).select(*key)), key, "left_anti").join(lookup.filter(~hot), key)
    return near.unionByName(far)


def input_bytes(df: DataFrame) -> int:
    """Bytes that the optimizer expects; decides how many parts there are, never which rows count."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
