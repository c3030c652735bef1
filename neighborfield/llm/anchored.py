"""Exchange of repeated windows through anchors: what substring and suffix-array removal share.

Every window of a document has an anchor: the leftmost of its grams with the smallest hash. Equal windows have equal
anchors at equal offsets, so windows whose anchor gram occurs once in the corpus cannot repeat. The steps:

1. Documents are packed into compressed blocks of a few MB, a table in the shared folder.
2. Each block sends the sorted hashes of its anchors, cut to as many bits as the corpus needs; the task of a hash range
   tells each block which of them other blocks or other places have. A cut hash only lets more anchors through.
3. Each block sends, for those anchors, the symbols around the anchor that its windows cover (a context), each
   different context once, with the earliest place of it; later places of it in the block are known to repeat.
4. The task of a hash range decides for each context and each of its windows whether an earlier place has it.
5. Each block marks what is covered.

Only step 3's contexts and one copy of the blocks for steps 3 and 5 are shuffled. Blocks, not documents or groups of
copies, are what one task holds. A context that very many places share arrives once from each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neighborfield.llm.runtime import input_bytes, releasing, texts_of, written

BLOCK_BYTES = 6 << 20
#: Hashes that a task compares, about, and context bytes that a task resolves.
RANGE_TEXT_BYTES = 16 << 20
#: Symbols that are hashed at a time; small enough for a processor's cache.
SEGMENT = 1 << 16


@dataclass(frozen=True)
class Windows:
    """size: symbols of a window. gram: symbols of an anchor's gram, at most size."""

    size: int
    gram: int

    @property
    def steps(self) -> int:
        return self.size - self.gram + 1


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * np.uint64(0x9E3779B97F4A7C15)
    out += b
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Hash of symbols[i:i+gram] for each i (symbols are uint64 hashes of single symbols)."""
    n = len(symbols) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, span, power = None, 0, 1, symbols
    while True:
        if gram & span:
            piece = power[have : have + n]
            out = piece if out is None else mixed(out, piece)
            have += span
        if 2 * span > gram:
            return out
        power = mixed(power[:-span], power[span:])
        span *= 2


def byte_gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """The same for bytes and grams of eight or more: the words that start at each byte, times a constant each."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    out = np.zeros(n, np.uint64)
    for k, first in enumerate([*range(0, gram - 8, 8), gram - 8]):
        out += words[first : first + n] * np.uint64(0x9E3779B97F4A7C15 + 0x632BE59BD9B4E01A * k & (1 << 64) - 1)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


def anchors(symbols: np.ndarray, at: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window, last window) of each anchor; documents are symbols[at[i]:at[i+1]]."""
    found: list[tuple] = []
    n = len(symbols)
    for lo in range(0, max(0, n - w.size + 1), SEGMENT):
        hi = min(n, lo + SEGMENT + w.size - 1)
        h = (byte_gram_hashes if symbols.dtype == np.uint8 else gram_hashes)(symbols[lo:hi], w.gram)
        key = (h & ~np.uint64(2 * SEGMENT - 1)) | np.arange(len(h), dtype=np.uint64)
        least, span = key, 1
        while 2 * span <= w.steps:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        if span < w.steps:
            least = np.minimum(least[: len(least) - (w.steps - span)], least[w.steps - span :])
        place = (least & np.uint64(2 * SEGMENT - 1)).astype(np.int64)
        start = np.arange(lo, lo + len(place))
        doc = np.searchsorted(at, start, "right") - 1
        inside = start + w.size <= at[doc + 1]
        start, place = start[inside], place[inside]
        if len(start):
            new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
            found.append((place[new] + lo, h[place[new]], start[new], start[np.concatenate([new[1:], [len(start)]]) - 1]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    # An anchor that a segment's edge cuts is there twice, with windows of its own each time. An anchor's hash is the
    # least of many, so it is mixed once more: the ranges that hashes are dealt by then get equal shares.
    place, hashes, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    return place, mixed(hashes, np.full(len(hashes), 0x2545F4914F6CDD1D, np.uint64)), first, last


def ranges_for(docs: DataFrame, text_bytes: int = RANGE_TEXT_BYTES) -> tuple[int, int]:
    """(hash ranges, hash bits) for an input of this size; a range has the anchors of about text_bytes of text."""
    size = input_bytes(docs)
    ranges = max(12, min(1 << 20, 2 * size // text_bytes + 1))
    return ranges, min(62, max(40, (2 * size).bit_length() + 11))


def blocks_of(docs: DataFrame, text_col: str, name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, payload): payload is a compressed Arrow stream of whole rows, columns renamed c0, c1, ..."""
    columns = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = 0, [], 0
        part = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(whole)
            return pa.RecordBatch.from_arrays([pa.array([part + number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < b.num_rows:
                room = np.searchsorted(np.cumsum(sizes[at:]), block_bytes - size, "right") + 1
                held.append(b.slice(at, room))
                size += int(sizes[at : at + room].sum())
                at += int(room)
                if size >= block_bytes:
                    yield block()
                    number, held, size = number + 1, [], 0
        if held:
            yield block()

    return written(columns.mapInArrow(releasing(run), "block long, payload binary"), name)


def rows_of(payload: bytes) -> pa.Table:
    with pa.ipc.open_stream(payload) as stream:
        return stream.read_all().combine_chunks()


def packed(values: np.ndarray) -> bytes:
    """Compressed bytes of an integer array, planes of equal significance together."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(kind)


def deltas(values: np.ndarray) -> bytes:
    """Ascending non-negative integers."""
    return packed(np.diff(values.astype(np.int64), prepend=0))


def from_deltas(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, "<i8"))


def arrow(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.table({name: pa.array(list(c), kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


#: What a block's rows become: (symbol hashes, document starts, a function (first, last, place) -> context).
Reader = Callable[[pa.Table], tuple[np.ndarray, np.ndarray, object]]


def repeated_anchors(blocks: DataFrame, read: Reader, w: Windows, ranges: int, bits: int) -> DataFrame:
    """(block, range, flags): for each block and range, which of its sorted distinct anchor hashes occur twice or more."""
    keep = np.uint64(64 - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, payload in zip(b["block"].to_pylist(), b["payload"], strict=True):
                symbols, at, _ = read(rows_of(payload.as_py()))
                h, n = np.unique(anchors(symbols, at, w)[1] >> keep, return_counts=True)
                cuts = np.searchsorted(h, range_edges(ranges, bits))
                rows = [(i, block, deltas(h[lo:hi]), np.packbits(n[lo:hi] > 1).tobytes()) for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
                yield from arrow("range long, block long, hashes binary, own binary", rows).to_batches()

    def compare(part: pa.Table) -> pa.Table:
        block, each = part["block"].to_pylist(), [from_deltas(x.as_py()) for x in part["hashes"]]
        own = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[: len(e)].astype(bool) for x, e in zip(part["own"], each, strict=True)]
        every = np.sort(np.concatenate(each))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        number = part["range"][0].as_py()
        rows = []
        for b, e, o in zip(block, each, own, strict=True):
            spot = np.searchsorted(twice, e)
            hit = o | ((spot < len(twice)) & (twice[np.minimum(spot, len(twice) - 1)] == e) if len(twice) else False)
            rows.append((b, number, np.packbits(hit).tobytes()))
        return arrow("block long, range long, flags binary", rows)

    sent = blocks.mapInArrow(releasing(send), "range long, block long, hashes binary, own binary")
    return written(sent.groupBy("range").applyInArrow(releasing(compare), "block long, range long, flags binary"), "flags")


def range_edges(ranges: int, bits: int) -> np.ndarray:
    return np.array([(i << bits) // ranges for i in range(ranges)] + [(1 << bits) - 1 if bits == 64 else 1 << bits], np.uint64)


def flagged(hashes: np.ndarray, replies: pa.Table, ranges: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor: does its hash occur again; its range."""
    cut = hashes >> np.uint64(64 - bits)
    distinct, back = np.unique(cut, return_inverse=True)
    edges = np.searchsorted(distinct, range_edges(ranges, bits))
    flags = np.zeros(len(distinct), bool)
    for number, raw in zip(replies["range"].to_pylist(), replies["flags"], strict=True):
        lo, hi = edges[number], edges[number + 1]
        flags[lo:hi] = np.unpackbits(np.frombuffer(raw.as_py(), np.uint8))[: hi - lo]
    of = np.searchsorted(edges, np.arange(len(distinct)), "right") - 1
    return flags[back], of[back]


def structs(docs: DataFrame) -> T.StructType:
    """The input's row as one column, so that no result column can clash with it."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])


def utf8_texts(rows: pa.Table, text_at: int) -> list[bytes]:
    return [x.encode() for x in texts_of(rows.column(text_at))]
