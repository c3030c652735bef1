"""Packing of token sequences into windows by non-negative least squares over length combinations.

A document longer than the window is cut at multiples of it; the histogram of the remaining lengths has at most one
entry for each length, so it fits the driver at any input size. Shallow combinations of lengths that fill a window are
columns of a matrix; how often to use each is the non-negative least-squares solution against the histogram, rounded
down. What is left is packed greedily (longest first, then the longest that still fits), again on the histogram.
Pieces find their place by their rank among the pieces of their length; ranks come from counts for each
(length, block), so that a length that a third of all pieces have is dealt over many tasks.

Nulls: a null text is empty; its document is the end id alone. A null doc_id stays null. Repeated rows are documents
of their own. A very long text is one row, of which a task holds the ids. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neighborfield.llm.runtime import Remembered, documents, laid_out, places, releasing, slices, texts_of, written

WINDOW = 4096
CACHED_CHARS = 64
#: A special token of the tokenizer: chunks with it between them are encoded in one call, each as if alone.
MARK = "<|startoftext|>"
#: Kinds of Latin-1 characters: L letters and digits, P full stop and comma, a space, Q all others.
KINDS = bytes(ord("P") if c in ".," else ord(" ") if c == " " else ord("L") if unicodedata.category(c)[0] in "LN" else ord("Q") for c in map(chr, range(256)))
CACHE_ENTRIES = 400_000


#: Texts of so many bytes are tokenised together.
TOGETHER_BYTES = 8 << 20
#: Texts on which a tokenizer must give the same ids by chunks as in one call; else it is called for whole texts.
PROBES = ("The Cat. And, the dog's 12 ÉTÉ straße\tX\ny  z", "a.b c., d ,e (f). G! h... 3.5, 7", "naïve Ünïcode «quoted». 日本 語. x")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """(tokenizer, remembered chunks; None where chunks can't be told apart in this tokenizer)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    plain = [np.array(x.ids, np.int32) for x in tokenizer.encode_batch_fast(list(PROBES), add_special_tokens=False)]
    if tokenizer.token_to_id(MARK) is None:
        return tokenizer, None
    found, at = _by_chunks(list(PROBES), tokenizer, Remembered(CACHE_ENTRIES))
    return tokenizer, Remembered(CACHE_ENTRIES) if all(np.array_equal(x, found[a:b]) for x, a, b in zip(plain, at[:-1], at[1:], strict=True)) else None


def alike(text: str) -> str:
    """A text with the same ids whose chunks repeat more: one kind of space and, where all characters are Latin-1,
    small letters and full stops and commas apart from the word before them.

    The tokenizer lower-cases and drops spaces itself. A stop after another sign is one match with it, so texts with
    such a pair are left alone, and texts that might hold a special token keep their capitals."""
    text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
    try:
        kinds = text.encode("latin-1").translate(KINDS)
    except UnicodeEncodeError:
        return text
    if MARK[:2] in text or b"QP " in kinds or b"PP " in kinds:
        return text
    return text.lower().replace(". ", " . ").replace(", ", " , ")


def _by_chunks(texts: list[str], tokenizer, remembered: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """All ids and where each text's start. Texts are cut at spaces, tabs and line ends, which no match crosses; each
    different chunk is looked up once, and those that the cache lacks are encoded together."""
    chunks, numbers, at = places([alike(t) for t in texts], " ")
    fresh = remembered.missing(chunks)
    cache = remembered.new
    together, word = [], tokenizer.model.tokenize
    for chunk in fresh:
        if chunk.isascii() and chunk.isalpha() and chunk.islower():  # one pre-token that no step before the merges alters
            cache[chunk] = array("I", [t.id for t in word(chunk)]).tobytes()
        elif MARK[:2] in chunk:
            cache[chunk] = array("I", tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        else:
            together.append(chunk)
    mark = tokenizer.token_to_id(MARK)
    for lo in range(0, len(together), 512):
        part = together[lo : lo + 512]
        ids = np.array(tokenizer.encode_batch_fast([MARK.join(part)], add_special_tokens=False)[0].ids, "<u4")
        raw, cuts = ids.tobytes(), (np.flatnonzero(ids == mark) * 4).tolist()
        cache.update(zip(part, (raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)], strict=True)), strict=True))
    out = laid_out(list(map(cache.__getitem__, chunks)), numbers, at)
    remembered.forget(fresh, CACHED_CHARS)
    return out


def token_ids(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, by the tokenizer without its special tokens added, and where each text's start."""
    tokenizer, remembered = _tokenizer(path)
    if remembered is not None:
        return _by_chunks(texts, tokenizer, remembered)
    each = [np.array(x.ids, np.int32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return np.concatenate([np.zeros(0, np.int32), *each]), np.cumsum([0, *map(len, each)])


def cut(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces: (doc_id, start, length, ids_crc32, doc_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", TOGETHER_BYTES):
            ids, at = token_ids(texts_of(b["text"]), path)
            raw = memoryview(np.insert(ids, at[1:], end_id).astype("<u4", copy=False)).cast("B")
            at = at + np.arange(len(at))
            n = np.diff(at)
            pieces = -(-n // window)
            doc = np.repeat(np.arange(len(n)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            length = np.minimum(window, n[doc] - start)
            first = 4 * (at[:-1][doc] + start)
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

        if (remembered := _tokenizer(path)[1]) is not None:
            remembered.clear()  # a worker lives on after its task

    return documents(docs, id_col, text_col).mapInArrow(releasing(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(lengths: np.ndarray, window: int, per_length: int = 12, slack: int = 0) -> list[tuple[int, ...]]:
    """Up to per_length combinations of two to five lengths around each length; sums lie within slack below the window."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    known = sorted(int(x) for x in lengths)
    #: floor_of[x]: the longest length up to x, or 0.
    floor_of = np.maximum.accumulate(np.where(have, np.arange(window + 1), 0))
    found: dict[tuple[int, ...], None] = {}
    for a in known:
        rest = window - a
        if rest and (b := int(floor_of[rest])) and rest - b <= slack:
            found[tuple(sorted((a, b)))] = None
        for depth in (2, 3, 4):
            share = rest // depth
            near = np.searchsorted(lengths, share)
            for b in lengths[max(0, near - per_length // 2) : near + per_length // 2]:
                left = rest - (depth - 1) * int(b)
                if left > 0 and (c := int(floor_of[left])) and left - c <= slack:
                    found[tuple(sorted((a, *[int(b)] * (depth - 1), c)))] = None
    return list(found)


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, steps: int = 300) -> np.ndarray:
    """x >= 0 that brings sum(x_c * column_c) near target: accelerated projected gradient on the sparse columns."""
    at = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    row = np.array([x for c in columns for x in c])
    apply = lambda x: np.bincount(row, weights=x[at], minlength=len(target))
    back = lambda r: np.bincount(at, weights=r[row], minlength=len(columns))
    v = np.ones(len(columns))
    for _ in range(30):
        v = back(apply(v))
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(apply(y) - target) / (1.05 * norm))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def greedy(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) that use up counts: longest first, each next the longest that fits. Repeats are taken at once."""
    counts, out = counts.copy(), []
    while True:
        left = np.flatnonzero(counts)
        if not len(left):
            return out
        room, slots, used = window, [], defaultdict(int)
        for length in left[::-1]:
            fit = min(int(counts[length]), room // int(length))
            if fit:
                slots += [int(length)] * fit
                used[int(length)] = fit
                room -= fit * int(length)
        times = min(int(counts[k]) // v for k, v in used.items())
        for k, v in used.items():
            counts[k] -= times * v
        out.append((tuple(slots), times))


def plan(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) that use each length exactly counts[length] times."""
    left = counts.copy()
    out = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    lengths = np.flatnonzero(left)
    columns = combinations(lengths, window)
    if columns:
        times = np.floor(nnls(columns, left.astype(float)) + 1e-6).astype(np.int64)
        for c in np.argsort(-times, kind="stable"):
            if not times[c]:
                break
            need = np.unique(columns[c], return_counts=True)
            n = min(int(times[c]), int((left[need[0]] // need[1]).min()))
            if n > 0:
                left[need[0]] -= n * need[1]
                out.append((columns[c], n))
    return out + greedy(left, window)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, first sequence, offset), by rank."""
    used: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            out[length].append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(pieces: DataFrame, window: int = WINDOW, rows_per_block: int = 20_000) -> DataFrame:
    """pieces with sequence_id and offset. pieces has a column length from 1 to window; the rest passes through."""
    pieces = written(pieces, "pieces")
    histogram = pieces.groupBy("length").count().collect()  # at most window rows
    counts = np.zeros(window + 1, np.int64)
    for length, n in histogram:
        counts[length] = n
    places = slots(plan(counts, window))
    blocks = int(counts.sum()) // rows_per_block + 8
    names = pieces.columns
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)))
    sizes = dealt.groupBy("length", "_block").count()
    before = sizes.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_block", F.coalesce("_before", F.lit(0)).alias("_before"))
    inner = Window.partitionBy("length", "_block").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(inner) - 1).join(before, ["length", "_block"]).select(*names, (F.col("_rank") + F.col("_before")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b["length"].to_numpy(zero_copy_only=False), b["_rank"].to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                of = length == one
                table = places[int(one)]
                at = np.searchsorted(table[:, 0], rank[of], "right") - 1
                sequence[of], offset[of] = table[at, 1] + rank[of] - table[at, 0], table[at, 2]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(cut(docs, path, end_id, window, id_col, text_col), window)
