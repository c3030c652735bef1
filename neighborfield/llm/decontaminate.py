"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and benchmark items are lower-cased (A-Z only) and cut into words of digits, letters a-z and characters beyond
ASCII. A test string is a window of `size` consecutive words of an item (an item of fewer words is one window), written
with one space before, between and after its words. A document is written alike, so that a test string stands in it
exactly where the window's words stand.

Test strings are dealt into classes by length (16 to 31 bytes, 32 to 63, ...), each with tables of its own, so that a
short item does not shorten the steps of all. A class looks at the first m bytes of its strings, m its shortest length: a shift table
says for the block of bytes that ends at a place how far the search may move on; where it says zero, the block's value
and that of the string's beginning select a bucket, and the bucket's strings are compared with the text. A batch is
searched from many places at once, each of which owns a stretch of the text.

Documents are read once for each shard of test strings and are never shuffled. A shard has about SHARD_BYTES of items;
a longer item is cut into pieces that overlap by size - 1 words. Only one shard at a time is on the driver and in tasks.
Beyond one shard, documents are written between two passes.

Nulls: a null text has no words (in an item: no window). A null item_id's windows count as hits, but name no item. Items
with one id are one item. Repeated rows and null doc_ids are rows like others. A very long text is one row; about ten
times its size is held beside it. Empty tables give no rows, or no hits. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborfield.llm.runtime import documents, releasing, slices, small_batches, utf8, written

SIZE = 10
#: Bytes of a block of the shift tables, bytes of a string that they look at, and bytes of text that one place owns.
BLOCK, HEAD, STRETCH = 8, 256, 512
#: Bytes of items whose windows are searched for at once, words of a piece of an item, bytes of text searched at once.
SHARD_BYTES, PIECE_WORDS, TEXT_BYTES = 1 << 21, 20_000, 4 << 20
SPACE, BARRIER = 32, 10
#: What a byte becomes: small letters, digits and bytes beyond ASCII stay, capitals become small, others are gaps.
WRITTEN = np.array([b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else SPACE for b in range(256)], np.uint8)


def normal(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as words between single spaces, one after the other behind a barrier each; where words begin in this; and
    the number of each text's first word (one entry more than texts)."""
    data, at = utf8(column)
    marks = np.tile(np.array([SPACE, BARRIER, SPACE], np.uint8), len(at) - 1)
    spaced = np.append(np.insert(WRITTEN[data], np.repeat(at[:-1], 3), marks), np.uint8(SPACE))
    gap = spaced == SPACE
    out = spaced[~(gap & np.concatenate([[False], gap[:-1]]))]
    first = np.flatnonzero((out[1:] != SPACE) & (out[1:] != BARRIER) & (out[:-1] == SPACE)) + 1
    return out, first, np.append(np.searchsorted(first, np.flatnonzero(out == BARRIER)), len(first))


def values_at(data: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """The `size` bytes up to each place as a number."""
    out = np.zeros(len(ends), np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | data[ends - (size - 1 - k)].astype(np.uint64)
    return out


class StringClass:
    """Test strings of like lengths: a shift table, buckets, and the strings."""

    def __init__(self, strings: dict[bytes, int]):
        self.strings = strings
        self.m = min(HEAD, min(map(len, strings)))
        self.block = min(BLOCK, self.m)
        heads = np.frombuffer(b"".join(s[: self.m] for s in strings), np.uint8)
        begins = np.arange(len(strings)) * self.m
        steps = self.m - self.block + 1
        self.bits = int(np.clip(np.ceil(np.log2(8 * len(strings) * steps)), 12, 22))
        self.shift = np.full(1 << self.bits, steps, np.int32)
        for j in range(self.block - 1, self.m):  # later blocks allow smaller steps and overwrite
            self.shift[self.slot(values_at(heads, begins + j, self.block))] = self.m - 1 - j
        keys = self.bucket(heads, begins + self.m - 1)
        self.keys, own = np.unique(keys, return_inverse=True)
        lengths: list[set[int]] = [set() for _ in self.keys]
        for k, s in zip(own.tolist(), strings, strict=True):
            lengths[k].add(len(s))
        self.lengths = [tuple(x) for x in lengths]

    def slot(self, value: np.ndarray) -> np.ndarray:
        return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def bucket(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A number from the block that ends there and the one that the string begins with."""
        return values_at(data, ends, self.block) * np.uint64(0xC2B2AE3D27D4EB4F) ^ values_at(data, ends - self.m + self.block, self.block)

    def ends(self, data: np.ndarray) -> np.ndarray:
        """Places where the shift table says zero: all places at which a string's first m bytes may end."""
        at = np.arange(0, max(0, len(data) - self.m + 1), STRETCH)
        stop = np.minimum(at + STRETCH, len(data) - self.m + 1) + self.m - 1
        at, out = at + self.m - 1, []
        while len(at):
            step = self.shift[self.slot(values_at(data, at, self.block))]
            out.append(at[step == 0])
            at = at + np.maximum(step, 1)
            open_ = at < stop
            at, stop = at[open_], stop[open_]
        return np.concatenate(out) if out else at

    def search(self, data: np.ndarray, raw: bytes) -> Iterator[tuple[int, int]]:
        """(start, number of the string) for each occurrence."""
        ends = self.ends(data)
        if not len(ends):
            return
        key = self.bucket(data, ends)
        near = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[near] == key
        for start, k in zip((ends[hit] - self.m + 1).tolist(), near[hit].tolist(), strict=True):
            for length in self.lengths[k]:
                number = self.strings.get(raw[start : start + length])
                if number is not None:
                    yield start, number


class Matcher:
    """The test strings of a shard: classes by length, each string's number of words and the items that hold it."""

    def __init__(self, pieces: pa.Table, size: int):
        numbers: dict[bytes, int] = {}
        words: list[int] = []
        items: list[dict[str, None]] = []
        for item, raw in zip(pieces["item"].to_pylist(), pieces["piece"].to_pylist(), strict=True):
            gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == SPACE).tolist()
            n = min(size, len(gaps) - 1)
            for a, b in zip(gaps, gaps[n:], strict=False):
                s = raw[a : b + 1]
                k = numbers.setdefault(s, len(numbers))
                if k == len(words):
                    words.append(n)
                    items.append({})
                if item is not None:
                    items[k][item] = None
        self.words = np.array(words, np.int64)
        self.names = sorted({i for x in items for i in x})
        place = {name: k for k, name in enumerate(self.names)}
        self.items = np.array([place[i] for x in items for i in x], np.int64)
        self.items_at = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)
        by_length: dict[int, dict[bytes, int]] = {}
        for s, k in numbers.items():
            by_length.setdefault(len(s).bit_length(), {})[s] = k
        self.classes = [StringClass(x) for x in by_length.values()]

    def occurrences(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        found = np.array([x for c in self.classes for x in c.search(data, raw)], np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def items_of(self, text: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different pairs (text, item) of occurrences."""
        pairs = np.unique(np.stack([text, number], 1), axis=0)
        n = np.diff(self.items_at)[pairs[:, 1]]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.stack([np.repeat(pairs[:, 0], n), self.items[np.repeat(self.items_at[:-1][pairs[:, 1]], n) + within]], 1)
        both = np.unique(both, axis=0)
        return both[:, 0], both[:, 1]


def pieces_of(size: int):
    """Items as pieces of normal text; each window of an item lies in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", TEXT_BYTES):
            data, first, at = normal(b["text"])
            raw, items, pieces = data.tobytes(), [], []
            ends = np.append(first[1:], len(raw))
            for item, lo, hi in zip(b["item"].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                step = PIECE_WORDS - size + 1
                for a in range(lo, max(lo + 1, hi - size + 1), step) if hi > lo else ():
                    z = min(hi, a + PIECE_WORDS)
                    last = raw.find(b" ", int(first[z - 1]), int(ends[z - 1]) + 1)
                    items.append(item)
                    pieces.append(raw[first[a] - 1 : last + 1])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(pieces, pa.binary())], names=["item", "piece"])

    return releasing(run)


def one_pass(matcher: Matcher | None, keep_text: bool):
    """doc_id, text, n_words, n_hit, spans (first word, last word, ...), items; what earlier passes found stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", TEXT_BYTES):
            data, first, at = normal(b["text"])
            starts, number = matcher.occurrences(data) if matcher else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            change = np.zeros(len(first) + 1, np.int64)
            word = np.searchsorted(first, starts + 1)
            np.add.at(change, word, 1)
            np.add.at(change, word + (matcher.words[number] if matcher else 0), -1)
            before = b["spans"]
            n_before = before.value_lengths().to_numpy(zero_copy_only=False) // 2
            known = before.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2) + np.repeat(at[:-1], n_before)[:, None]
            np.add.at(change, known[:, 0], 1)
            np.add.at(change, known[:, 1] + 1, -1)
            hit = np.cumsum(change)[:-1] > 0
            n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[at])
            opens, closes = hit & ~np.concatenate([[False], hit[:-1]]), hit & ~np.concatenate([hit[1:], [False]])
            heads = at[:-1][at[:-1] < at[1:]]
            opens[heads] |= hit[heads]
            tails = at[1:][at[:-1] < at[1:]] - 1
            closes[tails] |= hit[tails]
            a, z = np.flatnonzero(opens), np.flatnonzero(closes)
            span_at = np.searchsorted(a, at)
            own = np.searchsorted(at, a, "right") - 1
            spans = np.stack([a - at[own], z - at[own]], 1).reshape(-1)
            items = b["items"].to_pylist()
            if len(starts):
                texts, names = matcher.items_of(np.searchsorted(at, word, "right") - 1, number)
                for t, k in zip(texts.tolist(), names.tolist(), strict=True):
                    items[t].append(matcher.names[k])
            columns = [b["doc_id"], *([b["text"]] if keep_text else []), np.diff(at), n_hit, pa.ListArray.from_arrays(pa.array((2 * span_at).astype(np.int32)), pa.array(spans.astype(np.int64))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(["text"] if keep_text else []), "n_words", "n_hit", "spans", "items"])

    return releasing(run)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) for each row: spans are (first, last) words inside occurrences, items the
    ids as strings, in order, of the items whose windows occur."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("text"))
    pieces = written(items.mapInArrow(pieces_of(size), "item string, piece binary"), "benchmark-pieces")
    total = pieces.agg(F.coalesce(F.sum(F.length("piece")), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    rows = documents(docs, id_col, text_col).select("doc_id", "text", F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for k in range(shards):
        shard = pieces.filter(F.pmod(F.xxhash64("item", "piece"), F.lit(shards)) == k).toArrow()
        last = k == shards - 1
        kinds = "doc_id long, text string, n_words long, n_hit long, spans array<bigint>, items array<string>"
        rows = rows.mapInArrow(one_pass(Matcher(shard, size) if shard.num_rows else None, not last), kinds.replace("text string, ", "") if last else kinds)
        if not last:
            rows = written(rows, "contamination").drop("n_words", "n_hit")
    spans = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1), lambda k: F.struct(F.get("spans", 2 * k).alias("first"), F.get("spans", 2 * k + 1).alias("last")))
    empty = F.array().cast("array<struct<first:bigint,last:bigint>>")
    return rows.select("doc_id", "n_words", "n_hit", F.when(F.size("spans") > 0, spans).otherwise(empty).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


SQL = r"""
WITH i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(words[s + 1 : s + n], ' ') AS w
      FROM (SELECT item_id, words, least(10, len(words)) AS n, unnest(range(len(words) - least(10, len(words)) + 1)) AS s FROM i WHERE len(words) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
p AS (SELECT r, words, n, unnest(range(len(words) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM g) WHERE len(words) >= n),
o AS (SELECT r, s, n, item_id FROM (SELECT r, s, n, array_to_string(words[s + 1 : s + n], ' ') AS w FROM p) JOIN g USING (n, w)),
h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS place FROM o) GROUP BY r),
x AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM o WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN x USING (r)
"""
