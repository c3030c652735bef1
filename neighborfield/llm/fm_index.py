"""Removal of word windows that start earlier in the corpus, by FM-indexes over wavelet matrices.

Windows reach the shard of their anchor's hash (anchored.py), so a shard indexes only what may repeat and is searched
only by that. A shard's different contexts, earliest first, are concatenated; the Burrows-Wheeler transform of the text
is kept as a wavelet matrix of packed bits with counts by blocks of 512 bits. Of the suffix array two things stay: where the
suffixes' first size and size - 1 symbols change, and for each interval of size symbols the earliest place. The contexts are streamed
against the index from their last word to their first: a step of backward search lengthens the match by one word, and a match of
the full length is first cut to size - 1, whose interval the kept borders give. So a word costs one step, and each window's
matching statistic (capped at the window's size) comes with the earliest place of its interval. A window is removed where that place is
earlier than its own; copies of whole contexts are decided by the same comparison.

Equal contexts are written into a shard's text once, at their earliest place, and a block sends each different context once, so that
a passage with very many copies is one string of the index. A very long text is one block, whose words one task holds as a list.

A null text has no words. Rows with the same doc_id are one document's text starting at the same place: neither is
earlier. A null doc_id comes after all others. Documents with fewer words than a window keep them all. An empty table
gives no rows. All input columns come back in one column named row, so that no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neighborfield.llm.anchored import Windows, anchors, arrow, blocks_of, flagged, packed, ranges_for, repeated_anchors, rows_of, structs, unpacked, utf8_texts
from neighborfield.llm.runtime import ids_of, written

WINDOW, GRAM = 20, 6
#: Text whose anchors one index serves, about.
RANGE_TEXT_BYTES = 8 << 20
SENT = "range long, block long, contexts binary, offsets binary, docs binary, starts binary, spots binary"
FAR = np.iinfo(np.int64).max


class WaveletMatrix:
    """Symbols below 2^levels; counts of a symbol before a place, for many symbols and places at once."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.inside, self.zeros = [], [], [], []
        own = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (own >> level & 1).astype(bool)
            padded = np.zeros(-(-(len(own) + 1) // 512) * 512, np.uint8)
            padded[: len(own)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).reshape(-1, 8).cumsum(1)
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(ones[:-1, -1])]).astype(np.int32 if len(own) < 1 << 31 else np.int64))  # ones before a block of 512
            self.inside.append(np.concatenate([np.zeros((len(ones), 1), np.int64), ones[:, :-1]], 1).astype(np.int16).reshape(-1))  # and in it, before a word
            self.zeros.append(int(len(own) - bit.sum()))
            own = np.concatenate([own[~bit], own[bit]])
        self.starts = self._walk(np.arange(1 << self.levels, dtype=np.int64), np.zeros(1 << self.levels, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            word = at >> 6
            ones = self.before[i][word >> 3].astype(np.int64) + self.inside[i][word] + np.bitwise_count(self.words[i][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbols >> (self.levels - 1 - i) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._walk(symbols, at) - self.starts[symbols]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes of text sorted by at least their first depth symbols; ranks by the first `span` symbols, and that span:
    the largest power of two below depth, or less where ranks by fewer symbols already tell all suffixes apart."""
    n, rank, span = len(text), text.astype(np.int64), 1
    while True:
        ahead = np.zeros(n, np.int64)
        if span < n:
            ahead[: n - span] = rank[span:] + 1
        key = rank * (max(n, int(rank.max())) + 2) + ahead
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if 2 * span >= depth:
            return order, rank, span
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order, rank, span
        span *= 2


class FMIndex:
    """Backward search over a text of symbols >= 1; depth bounds the length of patterns. With `values`, one for each symbol,
    each interval of `depth` symbols has the least value of its places."""

    def __init__(self, text: np.ndarray, depth: int, values: np.ndarray | None = None):
        text = np.concatenate([text, [0]])
        sigma = int(text.max()) + 1
        order, rank, span = suffix_order(text, depth)
        self.size, self.depth = len(text), depth
        self.wavelet = WaveletMatrix(text[order - 1], sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        if values is not None:
            self.full, self.shorter = (self._borders(order, rank, span, n) for n in (depth, depth - 1))
            self.least = np.minimum.reduceat(np.append(values, values.max(initial=0))[order], self.full)

    def _borders(self, order: np.ndarray, rank: np.ndarray, span: int, n: int) -> np.ndarray:
        """Where the first n symbols of the ordered suffixes change."""
        change = np.zeros(self.size, bool)
        change[0] = True
        if n > 0:
            ends = np.concatenate([rank, np.full(n, -1)])
            for at in ({0, n - span} if n > span else {0}):
                own = ends[order + at]
                change[1:] |= own[1:] != own[:-1]
        return np.flatnonzero(change).astype(np.int32 if self.size < 1 << 31 else np.int64)

    def step(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns that are one symbol longer to the left."""
        ends = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]))
        return self.first[symbols] + ends[: len(symbols)], self.first[symbols] + ends[len(symbols) :]

    def search(self, patterns: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of patterns: (length of the longest suffix with at least `least` occurrences, its interval)."""
        n, size = patterns.shape
        lo, hi, length = np.zeros(n, np.int64), np.full(n, self.size, np.int64), np.zeros(n, np.int64)
        active = np.arange(n)
        for step in range(size):
            new_lo, new_hi = self.step(patterns[active, size - 1 - step].astype(np.int64), lo[active], hi[active])
            enough = new_hi - new_lo >= least
            active = active[enough]
            if not len(active):
                break
            lo[active], hi[active] = new_lo[enough], new_hi[enough]
            length[active] = step + 1
        return length, lo, hi

    def stream(self, symbols: np.ndarray, begin: np.ndarray, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Texts symbols[begin : begin + depth - 1 + windows] read from their ends: (text, window, least value) for the windows that
        occur, a window of each text at a time, the last first."""
        last = windows.astype(np.int64) - 1
        text = np.flatnonzero(last >= 0)
        at = begin + last
        length, lo, hi = self.search(symbols[at[text, None] + np.arange(self.depth)[None, :]], 1)
        for back in range(int(last.max(initial=-1)) + 1):
            whole = length == self.depth
            yield text[whole], last[text[whole]] - back, self.least[np.searchsorted(self.full, lo[whole], "right") - 1]
            own = last[text] > back
            text, length, lo, hi = text[own], length[own], lo[own], hi[own]
            # The match without its last symbol, then with the symbol before it.
            group = np.searchsorted(self.shorter, lo, "right") - 1
            whole = length == self.depth
            lo = np.where(whole, self.shorter[group], 0)
            hi = np.where(whole, np.append(self.shorter, self.size)[group + 1], self.size)
            new = at[text] - back - 1
            lo, hi = self.step(symbols[new], lo, hi)
            length = np.where(whole & (hi > lo), self.depth, 0)
            lost = np.flatnonzero(~whole)  # nothing to cut: such a window is searched anew
            if len(lost):
                length[lost], lo[lost], hi[lost] = self.search(symbols[new[lost, None] + np.arange(self.depth)[None, :]], 1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < 500_000:
            self[word] = value
        return value


_HASHES = _Hashes()


def _read(text_at: int):
    def read(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        words: list[bytes] = []
        at = [0]
        for t in utf8_texts(rows, text_at):
            words += t.split()  # bytes: ASCII white space only
            at.append(len(words))
        return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)), np.array(at), words

    return read


def _contexts(rows: pa.Table, replies: pa.Table, read, w: Windows, ids: np.ndarray, ranges: int, bits: int):
    """Places, first and last windows, (document, start) of each candidate anchor's context, its number among the
    block's contexts, and for each of those (anchor's offset, words), its earliest candidate and its range."""
    symbols, at, words = read(rows)
    place, hashes, first, last = anchors(symbols, at, w)
    flags, of = flagged(hashes, replies, ranges, bits)
    place, first, last, of = place[flags], first[flags], last[flags], of[flags]
    row = np.searchsorted(at, first, "right") - 1
    doc, start = (ids[row], first - at[row]) if len(row) else (np.zeros(0, np.int64),) * 2
    numbers: dict[tuple[int, bytes], int] = {}
    number = np.zeros(len(place), np.int64)
    for i, (s, p, e) in enumerate(zip(first.tolist(), place.tolist(), (last + w.size).tolist(), strict=True)):
        number[i] = numbers.setdefault((p - s, b" ".join(words[s:e])), len(numbers))
    by = np.lexsort((start, doc, number))
    earliest = by[np.searchsorted(number[by], np.arange(len(numbers)))] if len(numbers) else by
    return at, words, place, first, last, doc, start, number, list(numbers), earliest, of


def earliest_windows(keys: list[tuple[int, bytes]], docs: np.ndarray, starts: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For different contexts, each with its earliest place: [context, window] the number of the place where the window
    occurs first, -1 if there is no such window; the places' documents and starts."""
    order = np.lexsort((starts, docs))
    ids: dict[bytes, int] = {}
    symbols: list[int] = []
    begin = np.zeros(len(keys), np.int64)
    for i in order.tolist():
        begin[i] = len(symbols)
        symbols += [ids.setdefault(x, len(ids) + 2) for x in keys[i][1].split(b" ")]
        symbols.append(1)
    text = np.array(symbols, np.int64)
    sizes = np.diff(np.concatenate([begin[order], [len(text)]]))
    doc_at, start_at = np.repeat(docs[order], sizes), np.repeat(starts[order] - begin[order], sizes) + np.arange(len(text))
    by_place = np.lexsort((start_at, doc_at))
    new = np.concatenate([[True], (doc_at[by_place][1:] != doc_at[by_place][:-1]) | (start_at[by_place][1:] != start_at[by_place][:-1])])
    place = np.empty(len(text), np.int32 if len(text) < 1 << 31 else np.int64)
    place[by_place] = np.cumsum(new) - 1
    n_windows = np.zeros(len(keys), np.int64)
    n_windows[order] = sizes - 1 - w.size + 1
    found = np.full((len(keys), w.steps), -1, place.dtype)
    index = FMIndex(text, w.size, place)
    for lo in range(0, len(keys), 1 << 15):
        for context, window, least in index.stream(text, begin[lo : lo + (1 << 15)], n_windows[lo : lo + (1 << 15)]):
            found[lo + context, window] = least
    return found, doc_at[by_place[new]], start_at[by_place[new]]


def _resolve(w: Windows):
    def resolve(part: pa.Table) -> pa.Table:
        """For each block: places of contexts, and a bit for each offset whose window starts earlier."""
        blocks = part["block"].to_pylist()
        numbers: dict[tuple[int, bytes], int] = {}
        number = []
        for raw, offsets in zip(part["contexts"], part["offsets"], strict=True):
            for key in zip(unpacked(offsets.as_py(), "<u2").tolist(), zstandard.ZstdDecompressor().decompress(raw.as_py()).split(b"\n"), strict=True):
                number.append(numbers.setdefault(key, len(numbers)))
        keys, number = list(numbers), np.array(number)
        docs = np.concatenate([unpacked(x.as_py(), "<i8") for x in part["docs"]])
        starts = np.concatenate([unpacked(x.as_py(), "<i8") for x in part["starts"]])
        spots = [unpacked(x.as_py(), "<u4") for x in part["spots"]]
        run = np.repeat(np.arange(len(blocks)), [len(s) for s in spots])
        by = np.lexsort((starts, docs, number))
        first = by[np.searchsorted(number[by], np.arange(len(keys)))]
        offset = np.array([k[0] for k in keys])[number]
        earliest, doc_of, start_of = earliest_windows(keys, docs[first], starts[first], w)
        mask = np.zeros(len(number), np.uint64)
        for nth in range(w.steps):
            least = earliest[number, nth]
            hit = np.flatnonzero(least >= 0)
            least = least[hit]
            hit = hit[(doc_of[least] < docs[hit]) | ((doc_of[least] == docs[hit]) & (start_of[least] < starts[hit] + nth))]
            mask[hit] |= np.uint64(1) << (offset[hit] - nth).astype(np.uint64)
        rows = []
        for i, (b, s) in enumerate(zip(blocks, spots, strict=True)):
            m = mask[run == i]
            if (m > 0).any():
                rows.append((b, packed(s[m > 0]), packed(m[m > 0])))
        return arrow("block long, spots binary, masks binary", rows)

    return resolve


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_words, n_removed, spans, kept): spans are [first word, words] of each maximal removed run, kept the other words joined by one space."""
    w = Windows(window, gram)
    assert 1 <= gram <= window and w.steps <= 64
    text_at, id_at, names = docs.columns.index(text_col), docs.columns.index(id_col), docs.columns
    read = _read(text_at)
    blocks = blocks_of(docs, text_col, "word-blocks")
    ranges, bits = ranges_for(docs, RANGE_TEXT_BYTES)
    flags = repeated_anchors(blocks, read, w, ranges, bits)

    def send(block: pa.Table, replies: pa.Table) -> pa.Table:
        rows = rows_of(block["payload"][0].as_py())
        _, _, place, _, _, doc, start, number, keys, earliest, of = _contexts(rows, replies, read, w, ids_of(rows.column(id_at).combine_chunks()), ranges, bits)
        out, by = [], np.argsort(of[earliest], kind="stable")
        edges = np.flatnonzero(np.diff(of[earliest][by], prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own = by[lo:hi]
            at = earliest[own]
            text = zstandard.ZstdCompressor(level=3).compress(b"\n".join(keys[i][1] for i in own.tolist()))
            offsets = np.array([keys[i][0] for i in own.tolist()], "<u2")
            out.append((int(of[at[0]]), block["block"][0].as_py(), text, packed(offsets), packed(doc[at].astype("<i8")), packed(start[at].astype("<i8")), packed(place[at].astype("<u4"))))
        return arrow(SENT, out)

    sent = blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(send, SENT)
    masks = written(sent.groupBy("range").applyInArrow(_resolve(w), "block long, spots binary, masks binary"), "word-masks")
    none = F.lit(None)
    replies = flags.select("block", "range", "flags", none.cast("binary").alias("spots"), none.cast("binary").alias("masks")).union(masks.select("block", none.cast("long"), none.cast("binary"), "spots", "masks"))
    schema = T.StructType([T.StructField("row", structs(docs)), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.BinaryType())])

    def finish(block: pa.Table, got: pa.Table) -> pa.Table:
        rows = rows_of(block["payload"][0].as_py())
        known, found = got.filter(pc.is_valid(got["range"])), got.filter(pc.is_valid(got["spots"]))
        at, words, place, first, last, doc, start, number, keys, earliest, _ = _contexts(rows, known, read, w, ids_of(rows.column(id_at).combine_chunks()), ranges, bits)
        change = np.zeros(len(words) + 1, np.int64)
        if len(keys):
            lead = earliest[number]
            later = (doc > doc[lead]) | ((doc == doc[lead]) & (start > start[lead]))
            np.add.at(change, first[later], 1)
            np.add.at(change, last[later] + w.size, -1)
            mask_at = np.zeros(len(words) + 1, np.uint64)
            for spots, masks_of in zip(found["spots"], found["masks"], strict=True):
                np.bitwise_or.at(mask_at, unpacked(spots.as_py(), "<u4").astype(np.int64), unpacked(masks_of.as_py(), "<u8"))
            mask = mask_at[place[lead]]
            for offset in range(w.steps):
                hit = (mask >> np.uint64(offset) & np.uint64(1)).astype(bool) & ~later & (place - offset >= first) & (place - offset <= last)
                np.add.at(change, place[hit] - offset, 1)
                np.add.at(change, place[hit] - offset + w.size, -1)
        covered = np.cumsum(change)[:-1] > 0
        n_removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[at])
        kept, spans = [], []
        for lo, hi, n in zip(at[:-1].tolist(), at[1:].tolist(), n_removed.tolist(), strict=True):
            if not n:
                kept.append(b" ".join(words[lo:hi]))
                spans.append([])
                continue
            own = covered[lo:hi]
            kept.append(b" ".join(words[lo + i] for i in np.flatnonzero(~own).tolist()))
            edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            spans.append([[a, b - a] for a, b in edge.tolist()])
        row = pa.StructArray.from_arrays([c.combine_chunks() for c in rows.columns], names=names)
        return pa.table([row, pa.array(np.diff(at)), pa.array(n_removed), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], names=["row", "n_words", "n_removed", "spans", "kept"])

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema)


#: The definition for DuckDB: windows of 20 words as strings.
SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, coalesce(text, '')) AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
w AS (SELECT r, s, array_to_string(words[s + 1 : s + 20], ' ') AS w FROM (SELECT r, words, unnest(range(len(words) - 19)) AS s FROM d WHERE len(words) >= 20)),
f AS (SELECT r, s FROM (SELECT r, s, row_number() OVER (PARTITION BY w ORDER BY r, s) AS nth FROM w) WHERE nth > 1),
c AS (SELECT DISTINCT r, unnest(range(s, s + 20)) AS p FROM f),
x AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS p FROM d),
k AS (SELECT r, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE c.p IS NULL) AS kept FROM x LEFT JOIN c USING (r, p) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
