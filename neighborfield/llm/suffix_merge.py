"""Removal of byte strings that start in an earlier document, by a distributed merge of sorted suffix runs.

Suffixes start at the anchors of anchored.py. Within a block they are sorted and front-coded: each is sent as the
length of the prefix it shares with its predecessor and the bytes after it. The task of a hash range merges the runs of
all blocks with a loser tree that keeps, for each head, the prefix it shares with the last suffix put out: heads with
different shared lengths are ordered without looking at bytes, and equal ones are compared from that length on only.
The merged order and its shared prefixes give, for every window of every suffix, the smallest document that has it.

What it is not: suffixes between anchors are neither sorted nor sent, since a window is decided at its anchor; runs are
dealt to ranges by the anchor's hash, not by leading bytes; and copies of a whole context within one block go as one
suffix. A text longer than a block is a block of its own, whose bytes one task holds about ten times.

A document without text, or with fewer bytes than a window, loses nothing. Rows with equal doc_id do not remove each
other's bytes; a null doc_id comes after all others. Removal is judged on the input. An empty table gives no rows.
All input columns come back in one column named row, so that no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neighborfield.llm.anchored import Windows, anchors, arrow, blocks_of, flagged, packed, ranges_for, repeated_anchors, rows_of, structs, unpacked, utf8_texts
from neighborfield.llm.runtime import ids_of, releasing, written

#: 50-byte windows; a gram of 24 bytes makes about one byte in 14 an anchor.
WINDOW, GRAM = 50, 24
#: A byte that UTF-8 never has ends the part of a suffix from its anchor on.
END = b"\xff"
#: Contexts that are settled together; those of one gram always are.
RESOLVE_AT = 30_000


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, known to be at least known."""
    at = known
    while True:
        x, y = a[at : at + 16], b[at : at + 16]
        if x != y or len(x) < 16:
            for c, d in zip(x, y, strict=False):
                if c != d:
                    return at
                at += 1
            return at
        at += 16


def front_coded(keys: list[bytes]) -> tuple[bytes, bytes]:
    """(shared lengths and rest lengths, rests) of sorted keys."""
    lcps = [0, *map(shared, keys[:-1], keys[1:])] if keys else []
    rests = [k[n:] for k, n in zip(keys, lcps, strict=True)]
    lengths = np.array([lcps, list(map(len, rests))], "<u2").reshape(-1)
    return packed(lengths), zstandard.ZstdCompressor(level=3).compress(b"".join(rests))


def front_decoded(lengths: bytes, rests: bytes) -> Iterator[tuple[bytes, int]]:
    """(key, prefix shared with the key before), one at a time."""
    lcps, sizes = unpacked(lengths, "<u2").reshape(2, -1)
    raw = zstandard.ZstdDecompressor().decompress(rests)
    at, last = 0, b""
    for n, size in zip(lcps.tolist(), sizes.tolist(), strict=True):
        last = last[:n] + raw[at : at + size]
        yield last, n
        at += size


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """(key, prefix shared with the key before, run) in sorted order, by a loser tree with known prefixes."""
    k = 1
    while k < len(runs):
        k *= 2
    nothing: tuple[None, int] = (None, 0)
    heads: list[bytes | None] = [next(run, nothing)[0] for run in runs] + [None] * (k - len(runs))
    known, losers = [0] * k, [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one shared with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = shared(x, y, known[a])
        if x[n : n + 1] < y[n : n + 1] or len(x) == len(y) == n and a < b:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    winners = list(range(k))
    level = k
    while level > 1:
        level //= 2
        new = []
        for i in range(level):
            w, loser = play(winners[2 * i], winners[2 * i + 1])
            losers[level + i] = loser
            new.append(w)
        winners = new
    w = winners[0]
    while heads[w] is not None:
        yield heads[w], known[w], w
        heads[w], known[w] = next(runs[w], nothing)
        node = (w + k) // 2
        while node:
            w, losers[node] = play(w, losers[node])
            node //= 2


def _read(w: Windows, text_at: int):
    def read(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, bytes]:
        texts = utf8_texts(rows, text_at)
        raw = b"".join(texts)
        return np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)]), raw

    return read


class Contexts:
    """A block's candidate anchors (place, first and last window, document, range), the number of each one's context
    among the block's, and for each context its smallest document and the first place there. Contexts are compared hash
    by hash, so only those of one hash are held as bytes; key() makes one again."""

    def __init__(self, rows: pa.Table, replies: pa.Table, read, w: Windows, ids: np.ndarray, ranges: int, bits: int):
        self.w = w
        symbols, self.at, self.raw = read(rows)
        place, hashes, first, last = anchors(symbols, self.at, w)
        flags, of = flagged(hashes, replies, ranges, bits)
        order = np.flatnonzero(flags)
        order = order[np.argsort(hashes[order], kind="stable")]
        self.place, self.first, self.last, self.of = place[order], first[order], last[order], of[order]
        hashes = hashes[order]
        self.doc = ids[np.searchsorted(self.at, self.place, "right") - 1] if len(order) else np.zeros(0, np.int64)
        begins = np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)]
        alone = begins & np.append(begins[1:], True)[: len(hashes)]
        self.number, n = np.cumsum(alone) - 1, int(alone.sum())
        several, known = np.flatnonzero(~alone), {}
        for lo in range(0, len(several), 1 << 15):
            part = several[lo : lo + (1 << 15)]
            for i, new in zip(part.tolist(), begins[part].tolist(), strict=True):
                if new:
                    known.clear()
                number = known.setdefault(self.key(i), n)
                self.number[i] = number
                n += number == n
        self.one = np.zeros(n, np.int64)
        self.one[self.number] = np.arange(len(self.number))
        self.least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.number, self.doc)
        self.spot = np.full(n, np.iinfo(np.int64).max)
        here = self.doc == self.least[self.number]
        np.minimum.at(self.spot, self.number[here], self.place[here])

    def key(self, i: int) -> bytes:
        s, p, e = self.first[i], self.place[i], self.last[i] + self.w.size
        return self.raw[p:e] + END + self.raw[s:p][::-1]


def window_minima(keys: list[bytes], lcps: np.ndarray, least: np.ndarray, w: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For sorted distinct contexts: (offset, contexts that have a window there, smallest document of each one's window)."""
    right = np.array([k.rindex(END) for k in keys])
    left = np.array([len(k) for k in keys]) - right - 1
    together = lcps >= w.gram  # shares its gram with the context before
    several = np.flatnonzero(together | np.append(together[1:], False))  # others' windows are theirs alone
    lcp = np.minimum(lcps, right)[several]
    letters = np.zeros((len(several), w.steps), np.uint8)
    for row, i in enumerate(several.tolist()):
        tail = keys[i][right[i] + 1 :]
        letters[row, : len(tail)] = np.frombuffer(tail, np.uint8)
    same_left = np.zeros(len(several), np.int64)
    for offset in range(w.steps):
        own = np.flatnonzero((left >= offset) & (right >= w.size - offset))
        smallest = least.copy()
        if len(several):
            if offset:
                same_left = np.unique(same_left * 256 + letters[:, offset - 1], return_inverse=True)[1]
            has = np.flatnonzero((left[several] >= offset) & (right[several] >= w.size - offset))
            if len(has):
                run = np.cumsum(lcp < w.size - offset)[has]
                group = np.unique(run * (len(several) + 1) + same_left[has], return_inverse=True)[1]
                first = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
                np.minimum.at(first, group, least[several[has]])
                smallest[several[has]] = first[group]
        yield offset, own, smallest[own]


def _resolve(w: Windows):
    def resolve(part: pa.Table) -> pa.Table:
        """For each block: the places of contexts, and a bit for each offset whose window starts in a smaller document."""
        blocks = part["block"].to_pylist()
        docs = [unpacked(x.as_py(), "<i8") for x in part["docs"]]
        spots = [unpacked(x.as_py(), "<u4") for x in part["spots"]]
        doc, begin = np.concatenate(docs), np.cumsum([0, *map(len, docs)])
        mask, done = np.zeros(len(doc), np.uint64), np.zeros(len(blocks), np.int64)
        none = np.iinfo(np.int64).max

        def settle(keys: list[bytes], lcps: list[int], number: list[int], run: list[int]) -> None:
            if not keys:
                return
            runs, numbers = np.array(run), np.array(number)
            by_run = np.argsort(runs, kind="stable")  # a run's contexts come in its own order
            counts = np.bincount(runs, minlength=len(blocks))
            at = np.empty(len(runs), np.int64)
            at[by_run] = np.repeat(begin[:-1] + done - (np.cumsum(counts) - counts), counts) + np.arange(len(runs))
            done[:] += counts
            least = np.full(len(keys), none)
            np.minimum.at(least, numbers, doc[at])
            for offset, own, smallest in window_minima(keys, np.array(lcps), least, w):
                bound = np.full(len(keys), none)
                bound[own] = smallest
                mask[at[bound[numbers] < doc[at]]] |= np.uint64(1 << offset)

        keys, lcps, number, run = [], [], [], []
        for key, lcp, r in merge([front_decoded(a.as_py(), b.as_py()) for a, b in zip(part["lengths"], part["rests"], strict=True)]):
            if not keys or not lcp == len(key) == len(keys[-1]):
                if lcp < w.gram and len(keys) >= RESOLVE_AT:
                    settle(keys, lcps, number, run)
                    keys, lcps, number, run = [], [], [], []
                lcps.append(lcp if keys else 0)
                keys.append(key)
            number.append(len(keys) - 1)
            run.append(r)
        settle(keys, lcps, number, run)
        rows = []
        for i, (b, s) in enumerate(zip(blocks, spots, strict=True)):
            m = mask[begin[i] : begin[i + 1]]
            if (hit := m > 0).any():
                rows.append((b, packed(s[hit]), packed(m[hit])))
        return arrow("block long, spots binary, masks binary", rows)

    return resolve


def _covered(c: Contexts, found: pa.Table) -> np.ndarray:
    """For each byte of a block: is it in a window that starts in a smaller document. found: places and masks."""
    w, change = c.w, np.zeros(len(c.raw) + 1, np.int32)
    later = c.doc > c.least[c.number]
    np.add.at(change, c.first[later], 1)
    np.add.at(change, c.last[later] + w.size, -1)
    if found.num_rows and len(c.least):
        spots = np.concatenate([unpacked(x.as_py(), "<u4") for x in found["spots"]])
        masks = np.concatenate([unpacked(x.as_py(), "<u8") for x in found["masks"]])
        #: A place may be two contexts' where a segment's edge cut its windows; offsets then tell them apart.
        order = np.argsort(spots, kind="stable")
        spots = spots[order]
        begin = np.flatnonzero(np.diff(spots.astype(np.int64), prepend=-1))
        masks, spots = np.bitwise_or.reduceat(masks[order], begin), spots[begin]
        at = np.minimum(np.searchsorted(spots, c.spot), len(spots) - 1)
        mask_of = np.where(spots[at] == c.spot, masks[at], np.uint64(0))
        open_ = np.flatnonzero((mask_of[c.number] > 0) & ~later)
        mask, place, first, last = mask_of[c.number[open_]], c.place[open_], c.first[open_], c.last[open_]
        for offset in range(w.steps):
            hit = (mask >> np.uint64(offset) & np.uint64(1)).astype(bool) & (place - offset >= first) & (place - offset <= last)
            np.add.at(change, place[hit] - offset, 1)
            np.add.at(change, place[hit] - offset + w.size, -1)
    return np.cumsum(change, out=change)[:-1] > 0


def whole_characters(covered: np.ndarray, data: np.ndarray) -> np.ndarray:
    """covered where all bytes of a UTF-8 character are, so that the rest is still UTF-8."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if len(starts) in (0, len(data)):
        return covered
    sizes = np.diff(np.append(starts, len(data)))
    return np.repeat(np.minimum.reduceat(covered, starts), sizes)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept): row holds the input's columns, kept the remaining bytes of its text.

    as_text: kept is a string; a character of which only some bytes repeat stays."""
    w = Windows(window, gram)
    assert 8 <= gram <= window and w.steps <= 64
    text_at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)
    read = _read(w, text_at)
    blocks = blocks_of(docs, text_col, "blocks")
    ranges, bits = ranges_for(docs)
    flags = repeated_anchors(blocks, read, w, ranges, bits)
    names = docs.columns

    def send(block: pa.Table, replies: pa.Table) -> pa.Table:
        if not block.num_rows:
            return arrow("range long, block long, lengths binary, rests binary, docs binary, spots binary", [])
        rows = rows_of(block["payload"][0].as_py())
        c = Contexts(rows, replies, read, w, ids_of(rows.column(id_at).combine_chunks()), ranges, bits)
        own_range = c.of[c.one]
        by_range = np.argsort(own_range, kind="stable")
        cuts = np.flatnonzero(np.diff(own_range[by_range], prepend=-1)).tolist()
        out = []
        for lo, hi in zip(cuts, [*cuts[1:], len(by_range)], strict=False):
            keys = {c.key(c.one[i]): i for i in by_range[lo:hi].tolist()}
            order = sorted(keys)
            own = np.array(list(map(keys.__getitem__, order)))
            lengths, rests = front_coded(order)
            out.append((int(own_range[by_range[lo]]), block["block"][0].as_py(), lengths, rests, packed(c.least[own].astype("<i8")), packed(c.spot[own].astype("<u4"))))
        return arrow("range long, block long, lengths binary, rests binary, docs binary, spots binary", out)

    runs = blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(releasing(send), "range long, block long, lengths binary, rests binary, docs binary, spots binary")
    masks = written(runs.groupBy("range").applyInArrow(releasing(_resolve(w)), "block long, spots binary, masks binary"), "masks")
    none = F.lit(None)
    replies = flags.select("block", "range", "flags", none.cast("binary").alias("spots"), none.cast("binary").alias("masks")).union(masks.select("block", none.cast("long"), none.cast("binary"), "spots", "masks"))
    schema = T.StructType([T.StructField("row", structs(docs)), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])

    def finish(block: pa.Table, sent: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        rows = rows_of(block["payload"][0].as_py())
        known = sent.filter(pc.is_valid(sent["range"]))
        found = sent.filter(pc.is_valid(sent["spots"]))
        c = Contexts(rows, known, read, w, ids_of(rows.column(id_at).combine_chunks()), ranges, bits)
        at, raw = c.at, c.raw
        covered = _covered(c, found)
        begins = covered.copy()
        begins[1:] &= ~covered[:-1]
        full = np.flatnonzero(np.diff(at))
        begins[at[full]] = covered[at[full]]
        n_removed, n_spans = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int64)
        if len(full):
            n_removed[full] = np.add.reduceat(covered, at[full], dtype=np.int64)
            n_spans[full] = np.add.reduceat(begins, at[full], dtype=np.int64)
        del c, begins
        data = np.frombuffer(raw, np.uint8)
        kept = []
        for a, b, n in zip(at[:-1].tolist(), at[1:].tolist(), n_removed.tolist(), strict=True):
            gone = covered[a:b]
            if n and as_text:
                gone = whole_characters(gone, data[a:b])
            kept.append(data[a:b][~gone].tobytes() if n else raw[a:b])
        kept = pa.array(kept, pa.binary())
        if as_text:
            kept = kept.cast(pa.string())
        row = pa.StructArray.from_arrays([c.combine_chunks() for c in rows.columns], names=names)
        return pa.table([row, pa.array(np.diff(at)), pa.array(n_removed), pa.array(n_spans), kept], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(releasing(finish), schema)


#: The definition for DuckDB: strings of 50 bytes in hexadecimal; texts are cut into stretches first, for short substrings.
SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
q AS (SELECT doc_id, x, unnest(range((strlen(x) + 999) // 1000)) AS n FROM d),
s AS MATERIALIZED (SELECT doc_id, n, x[1000 * n + 1 : 1000 * n + 1098] AS x FROM q),
b AS MATERIALIZED (SELECT doc_id, 500 * n + p AS p, x[2 * p + 1 : 2 * p + 2] AS byte, CASE WHEN 2 * p + 100 <= strlen(x) THEN x[2 * p + 1 : 2 * p + 100] END AS w FROM (SELECT doc_id, n, x, unnest(range(least(500, strlen(x) // 2))) AS p FROM s)),
f AS (SELECT doc_id, p, byte, w IS NOT NULL AND min(doc_id) OVER (PARTITION BY w) < doc_id AS starts FROM b),
g AS (SELECT doc_id, p, byte, coalesce(max(CASE WHEN starts THEN p END) OVER (PARTITION BY doc_id ORDER BY p) > p - 50, false) AS gone FROM f),
h AS (SELECT doc_id, p, byte, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM g),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM h GROUP BY doc_id)
SELECT doc_id, strlen(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
