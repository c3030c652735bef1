"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte ranges. Every mergeable neighbour pair sits in the bucket of its rank; a bitmap of
ranks with two summary levels above it gives the lowest rank by three find-first-set steps. A popped position whose
pair has changed meanwhile is stale and skipped. Each merge costs a constant number of steps beside the bucket's own
heap, so a pre-token of n bytes takes about n log n steps however long it is.

Texts split at white space into chunks that no match of the pattern crosses; chunks of up to CACHED_CHARS are
remembered in a bounded cache. Short pre-tokens that are not in it are merged together, by one queue. Nulls count as
empty texts, which have no ids. A null doc_id stays null. Repeated rows are encoded each. A very long text is one
row's work; beside it, its ids and its different chunks are held. An empty table gives no rows. Other columns of the
input are ignored.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from neighborfield.llm.runtime import Remembered, documents, laid_out, places, slices, texts_of

CACHED_CHARS = 64
CACHE_ENTRIES = 400_000
#: Pre-tokens up to this size share one queue; texts of so many bytes are encoded together.
SHORT_BYTES, TOGETHER_BYTES = 64, 6 << 20
#: Unicode's White_Space, which \\s means to the pattern's engine.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: White space that texts seldom hold, and what tells of a run of it that a cut before each space might split wrongly.
RARE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Kinds of Latin-1 characters: L letters and numbers, P full stop and comma, S space and line end, Q all others.
KINDS = bytes(ord("P") if c in ".," else ord("S") if c in " \n" else ord("L") if unicodedata.category(c)[0] in "LN" else ord("Q") for c in map(chr, range(256)))
RUNS = ("  ", "\t ", "\n ", "\v ", "\f ", "\r ")


class BytePairEncoder:
    """ranks: token bytes -> id, ids being the merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        #: (left id << 32 | right id) -> rank, for every cut of every token into two tokens.
        self.pairs = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.byte_ids = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.byte_pairs = np.array([ranks.get(bytes([i, j]), -1) for i in range(256) for j in range(256)], np.int32)
        top = max(ranks.values(), default=0)
        self.low = [0] * ((top >> 6) + 1)
        self.mid = [0] * ((top >> 12) + 1)
        self.buckets: dict[int, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self._merge(piece)

    def _merge(self, piece: bytes) -> list[int]:
        n, get = len(piece), self.ranks.get
        low, mid, buckets, top = self.low, self.mid, self.buckets, 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        for i, r in enumerate(pair):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)  # ascending, so a heap
                else:
                    buckets[r] = [i]
                    low[r >> 6] |= 1 << (r & 63)
                    mid[r >> 12] |= 1 << (r >> 6 & 63)
                    top |= 1 << (r >> 12)
        while top:
            a = (top & -top).bit_length() - 1
            word = mid[a]
            b = a << 6 | (word & -word).bit_length() - 1
            word = low[b]
            r = b << 6 | (word & -word).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                low[b] &= low[b] - 1
                if not low[b]:
                    mid[a] &= mid[a] - 1
                    if not mid[a]:
                        top &= top - 1
            if pair[i] != r:
                continue
            j = after[i]
            end = after[j]
            pair[j] = -1
            after[i] = end
            if end < n:
                before[end] = i
                right = get(piece[i : after[end]], -1)
            else:
                right = -1
            pair[i] = right
            left_at = before[i]
            left = -1
            if left_at >= 0:
                left = pair[left_at] = get(piece[left_at:end], -1)
            for at, new in ((left_at, left), (i, right)):
                if new >= 0:
                    if new in buckets:
                        heappush(buckets[new], at)
                    else:
                        buckets[new] = [at]
                        low[new >> 6] |= 1 << (new & 63)
                        mid[new >> 12] |= 1 << (new >> 6 & 63)
                        top |= 1 << (new >> 12)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = left.astype(np.int64) << 32 | right
        if len(keys) <= 32:
            return np.array([self.pairs.get(k, -1) for k in keys.tolist()], np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Each pre-token's ids as int32, all by one queue: a bucket then holds positions of many pre-tokens. Those of
        one bucket merge together, but only the first of each pre-token; the others stay in the bucket."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, sizes = len(data), np.array(list(map(len, pieces)))
        if not n:
            return [b""] * len(pieces)
        word = np.append(np.repeat(np.arange(len(pieces), dtype=np.int32), sizes), np.int32(-1))
        ids = np.append(self.byte_ids[data], np.int32(-1))
        after, before, alive = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32), np.ones(n, bool)
        pair = self.byte_pairs[data.astype(np.int32) << 8 | np.append(data[1:], 0)]
        pair[word[1:] != word[:-1]] = -1
        order = np.argsort(pair, kind="stable").astype(np.int32)
        order = order[np.searchsorted(pair[order], 0) :]
        first = np.flatnonzero(np.diff(pair[order], prepend=-1))
        waiting = {int(pair[order[a]]): [order[a:b]] for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)][: len(first)], strict=True)}
        low, mid, top, more = self.low, self.mid, 0, {}
        for r in waiting:
            low[r >> 6] |= 1 << (r & 63)
            mid[r >> 12] |= 1 << (r >> 6 & 63)
            top |= 1 << (r >> 12)
        while top:
            a = (top & -top).bit_length() - 1
            bits = mid[a]
            b = a << 6 | (bits & -bits).bit_length() - 1
            bits = low[b]
            r = b << 6 | (bits & -bits).bit_length() - 1
            parts, single = waiting.pop(r, []), more.pop(r, None)
            if single:
                parts.append(np.array(single))
            i = parts[0] if len(parts) == 1 else np.concatenate(parts)
            i = i[pair[i] == r]
            if len(parts) > 1 or single:
                i = np.unique(i)
            if len(i) > 1:
                own = word[i]
                again = np.flatnonzero(own[1:] == own[:-1]) + 1
                if len(again):
                    waiting[r] = [i[again]]
                    i = np.delete(i, again)
            if r not in waiting:
                low[b] = bits & (bits - 1)
                if not low[b]:
                    mid[a] &= mid[a] - 1
                    if not mid[a]:
                        top &= top - 1
            if not len(i):
                continue
            j = after[i]
            k = after[j]
            alive[j] = False
            pair[j] = -1
            pair[i] = -1
            ids[i] = r
            after[i] = k
            before[k] = i
            p = before[i]
            right, left = word[k] == word[i], word[p] == word[i]
            at = np.concatenate([i[right], p[left]])
            new = self._ranks_of(np.concatenate([ids[i[right]], ids[p[left]]]), np.concatenate([ids[k[right]], ids[i[left]]]))
            pair[at] = new
            for x, y in zip(new.tolist(), at.tolist(), strict=True):
                if x >= 0:
                    if x in more:
                        more[x].append(y)
                    else:
                        more[x] = [y]
                        low[x >> 6] |= 1 << (x & 63)
                        mid[x >> 12] |= 1 << (x >> 6 & 63)
                        top |= 1 << (x >> 12)
        left_ids, counts = ids[:-1][alive].astype(np.int32).tobytes(), np.bincount(word[:-1][alive], minlength=len(pieces))
        ends = np.cumsum(counts) * 4
        return [left_ids[a:b] for a, b in zip((ends - 4 * counts).tolist(), ends.tolist(), strict=True)]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's ids as int32."""
        found = [self.pattern.findall(c) for c in chunks]
        known = {p: b"" for pieces in found for p in pieces}
        raw = [p.encode() for p in known]
        short = [i for i, p in enumerate(raw) if len(p) <= SHORT_BYTES and p not in self.ranks]
        out = [np.array(self.merge(p), np.int32).tobytes() if len(p) > SHORT_BYTES or p in self.ranks else b"" for p in raw]
        for i, made in zip(short, self.merge_many([raw[i] for i in short]), strict=True):
            out[i] = made
        known = dict(zip(known, out, strict=True))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in found]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> tuple[BytePairEncoder, Remembered]:
    return BytePairEncoder(read_ranks(path), pattern), Remembered(CACHE_ENTRIES)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> dict[int, bytes]:
    return {v: k for k, v in read_ranks(path).items()}


def absent(texts: list[str]) -> str:
    """A character that no text has: the null byte, else a noncharacter, else any other."""
    return next(c for c in map(chr, chain([0], range(0xFDD0, 0xFDF0), range(0x10000, 0x110000))) if not any(c in t for t in texts))


def marked(text: str, mark: str) -> str:
    """The text with mark between chunks that no match of the pattern crosses. A match starts before a space, unless the
    space is inside a run of white space or in a run at the end; texts with such runs are cut by CHUNKS."""
    if any(r in text for r in RUNS) or text[-2:].isspace() or not text.isascii() and any(c in text for c in RARE_SPACE):
        return mark.join(CHUNKS.findall(text))
    cut = text.replace(" ", mark + " ")
    if any(r in text for r in ("\n\n", "\t", "\r", "\v", "\f")):
        return cut
    try:
        kinds = text.encode("latin-1").translate(KINDS)
    except UnicodeEncodeError:
        return cut
    if b"PPS" in kinds or b"QPS" in kinds or b"SPS" in kinds:
        return cut
    # a lone line end is a match, and so is a stop between a letter and white space
    return cut.replace("\n", mark + "\n" + mark).replace("." + mark, mark + "." + mark).replace("," + mark, mark + "," + mark)


def encode_texts(texts: list[str], encoder: BytePairEncoder, remembered: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and where each text's start. A chunk is looked up once; those that the cache lacks are
    encoded together."""
    mark = absent(texts)
    chunks, numbers, at = places([marked(t, mark) for t in texts], mark)
    fresh = remembered.missing(chunks)
    remembered.new.update(zip(fresh, encoder.encode_chunks(fresh), strict=True))
    out = laid_out(list(map(remembered.new.__getitem__, chunks)), numbers, at)
    remembered.forget(fresh, CACHED_CHARS)
    return out


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids). path: a rank file that lies at the same place on every machine (an installed package's data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, remembered = _loaded(path, pattern)
        for b in slices(batches, "text", TOGETHER_BYTES):
            ids, at = encode_texts(texts_of(b["text"]), encoder, remembered)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded's rows (doc_id, ids) with raw, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _vocabulary(path).__getitem__
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                at, values = b["ids"].offsets.to_numpy(), b["ids"].values.to_numpy()
                raw = [b"".join(map(token, values[x:y].tolist())) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["ids"], pa.array(raw, pa.binary())], names=["doc_id", "ids", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, raw binary")
