"""How sources of a language differ in their words: counts in mergeable radix tries.

Terms are runs of letters (A-Z become small) and characters beyond ASCII. Each task counts the terms of its documents in
one byte trie for each language, whose leaves count the term's occurrences by source and its documents; a table from term
to leaf saves the way down for words that were seen before. Tries with more than LEAVES leaves are walked and emptied. Walks give a language's terms in the order of their UTF-8 bytes, and
these runs are merged by ranges of (language, term), that is of prefixes: each range's rows are sorted and joined leaf by
leaf as they stream by, so a task holds one leaf. Leaves of at least `least` documents are kept.

Kept leaves stay in their order in chunks of CHUNK_LEAVES. From a chunk and the counts of the language's sources come the
parts of every pair's sum, and, in order of the bytes, each source's best `most` candidates. A hot language or source is
many chunks, a hot term is one row for each run before the merge and one leaf after it.

Probabilities are integers, 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), exact for counts of any size. A source pair
is a row of the result, so rows grow with the square of a language's sources; so does a task's memory beside its chunk.

A null text, lang or source is an empty string. Repeated rows count as documents. A very long text is counted in pieces
that end between terms; a very long term is one. An empty table gives no rows; a language without kept terms gives its
pairs with 0. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neighborfield.llm.runtime import releasing, small_batches, written

LEAST_DOCUMENTS, MOST_TERMS, SCALE, PRIOR = 30, 50, 10**9, 5
#: Leaves of a task's tries, counters that wait for them, rows of a merge task, leaves of a chunk.
LEAVES, WAITING, RANGE_ROWS, CHUNK_LEAVES = 300_000, 500_000, 1_000_000, 10_000
PIECE_BYTES, ROWS = 1 << 20, 8192
TERM, GAP = re.compile(rb"[A-Za-z\x80-\xff]+"), re.compile(rb"[^A-Za-z\x80-\xff]")
RUN_NAMES = ["lang", "term", "docs", "sources", "counts"]
RUN = "lang string, term binary, docs long, sources array<string>, counts array<long>"


class RadixTrie:
    """Byte strings by shared prefixes. A node is [label, children by first byte or None, number of its leaf or -1]."""

    def __init__(self):
        self.root: list = [b"", None, -1]

    def insert(self, terms: list[bytes], numbers: list[int]) -> None:
        """Sorted terms with their leaves' numbers. The way to the term before is kept, so that each only adds its own end;
        a label that parts from the term is split."""
        way = [(b"", self.root)]
        for term, number in zip(terms, numbers, strict=True):
            while not term.startswith(way[-1][0]):
                way.pop()
            prefix, node = way[-1]
            at = len(prefix)
            while at < len(term):
                if node[1] is None:
                    node[1] = {}
                child = node[1].get(term[at])
                if child is None:
                    child = node[1][term[at]] = [term[at:], None, -1]
                elif not term.startswith(child[0], at):
                    label = child[0]
                    n = next(k for k in range(1, len(label)) if at + k == len(term) or label[k] != term[at + k])
                    middle = node[1][term[at]] = [label[:n], {label[n]: child}, -1]
                    child[0] = label[n:]
                    child = middle
                node = child
                at += len(node[0])
                way.append((term[:at], node))
            node[2] = number

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """(term, number) of the leaves in the order of the terms' bytes."""
        ahead = [(b"", self.root)]
        while ahead:
            prefix, (label, children, number) = ahead.pop()
            prefix += label
            if number >= 0:
                yield prefix, number
            if children:
                ahead += [(prefix, children[b]) for b in sorted(children, reverse=True)]


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts that end between terms."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        gap = GAP.search(text, at + PIECE_BYTES)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each one's numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class Language:
    """A task's counts of one language: a number for each term's leaf, and the leaves' counters by source."""

    def __init__(self):
        self.numbers: defaultdict = defaultdict()
        self.numbers.default_factory = self.numbers.__len__  # a new term is the next leaf
        self.sources: defaultdict = defaultdict()
        self.sources.default_factory = self.sources.__len__
        self.words: list[np.ndarray] = []
        self.seen: list[np.ndarray] = []
        self.waiting = 0
        self.keys = self.counts = np.zeros(0, np.int64)
        self.documents = np.zeros(0, np.int64)

    def add(self, source: str, text: bytes) -> None:
        own, number = self.sources[source], self.numbers.__getitem__
        parts = []
        for piece in pieces(text):
            terms = TERM.findall(piece.lower())
            leaves = np.fromiter(map(number, terms), np.int64, len(terms))
            different, n = np.unique(leaves, return_counts=True)
            parts.append(different)
            self.words.append(np.stack([different << 32 | own, n]))
            self.waiting += len(different)
        self.seen.append(parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)))
        if self.waiting > WAITING:
            self.settle()

    def settle(self) -> None:
        keys, n = np.concatenate([np.stack([self.keys, self.counts]), *self.words], 1)
        self.keys, self.counts = summed(keys, n)
        documents = np.bincount(np.concatenate([np.zeros(0, np.int64), *self.seen]), minlength=len(self.numbers))
        documents[: len(self.documents)] += self.documents
        self.documents = documents
        self.words, self.seen, self.waiting = [], [], 0

    def run(self, lang: str) -> Iterator[pa.RecordBatch]:
        """The trie's leaves in order, each with its documents and counters; first, the sources."""
        self.settle()
        names = pa.array(list(self.sources), pa.string())
        none = pa.array(np.zeros(1, np.int64))
        for s in range(len(names)):
            one = pa.array(np.array([0, 1], np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.binary()), none, pa.ListArray.from_arrays(one, names.slice(s, 1)), pa.ListArray.from_arrays(one, none)], names=RUN_NAMES)
        terms = sorted(self.numbers)
        trie = RadixTrie()
        trie.insert(terms, list(map(self.numbers.__getitem__, terms)))
        first = np.searchsorted(self.keys >> 32, np.arange(len(terms) + 1))
        walk = trie.walk()
        while rows := list(islice(walk, ROWS)):
            leaf = np.array([n for _, n in rows], np.int64)
            size = first[leaf + 1] - first[leaf]
            ends = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(first[leaf] - ends[:-1], size) + np.arange(ends[-1])
            lists = pa.array(ends.astype(np.int32))
            sources = names.take(pa.array(self.keys[at] & 0xFFFFFFFF))
            columns = [pa.array([lang] * len(rows)), pa.array([t for t, _ in rows], pa.binary()), self.documents[leaf], pa.ListArray.from_arrays(lists, sources), pa.ListArray.from_arrays(lists, pa.array(self.counts[at]))]
            yield pa.RecordBatch.from_arrays(columns, names=RUN_NAMES)


def count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tries of a task's documents, walked; a row with a null term names each group that occurs."""
    languages: dict[str, Language] = {}
    for b in batches:
        for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"].cast(pa.binary()), strict=True):
            if lang not in languages:
                languages[lang] = Language()
            languages[lang].add(source, text.as_py())
        if sum(len(x.numbers) + len(x.sources) for x in languages.values()) > LEAVES:
            for lang in list(languages):
                yield from languages.pop(lang).run(lang)
    for lang in list(languages):
        yield from languages.pop(lang).run(lang)


def merge_runs(least: int):
    """Sorted leaves of several tries as the leaves of one; kept ones with their chunk."""

    def merged(rows: pa.Table, number: int) -> tuple[pa.Table, int]:
        """Whole leaves: those that are kept, and how many."""
        first = np.flatnonzero(starts_of(rows))
        documents = np.add.reduceat(rows["docs"].to_numpy(), first)
        keep = documents >= least
        sizes = np.diff(np.append(first, rows.num_rows))
        own = rows.filter(pa.array(np.repeat(keep, sizes)))
        lists = own["sources"].combine_chunks()
        coded = lists.flatten().dictionary_encode()
        leaf = np.repeat(np.repeat(np.arange(keep.sum()), sizes[keep]), lists.value_lengths().to_numpy())
        counts = own["counts"].combine_chunks().flatten().to_numpy()
        keys, n = summed(leaf << 32 | coded.indices.to_numpy().astype(np.int64), counts)
        at = pa.array(np.searchsorted(keys >> 32, np.arange(keep.sum() + 1)).astype(np.int32))
        heads = rows.take(pa.array(first[keep]))
        chunk = (TaskContext.get().partitionId() << 32) + (number + np.arange(keep.sum())) // CHUNK_LEAVES
        sources = coded.dictionary.take(pa.array(keys & 0xFFFFFFFF))
        columns = [heads["lang"], pa.array(chunk), heads["term"], pa.ListArray.from_arrays(at, sources), pa.ListArray.from_arrays(at, pa.array(n))]
        return pa.table(columns, names=["lang", "chunk", "term", "sources", "counts"]), int(keep.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, number = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            rows = rows if left is None else pa.concat_tables([left, rows])
            last = int(np.flatnonzero(starts_of(rows))[-1])  # this leaf may go on in the next batch
            left = rows.slice(last)
            if last:
                done, n = merged(rows.slice(0, last), number)
                number += n
                yield from done.to_batches()
        if left is not None:
            yield from merged(left, number)[0].to_batches()

    return releasing(run)


def starts_of(rows: pa.Table) -> np.ndarray:
    """Where sorted rows come to another (lang, term)."""
    out = np.ones(rows.num_rows, bool)
    for c in ("lang", "term"):
        column = rows[c].combine_chunks()
        other = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        out[1:] = other if c == "lang" else out[1:] | other
    return out


def scaled(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly."""
    if count.max(initial=0) + PRIOR < (1 << 63) // SCALE:
        return 1 + SCALE * (count + PRIOR) // (total + PRIOR * terms)
    return (1 + SCALE * (count.astype(object) + PRIOR) // (np.asarray(total).astype(object) + PRIOR * terms)).astype(np.int64)


def compared(most: int):
    """From a chunk of leaves and the language's sources: parts of the pairs' sums, and each source's candidates."""

    def run(leaves: pa.Table, groups: pa.Table) -> pa.Table:
        if not leaves.num_rows or not groups.num_rows:
            return pa.table({c: pa.array([], k) for c, k in (("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64()))})
        lang = groups["of"][0].as_py()
        leaves, groups = leaves.sort_by("term").combine_chunks(), groups.sort_by("source").combine_chunks()
        sources, totals = groups["source"].combine_chunks(), groups["n"].to_numpy()
        terms, whole = groups["terms"][0].as_py(), groups["lang_n"][0].as_py()
        names, lists = leaves["term"].cast(pa.string()), leaves["sources"].combine_chunks()
        row = np.repeat(np.arange(leaves.num_rows), lists.value_lengths().to_numpy())
        column = pc.index_in(lists.flatten(), sources).to_numpy()
        n = leaves["counts"].combine_chunks().flatten().to_numpy()
        sums = np.zeros((len(sources), len(sources)), np.int64)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(sources)
        step = max(1, (1 << 21) // len(sources))
        for lo in range(0, leaves.num_rows, step):
            a, z = np.searchsorted(row, [lo, lo + step])
            count = np.zeros((min(step, leaves.num_rows - lo), len(sources)), np.int64)
            count[row[a:z] - lo, column[a:z]] = n[a:z]
            p, q = scaled(count, totals, terms), scaled(count.sum(1), whole, terms)
            for s in range(len(sources)):
                sums[s, s + 1 :] += np.abs(p[:, s + 1 :] - p[:, s : s + 1]).sum(0)
                more = np.flatnonzero((count[:, s] > 0) & (p[:, s] > q))
                at = np.concatenate([best[s][0], more + lo])
                value = np.concatenate([best[s][1], (p[more, s] - q[more])])
                top = np.argsort(-value, kind="stable")[:most]  # stable: equal values in the order of their bytes
                best[s] = at[top], value[top]
        sums += sums.T
        a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
        own = np.repeat(np.arange(len(sources)), [len(x[0]) for x in best])
        at, value = (np.concatenate([x[k] for x in best]) for k in (0, 1))
        pairs = pa.table({"source": sources.take(pa.array(a)), "part": pa.array(["pair"] * len(a), pa.string()), "item": sources.take(pa.array(b)), "value": sums[a, b]})
        candidates = pa.table({"source": sources.take(pa.array(own)), "part": pa.array(["term"] * len(own), pa.string()), "item": names.take(pa.array(at)), "value": value})
        both = pa.concat_tables([pairs, candidates.cast(pairs.schema)])
        return both.add_column(0, "lang", pa.array([lang] * both.num_rows, pa.string()))

    return releasing(run)


def kept_leaves(docs: DataFrame, least: int = LEAST_DOCUMENTS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Leaves (lang, chunk, term, sources, counts) that at least so many documents have, and the groups (lang, source)."""
    small_batches(docs.sparkSession)
    plain = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    runs = written(docs.select(plain(lang_col, "lang"), plain(source_col, "source"), plain(text_col, "text")).mapInArrow(releasing(count_runs), RUN), "trie-runs")
    groups = written(runs.filter("term is null").select("lang", F.explode("sources").alias("source")).distinct(), "audit-groups")
    leaves = runs.filter("term is not null")
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), leaves.count() // RANGE_ROWS + 1)
    merged = leaves.repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(merge_runs(least), "lang string, chunk long, term binary, sources array<string>, counts array<long>")
    return written(merged, "trie-leaves"), groups


def divergences(docs: DataFrame, least: int = LEAST_DOCUMENTS, most: int = MOST_TERMS, **columns: str) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair has every other source, part term the source's `most` terms."""
    leaves, groups = kept_leaves(docs, least, **columns)
    counts = leaves.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    terms = leaves.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n)).alias("lang_n"))
    stats = groups.join(counts, ["lang", "source"], "left").join(terms, "lang", "left")
    stats = written(stats.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "terms", "lang_n"))), "audit-stats")
    chunks = leaves.select("lang", "chunk").distinct().join(stats, "lang").select(F.col("lang").alias("of"), F.col("chunk").alias("no"), "source", "n", "terms", "lang_n")
    kinds = "lang string, source string, part string, item string, value long"
    found = written(leaves.groupBy("lang", "chunk").cogroup(chunks.groupBy("of", "no")).applyInArrow(compared(most), kinds), "audit-parts")
    bare = stats.filter("terms = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(none)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(found.filter("part = 'term'")).filter(F.col("rank") <= most))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS terms FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, sum(n) AS n FROM t GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM x JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM x GROUP BY lang, term) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM u QUALIFY part = 'pair' OR rank <= 50
"""
