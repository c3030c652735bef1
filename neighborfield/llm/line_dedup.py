"""Removal of repeated line runs: a suffix array over line ids by distributed prefix doubling, in DataFrame functions.

The lines of all documents are one sequence, addressed in order of (doc_id, text hash, line), and a suffix ends with its
document. The rank of a suffix at length h names the class of suffixes that share their next h lines; it is the address
of the earliest one. Ranks of length h joined with the ranks h lines on give those of length 2h, until no class has two
suffixes. A suffix that is alone is dropped at once, for no longer prefix of it repeats either.

A class is an LCP interval of at least its length. A suffix that isn't its class's earliest is a later copy; its longest
class names the source, and the common prefix with the source is found exactly by going down the lengths (add h lines
where both have the same rank of length h). Copies that only go on with a copy that starts a line before, from the same
source, are dropped; the rest are the maximal repeated runs. Runs of at least two lines are removed.

Classes come from aggregates that combine before the shuffle and are written before they are joined, so that both sides
of the join can be split where a line is in a third of all documents.

Lines end at \\n; lines of spaces only are kept and don't count. A null doc_id comes last. Rows with the same doc_id and
text are one document, share the decision and don't remove each other's lines; of several texts under one doc_id the one
with the smaller hash is earlier. A null text is empty. A very long text is one row; beside it, 16 bytes a line are held.
An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neighborfield.llm.runtime import NULL_ID, documents, written

#: Runs of at least so many lines.
LEAST_LINES = 2
KEY = ["d", "k"]


def line_ids(base: DataFrame) -> DataFrame:
    """base: (d, k, text). (g, past, d, k, pos, line, id1, id2): each line that counts; g is its address, past the first
    address after its document, pos its place among those that count, line its number among all of the text."""
    every = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), (F.trim(x) != "").alias("counts"), F.xxhash64(x).alias("id1"), F.xxhash64(F.lit("second"), x).alias("id2")))
    ids = F.transform(F.filter(every, lambda z: z["counts"]), lambda z: F.struct(z["line"].alias("line"), z["id1"].alias("id1"), z["id2"].alias("id2")))
    texts = written(base.select("d", "k", ids.alias("ids")).filter("size(ids) > 0"), "line-ids")
    placed = texts.dropDuplicates(KEY).orderBy(*KEY).select("d", "k", F.size("ids").alias("n"), F.posexplode("ids").alias("pos", "id")).withColumn("g", F.monotonically_increasing_id())
    return written(placed.select("g", (F.col("g") - F.col("pos") + F.col("n")).alias("past"), "d", "k", "pos", "id.line", "id.id1", "id.id2"), "lines")


def _ranked(suffixes: DataFrame, parts: list[str], length: int) -> DataFrame:
    """(g, past, rank) of suffixes (g, past, and parts) that share their parts with another; rank is the smallest g."""
    classes = written(suffixes.groupBy(*parts).agg(F.min("g").alias("rank"), F.count("*").alias("n")).filter("n > 1").drop("n"), f"line-classes-{length}")
    return written(suffixes.join(classes, parts).select("g", "past", "rank"), f"line-ranks-{length}")


def ranks(lines: DataFrame) -> list[DataFrame]:
    """Ranks (g, past, rank) of suffixes at lengths 1, 2, 4, ... as long as any class has two suffixes."""
    out, length = [_ranked(lines.select("g", "past", "id1", "id2"), ["id1", "id2"], 1)], 1
    while not out[-1].isEmpty():
        ahead = out[-1].select((F.col("g") - length).alias("g"), F.col("rank").alias("next"))
        pairs = out[-1].filter(F.col("g") + 2 * length <= F.col("past")).join(ahead, "g").withColumnRenamed("rank", "own")
        length *= 2
        out.append(_ranked(pairs, ["own", "next"], length))
    return out[:-1]


def maximal_runs(lines: DataFrame, least: int = LEAST_LINES) -> DataFrame:
    """(g, source, length): runs of at least `least` lines that start at g and have their earliest copy at source."""
    levels = ranks(lines)
    none = lines.select("g", F.col("g").alias("source"), F.lit(0).alias("level")).limit(0)
    copies = [r.filter("rank < g").select("g", F.col("rank").alias("source"), F.lit(j).alias("level")) for j, r in enumerate(levels) if 2 << j > least]
    deepest = reduce(DataFrame.union, copies, none).groupBy("g").agg(F.max(F.struct("level", "source")).alias("top")).select("g", "top.source", "top.level")
    deepest = written(deepest, "line-copies")
    follows = deepest.select((F.col("g") + 1).alias("g"), (F.col("source") + 1).alias("source"))
    ends = [lines.select(F.col("g").alias(c), F.col("past").alias(p)) for c, p in (("g", "past"), ("source", "source_past"))]
    runs = deepest.join(follows, ["g", "source"], "left_anti").join(ends[0], "g").join(ends[1], "source")
    runs = written(runs.withColumn("length", F.expr("shiftleft(1L, level)")), "line-runs")
    for j in range(len(levels) - 2, -1, -1):
        here = levels[j].select(F.col("g").alias("at"), F.col("rank").alias("here"))
        there = levels[j].select(F.col("g").alias("from"), F.col("rank").alias("there"))
        placed = runs.filter(F.col("level") > j).withColumn("at", F.col("g") + F.col("length")).withColumn("from", F.col("source") + F.col("length"))
        same = (F.col("at") < F.col("past")) & (F.col("from") < F.col("source_past")) & (F.col("here") == F.col("there"))
        longer = placed.join(here, "at", "left").join(there, "from", "left").withColumn("length", F.col("length") + F.when(same, F.lit(1 << j)).otherwise(0))
        runs = written(runs.filter(F.col("level") <= j).unionByName(longer.drop("at", "from", "here", "there")), f"line-runs-{j}")
    return runs.filter(F.col("length") >= least).select("g", "source", "length")


def remove_repeated_lines(docs: DataFrame, least: int = LEAST_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, removed, kept): removed are numbers of lines from 0, kept is the text without them."""
    base = documents(docs, id_col, text_col).select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), F.xxhash64("doc_id", "text").alias("k"), "text")
    lines = line_ids(base.select("d", "k", "text"))
    runs = maximal_runs(lines, least).join(lines.select("g", "d", "k", "pos"), "g")
    before = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("to", F.col("pos") + F.col("length")).withColumn("done", F.coalesce(F.max("to").over(before), F.lit(0)))
    # what runs cover, each line once and by its address: numbers of lines come from the lines' table, not from the text
    covered = runs.filter("to > done").select(F.explode(F.expr("sequence(g + greatest(pos, done) - pos, g + length - 1)")).alias("g"))
    gone = covered.join(lines.select("g", "d", "k", "line"), "g").groupBy(*KEY).agg(F.array_sort(F.collect_list("line")).alias("gone"))
    none = F.array().cast("array<int>")
    both = base.join(gone, KEY, "left").select("doc_id", "text", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1)).alias("own"), F.coalesce("gone", none).alias("removed"))
    rest = F.array_except(F.sequence(F.lit(0), F.size("own") - 1), "removed")
    kept = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(F.transform(rest, lambda i: F.get("own", i)), "\n"))
    return both.select("doc_id", F.size("own").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed", kept.alias("kept"))


SQL = """
WITH l AS (SELECT doc_id, text, unnest(CASE WHEN text = '' THEN [] ELSE string_split(text, chr(10)) END) AS line,
                  unnest(range(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END)) AS i
           FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
n AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM l WHERE trim(line) <> ''),
w AS (SELECT doc_id, pos, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM n),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM w WHERE run IS NOT NULL),
x AS (SELECT doc_id, pos FROM r WHERE nth > 1 UNION SELECT doc_id, pos + 1 FROM r WHERE nth > 1),
g AS (SELECT n.doc_id, n.i FROM n JOIN x USING (doc_id, pos)),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
             sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""
