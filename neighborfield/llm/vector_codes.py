"""Product codes of vectors: equal parts become weighted distinct rows, Lloyd runs over these, codes are joined back.

A component x becomes the integer floor(scale * x). A vector is cut into `parts` equal consecutive parts; a part that many
vectors share is one row (width, part, value, weight), so that a round costs as much as there are different parts. Each
round assigns every different part to its codebook's nearest entry and replaces an entry by the floor of its parts'
weighted mean; tasks send one sum for each entry and component. The codes and errors of the different parts are joined
back to the vectors by value. A part that more than a thousandth of all vectors have (there are fewer than a thousand
of these at each position) is looked up in the task, all others meet in a shuffle; so no hot value reaches one task. The
errors of a label are treated alike.

All arithmetic is on integers. Equally near entries: the lower index. An entry that nothing is assigned to stays. A
codebook starts as that part of the `entries` vectors with the smallest ids (null last; equal ids: by the vector); fewer
vectors give fewer entries.

Dropped: vectors that are null or hold a null or a component that is not finite. Repeated rows all count and all come
out. Vectors of different lengths have codebooks of their own (a few jobs for each length); a length that `parts` does not
divide is filled with zeros, an empty vector has the code of zeros and no error. Scaled components beyond 2^24 in
magnitude are set to that bound, so that sums of squares fit in 64 bits. Null labels are one label. An empty table gives
no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborfield.llm.runtime import looked_up, releasing, small_batches, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
MOST = 1 << 24
KEY = ["width", "part", "value"]
Books = dict[int, np.ndarray]


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and sizes."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, exactly; ties to the lower index."""
    index, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    exact = 4 * most * most * max(1, x.shape[1]) < 1 << 53  # then doubles hold every term and sum
    other, square = book.T.astype(np.float64), (book * book).sum(1).astype(np.float64)
    for lo in range(0, len(x), 2048):
        own = x[lo : lo + 2048]
        if exact:
            d2 = square - 2.0 * (own.astype(np.float64) @ other)
        else:
            d2 = np.stack([((own - entry) ** 2).sum(1) for entry in book], 1)
        at = d2.argmin(1)
        index[lo : lo + 2048], error[lo : lo + 2048] = at, ((own - book[at]) ** 2).sum(1)
    return index, error


def grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(width, part, numbers of rows, their values as a matrix) of a batch."""
    width, part = batch["width"].to_numpy(), batch["part"].to_numpy()
    values, sizes = lists(batch["value"])
    at = np.cumsum(sizes) - sizes
    pairs, own = np.unique(np.stack([width, part], 1), axis=0, return_inverse=True)
    for k, (w, p) in enumerate(pairs.tolist()):
        rows = np.flatnonzero(own.reshape(-1) == k)
        size = int(sizes[rows[0]])
        yield w, p, rows, values[at[rows][:, None] + np.arange(size)]


def part_sums(books: Books):
    """Of each entry and component the weighted sum, and of each entry the weight: one row a task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            weight = batch["weight"].to_numpy()
            for width, part, rows, x in grouped(batch):
                book = books[width][part]
                total = totals.setdefault((width, part), np.zeros((len(book), book.shape[1] + 1), np.int64))
                entry, _ = nearest(x, book)
                np.add.at(total, entry, np.concatenate([x, np.ones((len(x), 1), np.int64)], 1) * weight[rows, None])
        for (width, part), total in totals.items():
            entry, m = np.nonzero(np.broadcast_to(total[:, -1:] > 0, total.shape))
            n = len(entry)
            yield pa.RecordBatch.from_arrays([np.full(n, width, np.int32), np.full(n, part, np.int32), entry.astype(np.int32), m.astype(np.int32), total[entry, m]], names=["width", "part", "entry", "m", "total"])

    return releasing(run)


def part_codes(books: Books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for width, part, rows, x in grouped(batch):
                code[rows], error[rows] = nearest(x, books[width][part])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*KEY, "weight")), code, error], names=[*KEY, "weight", "code", "part_error"])

    return releasing(run)


def start_books(kept: DataFrame, parts: int, entries: int) -> Books:
    """{width: entries by (part, entry, component)}; at most `entries` vectors of each width come to the driver."""
    out = {}
    for (width,) in kept.select("width").distinct().collect():
        rows = kept.filter(F.col("width") == width).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        own = np.array([r.v for r in rows], np.int64).reshape(len(rows), parts, -1)
        out[width] = own.transpose(1, 0, 2)
    return out


def lloyd(distinct: DataFrame, books: Books, rounds: int) -> Books:
    """The codebooks after so many rounds over weighted distinct parts (width, part, value, weight)."""
    for _ in range(rounds):
        tasks = distinct.mapInArrow(part_sums(books), "width int, part int, entry int, m int, total long")
        found = tasks.groupBy("width", "part", "entry", "m").agg(F.sum("total").alias("total")).collect()  # a codebook's size
        sums = {w: np.zeros((*b.shape[:2], b.shape[2] + 1), np.int64) for w, b in books.items()}
        for r in found:
            sums[r.width][r.part, r.entry, r.m] = r.total
        books = {w: np.where(sums[w][:, :, -1:] > 0, sums[w][:, :, :-1] // np.maximum(sums[w][:, :, -1:], 1), b) for w, b in books.items()}
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Books]:
    """(vec_id, codes, error, label_error, codebooks_sha256) for each kept row, and the codebooks."""
    small_batches(vectors.sparkSession)
    label = F.col(f"`{label_col}`").cast("string")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.coalesce(label, F.lit("")).alias("label"), label.isNull().alias("unlabelled"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform("x", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    filled = F.concat(whole, F.array_repeat(F.lit(0), F.pmod(-F.size("x"), F.lit(parts))))
    kept = rows.filter(F.col("x").isNotNull() & finite).select(F.monotonically_increasing_id().alias("r"), "vec_id", "label", "unlabelled", F.size("x").alias("width"), filled.alias("v"))
    kept = written(kept, "whole-vectors")
    n = kept.count()

    size = F.expr(f"cast(size(v) div {parts} as int)")
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("v", p * size + 1, size))
    cut_up = kept.select("r", "width", F.posexplode(cut).alias("part", "value"))
    distinct = written(cut_up.groupBy(*KEY).agg(F.count("*").alias("weight")), "distinct-parts")
    books = lloyd(distinct, start_books(kept, parts, entries), rounds)
    codes = written(distinct.mapInArrow(part_codes(books), "width int, part int, value array<int>, weight long, code int, part_error long"), "part-codes")

    coded = looked_up(cut_up, codes, KEY, "weight", n).groupBy("r").agg(F.sort_array(F.collect_list(F.struct("part", "code"))).alias("codes"), F.sum("part_error").alias("error"))
    own = written(kept.select("r", "vec_id", "label", "unlabelled", "width").join(coded, "r"), "vector-codes")
    labels = written(own.groupBy("label", "unlabelled").agg(F.sum("error").alias("label_error"), F.count("*").alias("members")), "label-errors")
    hashes = {w: hashlib.sha256(",".join(map(str, b.reshape(-1).tolist())).encode()).hexdigest() for w, b in books.items()}
    named = F.coalesce(*(F.when(F.col("width") == w, F.lit(h)) for w, h in hashes.items()), F.lit("")) if hashes else F.lit("")
    out = looked_up(own, labels, ["label", "unlabelled"], "members", n)
    return out.select("vec_id", F.transform("codes", lambda c: c["code"]).alias("codes"), "error", "label_error", named.alias("codebooks_sha256")), books


def _sql(rounds: int = ROUNDS) -> str:
    floor = "((s - ((s % n + n) % n)) // n)"
    nearest_entry = "min((list_inner_product(x::DOUBLE[], x::DOUBLE[]) - 2 * list_inner_product(x::DOUBLE[], y::DOUBLE[]) + list_inner_product(y::DOUBLE[], y::DOUBLE[]))::BIGINT * 256 + e)"
    steps = "".join(
        f""",
a{k} AS MATERIALIZED (SELECT part, x, any_value(n) AS n, {nearest_entry} % 256 AS e FROM d JOIN c{k} USING (part) GROUP BY part, x),
s{k} AS (SELECT part, e, i, sum(n) AS n, sum(n * z) AS s FROM (SELECT part, e, n, unnest(x) AS z, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY part, e, i),
u{k} AS (SELECT part, e, list({floor}::BIGINT ORDER BY i) AS y FROM s{k} GROUP BY part, e),
c{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(u{k}.y, c{k}.y) AS y FROM c{k} LEFT JOIN u{k} USING (part, e))"""
        for k in range(rounds)
    )
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS x FROM k, range(4) AS q(part)),
d AS MATERIALIZED (SELECT part, x, count(*) AS n FROM p GROUP BY part, x),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM k QUALIFY e < 256),
c0 AS MATERIALIZED (SELECT part, e, x AS y FROM p JOIN f USING (r)){steps},
z AS (SELECT part, x, {nearest_entry} AS b FROM d JOIN c{rounds} USING (part) GROUP BY part, x),
o AS (SELECT r, lower(string_agg(lpad(hex(b % 256), 2, '0'), '' ORDER BY part)) AS code, sum(b // 256)::BIGINT AS error FROM p JOIN z USING (part, x) GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, e, i)) FROM (SELECT part, e, unnest(y) AS v, generate_subscripts(y, 1) AS i FROM c{rounds})) AS codebooks_sha256
FROM k JOIN o USING (r)
"""


SQL = _sql()
