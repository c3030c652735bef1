"""Exact duplicates by composable polynomial fingerprints.

A text's UTF-8 bytes are cut into chunks; each chunk hashes to sum(byte * base^(bytes after it in the chunk)) modulo
two primes, and hashes combine as left * base^len(right) + right, so the parts of a huge text can be hashed in any
order and on their own. Texts with equal length and fingerprint are then compared chunk by chunk: an aggregate over
(fingerprint, chunk number, chunk) leaves one row per different chunk. Fingerprints of more than a thousandth of all rows
are looked up where the texts are, so a large group of copies is never shuffled; texts of other equal fingerprints are,
once, and chunks are combined before their own shuffle. A text is hashed in one call, chunk by chunk; combine() is the rule by which
parts hashed apart would be joined. A very long text is one row. Where chunks differ under one fingerprint, the group is split by a SHA-256 of the text.

Nulls: a null text is an empty one; all empty texts are copies of each other. A null doc_id never stays when a copy
has an id; if none has, keep_id is null and the rows count as not kept. Rows that share a doc_id and a text share the
decision. Empty tables give no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborfield.llm.runtime import documents, looked_up, releasing, utf8, written

CHUNK = 4096
COMPARE_BYTES = 1 << 16
#: (prime below 2^31, base)
FIELDS = ((2147483647, 1103515245), (2147483629, 69069))


def powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += step
    return out


_POWERS = [powers(base, prime, CHUNK + 1) for prime, base in FIELDS]


def power_of(field: int, exponents: np.ndarray) -> np.ndarray:
    """base^exponent in the field."""
    prime, base = FIELDS[field]
    low, high = exponents % CHUNK, exponents // CHUNK
    big = powers(pow(base, CHUNK, prime), prime, int(high.max(initial=0)) + 1)
    return _POWERS[field][low] * big[high] % np.uint64(prime)


def combine(field: int, left: int, right: int, right_len: int) -> int:
    """The hash of two neighbouring byte strings from theirs."""
    prime, base = FIELDS[field]
    return (left * pow(base, right_len, prime) + right) % prime


def fingerprints(data: np.ndarray, at: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """A 62-bit fingerprint for each text data[at[i]:at[i+1]]."""
    lengths = np.diff(at)
    n_chunks = -(-lengths // chunk)
    doc = np.repeat(np.arange(len(lengths)), n_chunks)
    first = np.cumsum(n_chunks) - n_chunks
    starts = at[:-1][doc] + (np.arange(len(doc)) - first[doc]) * chunk
    ends = np.minimum(starts + chunk, at[1:][doc])
    out = np.zeros(len(lengths), np.uint64)
    if not len(doc):
        return out.astype(np.int64)
    hashes = np.zeros((2, len(doc)), np.uint64)
    step = max(1, (1 << 21) // chunk)  # chunks at a time: memory stays bounded
    for lo in range(0, len(doc), step):
        s, e = starts[lo : lo + step], ends[lo : lo + step]
        rest = np.repeat(e, e - s) - 1 - np.arange(s[0], e[-1])
        part = data[s[0] : e[-1]].astype(np.uint64) + np.uint64(1)
        for f, (prime, _) in enumerate(FIELDS):
            hashes[f, lo : lo + step] = np.add.reduceat(part * _POWERS[f][rest], s - s[0]) % np.uint64(prime)
    after = at[1:][doc] - ends
    has = n_chunks > 0
    for f, (prime, _) in enumerate(FIELDS):
        shifted = hashes[f] * power_of(f, after) % np.uint64(prime)
        out[has] = out[has] * np.uint64(1 << 31) + np.add.reduceat(shifted, first[has]) % np.uint64(prime)
    return out.astype(np.int64)


def _with_fingerprint(keep_text: bool, first_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b["text"])
            fp = fingerprints(data, at) & ((1 << first_bits) - 1)
            rest = [b["text"]] if keep_text else [b["doc_id"], b["text_sha256"]]
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(at)), pa.array(fp), *rest], names=["n_bytes", "fp", *(["text"] if keep_text else ["doc_id", "text_sha256"])])

    return releasing(run)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fp_bits: int = 62) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row; of equal texts the largest id stays.

    fp_bits: fewer bits only make the comparison of chunks split more groups; results stay the same."""
    base = documents(docs, id_col, text_col)
    rows = written(base.select("doc_id", "text", F.sha2("text", 256).alias("text_sha256")).mapInArrow(_with_fingerprint(False, fp_bits), "n_bytes long, fp long, doc_id long, text_sha256 string"), "fingerprints")
    key = ["n_bytes", "fp"]
    total = rows.count()
    repeated = written(rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1 and n_bytes > 0"), "repeated")
    texts = base.select("text").mapInArrow(_with_fingerprint(True, fp_bits), "n_bytes long, fp long, text string")
    pieces = (
        looked_up(texts, repeated, key, "n", total)
        .select(*key, F.col("text").cast("binary").alias("raw"))
        .select(*key, "raw", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n_bytes - 1) div {COMPARE_BYTES} as int)"))).alias("chunk"))
        .select(*key, "chunk", F.expr(f"substring(raw, chunk * {COMPARE_BYTES} + 1, {COMPARE_BYTES})").alias("piece"))
    )
    differing = written(pieces.groupBy(*key, "chunk", "piece").agg(F.lit(1).alias("one")).groupBy(*key, "chunk").agg(F.count("*").alias("n")).filter("n > 1").select(*key).distinct().withColumn("differs", F.lit(True)), "differing")
    rows = written(rows.join(differing, key, "left").withColumn("sub", F.when(F.col("differs"), F.col("text_sha256")).otherwise("")).drop("differs"), "compared")
    groups = written(rows.groupBy(*key, "sub").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "copies")
    found = looked_up(rows, groups, [*key, "sub"], "group_size", total)
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
