"""A corpus pipeline: toxicity, exact copies, near copies, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs; all but the last return the columns of documents. Rows without a doc_id take part in no comparison by id
and are never dropped as copies. Empty texts are copies of each other. Empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neighborfield.llm import packing, simhash, suffix_merge, toxicity
from neighborfield.llm.exact_dedup import exact_duplicates
from neighborfield.llm.runtime import table, written

KEY = ["_id", "_text"]


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, _id, _text): whole rows in one column, so that no column of theirs can clash; _text is the text's SHA-256."""
    return docs.select(F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("_text"))


def _rows(keyed: DataFrame, docs: DataFrame) -> DataFrame:
    return keyed.select(*(F.col(f"row.`{n}`").alias(n) for n in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the operator's threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"), "text"), model, name="score")
    return _rows(scored.filter(F.col("score") < toxicity.THRESHOLD), docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of equal rows with one doc_id and text, one."""
    kept = written(exact_duplicates(docs).filter("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_text")).agg(F.count("*").alias("_rows")), "kept")
    keyed = _keyed(docs)
    single = keyed.join(kept.filter("_rows = 1"), KEY, "left_semi")
    repeated = keyed.join(kept.filter("_rows > 1"), KEY, "left_semi").dropDuplicates(KEY)
    return _rows(single.unionByName(repeated).unionByName(keyed.filter("_id is null")), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by five-word shingles with a similarity of 0.8 or more."""
    found = simhash.near_documents(docs)
    dropped = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_text")).distinct()
    return _rows(_keyed(docs).join(dropped, KEY, "left_anti"), docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings that start in an earlier document; n_chars follows."""
    found = suffix_merge.remove_repeats(docs, as_text=True)
    kinds = dict(docs.dtypes)

    def column(name: str):
        if name == "text":
            return F.when(F.col("row.text").isNull(), F.lit(None).cast("string")).otherwise(F.col("kept")).alias("text")
        if name == "n_chars":
            return F.when(F.col("row.n_chars").isNull() | (F.col("n_removed") == 0), F.col("row.n_chars")).otherwise(F.length("kept")).cast(kinds[name]).alias(name)
        return F.col(f"row.`{name}`").alias(name)

    return found.select(*map(column, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("toxicity", drop_toxic), ("exact-dedup", drop_exact_copies), ("simhash", drop_near_copies), ("suffix-array", cut_repeated_strings), ("packing", pack)]

#: Trained weights, XXH64 and tokenizers are not SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
