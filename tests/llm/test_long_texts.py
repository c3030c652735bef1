"""Texts of four megabytes beside short ones, for every operator on documents."""

import random

import pytest
from pyspark.sql import functions as F

from neighborfield.llm import exact_dedup, fm_index, license_scan, packing, simhash, source_audit, suffix_merge
from tests.llm import helpers as h

SIZE = 4_000_000


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    return " ".join(r.choice(vocabulary) for _ in range(SIZE // 6))[:SIZE]


@pytest.fixture(scope="module")
def docs(spark, long_text):
    rows = [(1, long_text), (2, "short"), (3, long_text), (4, long_text[:-4] + " MIT License"), (5, None), (6, "y" * SIZE)]
    return spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string").repartition(3).persist()


def test_exact_copies(docs):
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert found == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1), 5: (5, 1), 6: (6, 1)}


def test_word_windows(docs, long_text):
    found = {r.doc_id: r for r in fm_index.remove_repeats(docs.select("doc_id", "text")).select("row.doc_id", "n_words", "n_removed", "kept").collect()}
    n = len(h.words(long_text))
    assert (found[1].n_words, found[1].n_removed, found[3].n_removed, bytes(found[3].kept)) == (n, 0, n, b"")
    assert found[4].n_removed >= n - 3 and found[6].n_words == 1


def test_repeated_strings(docs):
    found = {r.doc_id: r for r in suffix_merge.remove_repeats(docs.select("doc_id", "text")).select("row.doc_id", "n_bytes", "n_removed", "n_spans").collect()}
    assert (found[1].n_removed, found[3].n_removed, found[3].n_spans, found[6].n_removed) == (0, SIZE, 1, 0)
    assert found[4].n_removed in (SIZE - 4, SIZE - 3) and found[5].n_bytes == 0


def test_licenses(docs):
    found = {r.doc_id: r for r in license_scan.scan(docs.filter("doc_id <> 3")).collect()}
    assert found[4].base_labels == "mit" and found[1].base_labels == "" and found[6].n_words == 1


def test_fingerprints(docs):
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, words=3, radius=2).collect()}
    assert found == {1: 1, 3: 1, 4: 1, 2: 2, 5: 5, 6: 6}


def test_packed_pieces(docs):
    import public_tokenizers

    found = packing.pack_documents(docs.filter("doc_id in (1, 2, 5)"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    sums = {r.doc_id: (r.n, r.most) for r in found.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("most")).collect()}
    assert all(n == most for n, most in sums.values()) and sums[5] == (1, 1) and sums[1][0] > 500_000


def test_terms(docs, long_text):
    leaves, groups = source_audit.kept_leaves(docs, 1)
    counts = {r.term.decode(): r.counts[0] for r in leaves.filter(F.length("term") < 20).collect()}
    word = long_text[:200].split()[3]
    assert counts[word] == sum(h.words(t).count(word) for t in (long_text, long_text, long_text[:-4])) and groups.count() == 1
    assert leaves.filter(F.length("term") == SIZE).count() == 1
