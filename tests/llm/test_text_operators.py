import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from neighborfield.llm import bpe, exact_dedup, fm_index, license_scan, line_dedup, packing, queries, simhash, suffix_merge
from neighborfield.llm.anchored import Windows, anchors
from tests.conftest import SF, same_rows
from tests.llm import helpers as h

BIG = (1 << 63) - 1
BPE, WORD = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def rows_of(docs):
    return [(BIG if r.doc_id is None else r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return h.documents(spark).persist()


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_exact_dedup", "op3_fm_index", "op4_license_scan", "op7_pivot_index", "op9_suffix_merge"])
def test_query_matches_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SF), duck, queries.ORACLE_SQL[name])


def test_lines(docs):
    plain = rows_of(docs)
    seen, gone = {}, {}
    runs = [(k, t or "", [(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(" ")]) for k, t in plain]
    for k, _, lines in runs:
        for p in range(len(lines) - 1):
            pair = (lines[p][1], lines[p + 1][1])
            seen[pair] = min(seen.get(pair, (BIG + 1, 0)), (k, p))
    for k, t, lines in runs:
        gone[k, t] = sorted({lines[q][0] for p in range(len(lines) - 1) if seen[lines[p][1], lines[p + 1][1]] < (k, p) for q in (p, p + 1)})
    found = line_dedup.remove_repeated_lines(docs).collect()
    assert len(found) == len(plain)
    texts = {k: [] for k, _ in plain}
    for k, t in plain:
        texts[k].append("\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[k, t or ""]))
    for r in found:
        assert r.kept in texts[BIG if r.doc_id is None else r.doc_id]
    assert line_dedup.remove_repeated_lines(docs.limit(0)).count() == 0


def test_line_runs_of_any_length(spark):
    import random

    r = random.Random(5)
    base = [f"line {i}" for i in range(260)]
    rows = [(0, base[:230])]
    for k, n in enumerate([2, 3, 5, 8, 31, 64, 127, 200]):
        at = r.randint(0, 230 - n)
        rows.append((k + 1, [f"own {k}", *base[at : at + n], "   ", f"end {k}", *(["same"] * (k + 2))]))
    rows += [(20, ["x"] * 150), (21, rows[3][1]), (22, ["alone"]), (23, ["alone"]), (24, rows[5][1][3:] + rows[2][1])]
    rows += [(30 + i, ["hot a", "hot b", f"tail {i % 3}", f"{i}"]) for i in range(40)]
    docs = spark.createDataFrame([(k, "\n".join(x)) for k, x in rows], "doc_id long, text string").repartition(3)
    first, want = {}, {}
    counted = {k: [(i, x) for i, x in enumerate(lines) if x.strip(" ")] for k, lines in rows}
    for k, own in counted.items():
        for p in range(len(own) - 1):
            first.setdefault((own[p][1], own[p + 1][1]), (k, p))
    for k, own in counted.items():
        want[k] = sorted({own[q][0] for p in range(len(own) - 1) if first[own[p][1], own[p + 1][1]] < (k, p) for q in (p, p + 1)})
    found = line_dedup.remove_repeated_lines(docs).collect()
    assert {x.doc_id: x.removed for x in found} == want and all(x.n_removed == len(x.removed) for x in found)
    # each run's length is its longest common prefix with an earlier source
    base = docs.select(F.col("doc_id").alias("d"), F.xxhash64("doc_id", "text").alias("k"), "text")
    lines = line_dedup.line_ids(base)
    at = {x.g: (x.d, x.pos) for x in lines.collect()}
    runs = line_dedup.maximal_runs(lines).collect()
    text = {k: [x for _, x in own] for k, own in counted.items()}
    for x in runs:
        (k, p), (j, q) = at[x.g], at[x.source]
        a, b = text[k][p:], text[j][q:]
        assert (j, q) < (k, p) and x.length == next((i for i, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b)))
    assert {200, 127, 64, 31} <= {x.length for x in runs} and len({(x.g, x.source) for x in runs}) == len(runs)


@pytest.mark.parametrize("bits", [62, 3])
def test_exact_copies_even_where_fingerprints_collide(docs, bits):
    check_exact_copies(docs, bits)


@pytest.mark.parametrize("share", [1, 12])  # no fingerprint, or some, count as hot
def test_exact_copies_of_hot_and_other_groups(docs, share, monkeypatch):
    monkeypatch.setattr("neighborfield.llm.runtime.HOT_SHARE", share)
    check_exact_copies(docs, 62)


def check_exact_copies(docs, bits):
    plain = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    found = exact_dedup.exact_duplicates(docs, fp_bits=bits).collect()
    assert len(found) == len(plain)
    for r in found:
        same = [k for k, t in plain if h.sha(t) == r.text_sha256]
        best = max((k for k in same if k is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(same), best is not None and r.doc_id == best)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_chunk_hashes_combine():
    data = np.random.default_rng(0).integers(0, 256, 20_000).astype(np.uint8)
    whole = exact_dedup.fingerprints(data, np.array([0, len(data)]), chunk=4096)[0]
    assert whole == exact_dedup.fingerprints(data, np.array([0, len(data)]), chunk=100)[0]
    for f, (prime, base) in enumerate(exact_dedup.FIELDS):
        value = lambda part, p=prime, b=base: sum((int(v) + 1) * pow(b, len(part) - 1 - i, p) for i, v in enumerate(part)) % p
        assert exact_dedup.combine(f, value(data[:50]), value(data[50:90]), 40) == value(data[:90])
    assert whole >> 31 == sum((int(v) + 1) * pow(exact_dedup.FIELDS[0][1], len(data) - 1 - i, exact_dedup.FIELDS[0][0]) for i, v in enumerate(data)) % exact_dedup.FIELDS[0][0]


@pytest.mark.parametrize(("size", "gram"), [(20, 6), (5, 5), (8, 2)])
def test_word_windows(docs, size, gram):
    found = fm_index.remove_repeats(docs, size, gram).select("row.doc_id", "n_words", "n_removed", "kept", "spans").collect()
    want = sorted(h.cut_words(rows_of(docs), size))
    assert sorted((BIG if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in found) == want
    assert all(sum(n for _, n in r.spans) == r.n_removed for r in found)
    assert fm_index.remove_repeats(docs.limit(0)).count() == 0


def test_fm_index_lengths_and_intervals():
    rng = np.random.default_rng(0)
    text, patterns = rng.integers(1, 5, 800), rng.integers(1, 5, (60, 6))
    length, lo, hi = fm_index.FMIndex(text, 6).search(patterns)
    for i in range(60):
        for k in range(6, -1, -1):
            n = sum((text[a : a + k] == patterns[i, 6 - k :]).all() for a in range(800 - k + 1)) if k else 801
            if n >= 2:
                break
        assert (length[i], hi[i] - lo[i]) == (k, n)


@pytest.mark.parametrize("size", [1, 2, 3, 6, 8])
def test_texts_streamed_against_an_fm_index(size):
    rng = np.random.default_rng(size)
    text, others = rng.integers(1, 5, 1500), rng.integers(1, 6, 400)
    text[-1] = 5
    values = rng.permutation(1500)
    index = fm_index.FMIndex(text, size, values)
    begin, windows = np.array([0, 100, 120, 390, 200]), np.array([60, 1, 33, 0, 90])
    found = {(t, w): v for part in index.stream(others, begin, windows) for t, w, v in zip(*(x.tolist() for x in part), strict=True)}
    want = {}
    for t, (b, n) in enumerate(zip(begin.tolist(), windows.tolist(), strict=True)):
        for w in range(n):
            own = others[b + w : b + w + size]
            at = [int(values[a]) for a in range(1500 - size + 1) if (text[a : a + size] == own).all()]
            if at:
                want[t, w] = min(at)
    assert found == want and found
    apart = np.arange(1, 61)
    apart[[20, 27]] = apart[[0, 7]]  # suffixes that few symbols tell apart, and whose ends agree
    for _, _, least in fm_index.FMIndex(apart, size, np.arange(60)[::-1].copy()).stream(apart, np.array([0, 20]), np.array([1, 1])):
        assert least.tolist() == ([59 - 20, 59 - 20] if size == 1 else [59, 39])
    assert index.wavelet.inside[0].dtype == np.int16 and index.wavelet.before[0].dtype == np.int32


@pytest.mark.parametrize(("size", "gram"), [(50, 24), (12, 8)])
def test_byte_windows(docs, size, gram):
    found = suffix_merge.remove_repeats(docs, size, gram).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert sorted((BIG if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == sorted(h.cut_bytes(rows_of(docs), size))
    text = suffix_merge.remove_repeats(docs, size, gram, as_text=True).select("row.lang", "row.row", "kept").collect()
    assert {r.lang for r in text} == {"en"} and {r.row for r in text} == {"clash"}
    assert suffix_merge.remove_repeats(docs.limit(0)).count() == 0


def test_ids_of_narrow_types(docs):
    narrow = docs.select(F.col("doc_id").cast("int").alias("doc_id"), "text")
    for remove, size, plain, column in ((fm_index.remove_repeats, 20, h.cut_words, 2), (suffix_merge.remove_repeats, 50, h.cut_bytes, 2)):
        found = remove(narrow, size).select("row.doc_id", "n_removed").collect()
        assert sorted((BIG if r.doc_id is None else r.doc_id, r.n_removed) for r in found) == sorted((r[0], r[column]) for r in plain(rows_of(docs), size))


def test_merge_is_sorted_and_knows_prefixes():
    import random

    r = random.Random(1)
    runs = [sorted({bytes(r.choice(b"ab") for _ in range(r.randint(1, 9))) for _ in range(40)}) for _ in range(6)]
    out = list(suffix_merge.merge([suffix_merge.front_decoded(*suffix_merge.front_coded(k)) for k in runs]))
    assert [k for k, _, _ in out] == sorted(k for run in runs for k in run)
    assert all(b[1] == suffix_merge.shared(a[0], b[0]) for a, b in zip(out, out[1:], strict=False))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 101, 90).astype(np.uint8)
    a, b = np.concatenate([rng.integers(97, 123, 333).astype(np.uint8), passage]), np.concatenate([passage, rng.integers(97, 123, 77).astype(np.uint8)])
    w = Windows(50, 24)
    hashes = lambda x, lo, hi: {int(v) for p, v, s, e in zip(*anchors(x, np.array([0, len(x)]), w), strict=True) if s <= hi and e >= lo}
    assert hashes(a, 333, 333 + 40) & hashes(b, 0, 40) == hashes(b, 0, 40)


def test_license_places_and_labels(docs):
    found = license_scan.scan(docs).collect()
    plain = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = []
    for k, t in plain:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = {label: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p, label in license_scan.PHRASES.items()}
        every = sorted(i for x in at.values() for i in x)
        want.append((-1 if k is None else k, len(w), len(every), every[0] if every else -1, every[-1] if every else -1, ",".join(sorted(x for x, v in at.items() if v))))
    none = lambda v: -1 if v is None else v
    assert sorted((none(r.doc_id), r.n_words, r.n_base, none(r.first_word), none(r.last_word), r.base_labels) for r in found) == sorted(want)
    assert any("notice-mit" in r.labels for r in found) and all(0 <= r.score <= 1 for r in found)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_bpe_matches_the_library_and_decodes(docs):
    import tiktoken

    ranks = bpe.read_ranks(BPE)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    both = bpe.decode(bpe.encode(docs, BPE, public_tokenizers.PATTERN), BPE).collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, library.encode_ordinary(r.text or "")) for r in docs.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in both) == want
    assert all(bytes(r.raw) == library.decode_bytes(list(r.ids)) for r in both)
    assert bpe.encode(docs.limit(0), BPE, public_tokenizers.PATTERN).count() == 0
    encoder = bpe.BytePairEncoder(ranks, public_tokenizers.PATTERN)
    for text in ("a" * 3000, "thequickbrownfox" * 200):
        assert encoder.merge(text.encode()) == library.encode_ordinary(text)


def odd_texts(n, seed):
    import random

    r = random.Random(seed)
    parts = ["*", ">", "ª", "b", "½", "_", " ", "\x00", "\n", "\t", "\r", "\v", "\f", "\xa0", "\u2003", "\u3000", "\x85", "\x1c", "'s", "'", "é", "日", "1", "²", ".", ",", "the", " and", "  ", "\ufdd0", "\U00010000", "😀", "\u200b", "e\u0301", "X", "<|", "<|startoftext|>"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(n)]


def test_bpe_of_odd_texts_alone_and_together():
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BPE), special_tokens={})
    encoder, remembered = bpe._loaded(BPE, public_tokenizers.PATTERN)
    texts = ["*>", "ªb", "½_", " \x00", "a" * 200_000, *odd_texts(6000, 1)]
    want = [library.encode_ordinary(t) for t in texts]
    for t, ids in zip(texts, want, strict=True):
        assert bpe.encode_texts([t], encoder, bpe.Remembered(4))[0].tolist() == ids, t  # nothing is known yet
        assert bpe.encode_texts([t], encoder, remembered)[0].tolist() == ids, t
    ids, at = bpe.encode_texts(texts, encoder, bpe.Remembered(100))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_tokens_of_odd_texts_and_of_a_tokenizer_without_short_cuts():
    from tokenizers import Tokenizer

    texts = [*odd_texts(6000, 2), "word, word. Word " * 30_000]
    for path, cut in ((WORD, True), (public_tokenizers.path("byte_bpe_50k.json"), False)):
        plain = Tokenizer.from_file(path)
        ids, at = packing.token_ids(texts, path)
        assert (packing._tokenizer(path)[1] is not None) == cut
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_places_every_id_once(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    base = docs.dropDuplicates(["doc_id"]).filter("doc_id is not null").persist()
    found = packing.pack_documents(base, WORD, 2, window=128).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, t in base.select("doc_id", "text").collect():
        raw, at = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes(), 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(raw[4 * at : 4 * (at + r.length)]), len(raw) // 4)
            at += r.length
        assert at == len(raw) // 4
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    assert packing.pack_documents(docs, WORD, 2, window=128).count() == packing.cut(docs, WORD, 2, 128).count()
    assert packing.pack_documents(docs.limit(0), WORD, 2).count() == 0


def test_plan_uses_each_length_and_pads_little():
    counts = np.zeros(257, np.int64)
    for x in np.random.default_rng(0).integers(1, 257, 5000):
        counts[x] += 1
    made = packing.plan(counts, 256)
    used = np.zeros(257, np.int64)
    for lengths, times in made:
        assert sum(lengths) <= 256 and times > 0
        np.add.at(used, list(lengths), times)
    assert (used == counts).all()
    assert (counts * np.arange(257)).sum() / (256 * sum(t for _, t in made)) > 0.98
    x = packing.nnls([(0,), (0, 1), (1, 1)], np.array([3.0, 4.0]))
    assert (x >= 0).all() and abs(x[0] + x[1] - 3) < 1e-2 and abs(x[1] + 2 * x[2] - 4) < 1e-2


def test_simhash_matches_brute_force(docs):
    found = simhash.near_duplicates(docs).collect()

    def fingerprint(text):
        w = h.words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not w:
            return 0
        s = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in s) > len(s))

    plain = [(r.doc_id, fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    points = sorted({f for _, f in plain})
    root = h.components(points, [(a, b) for i, a in enumerate(points) for b in points[:i] if (a ^ b).bit_count() <= 2])
    least = {}
    for k, f in plain:
        if k is not None:
            least[root[f]] = min(least.get(root[f], k), k)
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, r.component_id) for r in found) == sorted((str(k), f, least.get(root[f])) for k, f in plain)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_vantage_point_trees_lose_no_link():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    near = x[:700] ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64))
    dense = np.unique((np.uint64(1) << rng.integers(0, 12, 300).astype(np.uint64)) | (np.uint64(1) << rng.integers(0, 12, 300).astype(np.uint64)))
    points = np.unique(np.concatenate([x, near, dense]))
    i, j = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2, 1))
    want = h.components(points.tolist(), zip(points[i].tolist(), points[j].tolist(), strict=True))
    links = []
    for _, own in simhash.route(points, simhash.top_tree(points, 12, 2), 2):
        a, b = simhash.leaf_links(own, 2, 32)
        links += zip(a.tolist(), b.tolist(), strict=True)
    assert h.components(points.tolist(), links) == want


def test_long_chains_are_one_component(spark):
    from neighborfield.llm.components import components

    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 99), (99, 100), (7, 7)], "a long, b long"))
    assert {r.node: r.root for r in components(edges).collect()} == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}
    assert components(edges.limit(0)).count() == 0


def test_lines_of_a_very_long_document_take_linear_time(spark):
    import time

    n = 200_000
    lines = [f"line {i % 150_000}" for i in range(n)]  # the last 50,000 repeat the first
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "line 5\nline 6\n\nown")], "doc_id long, text string")
    line_dedup.remove_repeated_lines(docs.filter("doc_id = 2")).count()
    began = time.time()
    found = {r.doc_id: r for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert time.time() - began < 120  # 51,000 lines took as long when a removed line cost a look at the whole document
    assert (found[1].n_lines, found[1].n_removed) == (n, 50_000) and found[1].kept == "\n".join(lines[:150_000])
    assert found[2].removed == [0, 1] and found[2].kept == "\nown"
