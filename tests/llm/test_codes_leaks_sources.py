import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from neighborfield.llm import decontaminate, queries, source_audit, vector_codes
from neighborfield.llm.runtime import looked_up
from tests.conftest import SF, same_rows

WORD, TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_decontaminate", "op13_source_audit"])
def test_query_matches_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SF), duck, queries.ORACLE_SQL[name])


def test_lookups_of_hot_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(5000)], "i long, k string")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    found = looked_up(rows, counts, ["k"], "n", 5000).collect()
    assert len(found) == 5000 and all(r.n == (3333 if r.k == "hot" else 1) for r in found)


@pytest.mark.parametrize("share", [1, 6])
def test_codes_of_parts_that_are_not_hot(spark, share, monkeypatch):
    monkeypatch.setattr("neighborfield.llm.runtime.HOT_SHARE", share)
    rows = [(i, [float(i % 3), float(i), 1.0, -float(i % 7)], i % 2) for i in range(40)]
    found = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=8)[0]
    assert sorted(map(repr, ((r.codes, r.error, r.label_error, r.codebooks_sha256) for r in found.collect()))) == sorted(map(repr, plain_codes(rows, entries=8).values()))


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """{row: (codes, error, label error)} and {width: books} by the definition, in Python's integers."""
    kept = [(n, k, x, [int(np.floor(1024 * c)) for c in v]) for n, (k, v, x) in enumerate(rows) if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out, books = {}, {}
    for width in {len(v) for *_, v in kept}:
        own = [(n, k, x, v + [0] * (-width % parts)) for n, k, x, v in kept if len(v) == width]
        size = len(own[0][3]) // parts
        cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for *_, v in own]
        first = sorted(range(len(own)), key=lambda i: (own[i][1] is None, own[i][1] or 0, own[i][3]))[:entries]
        book = [[cut[i][p] for i in first] for p in range(parts)]
        nearest = lambda x, b: min((sum((s - t) ** 2 for s, t in zip(x, e, strict=True)), j) for j, e in enumerate(b))[::-1]
        for _ in range(rounds):
            for p in range(parts):
                sums = defaultdict(list)
                for c in cut:
                    sums[nearest(c[p], book[p])[0]].append(c[p])
                book[p] = [[sum(z) // len(z) for z in zip(*sums[j], strict=True)] if j in sums else e for j, e in enumerate(book[p])]
        for (n, _, x, _), c in zip(own, cut, strict=True):
            found = [nearest(c[p], book[p]) for p in range(parts)]
            out[n] = ([j for j, _ in found], sum(e for _, e in found), x)
        books[width] = hashlib.sha256(",".join(str(z) for p in book for e in p for z in e).encode()).hexdigest()
    labels = Counter()
    for _, e, x in out.values():
        labels[x] += e
    return {n: (codes, e, labels[x], books[len(rows[n][1])]) for n, (codes, e, x) in out.items()}


def test_vector_codes_match_the_definition(spark):
    rng = np.random.default_rng(0)
    rows = [(i * 3 % 97, (rng.integers(-3, 4, 8) / 64 + rng.integers(0, 2, 8) / 3).tolist(), [0, 1, None][i % 3]) for i in range(97)]
    rows += [(500 + i, [0.25] * 8, 0) for i in range(60)]  # a hot part; many ties between entries
    rows += [rows[3], rows[3], (None, [0.5] * 8, 1), (None, [-0.5] * 8, None), (300, None, 1), (301, [None] + [1.0] * 7, 1), (302, [float("nan")] * 8, 1), (303, [float("-inf")] * 8, 1)]
    rows += [(i, rng.normal(size=5).tolist(), 2) for i in range(600, 640)] + [(700, [], 2), (701, [], None)]
    df = spark.createDataFrame([(*r, n, "clash") for n, r in enumerate(rows)], "vec_id long, embedding array<double>, label int, r long, part string").repartition(5)
    want = sorted(map(repr, plain_codes(rows, entries=16).values()))
    found, books = vector_codes.compress(df, entries=16)
    assert sorted(map(repr, ((r.codes, r.error, r.label_error, r.codebooks_sha256) for r in found.collect()))) == want
    assert {w: b.shape for w, b in books.items()} == {0: (4, 2, 0), 5: (4, 16, 2), 8: (4, 16, 2)}
    assert vector_codes.compress(df.limit(0))[0].count() == 0
    few, _ = vector_codes.compress(df.filter("vec_id < 10"))  # fewer vectors than entries: each is its own entry
    assert few.agg(F.sum("error")).first()[0] == 0


def test_codes_of_very_large_components(spark):
    df = spark.createDataFrame([(i, [1e30 * s, 15000.0 + i, -3.0, 0.0], 1) for i, s in enumerate((1, -1, 1, -1))], "vec_id long, embedding array<double>, label int")
    found = vector_codes.compress(df, entries=2)[0].orderBy("vec_id").collect()
    assert [r.codes[0] for r in found] == [0, 1, 0, 1] and found[0].error == 512 * 512  # the second part: centres half way between two


def plain_leaks(docs, items, size=10):
    """(doc_id, n_words, hit words, item ids) by the definition."""
    windows = defaultdict(set)
    for k, t in items:
        w = WORD.findall(lowered(t))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(k)
    out = []
    for k, t in docs:
        w, hit, found = WORD.findall(lowered(t)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((k, len(w), tuple(sorted(hit)), tuple(sorted(str(x) for x in found if x is not None))))
    return out


@pytest.mark.parametrize("shard, piece, stretch", [(1 << 21, 20_000, 512), (300, 25, 16)])
def test_leaks_match_brute_force(spark, monkeypatch, shard, piece, stretch):
    for name, value in (("SHARD_BYTES", shard), ("PIECE_WORDS", piece), ("STRETCH", stretch), ("TEXT_BYTES", 5000)):
        monkeypatch.setattr(decontaminate, name, value)
    import random

    r = random.Random(2)
    vocabulary = ["a", "B", "né", "x1", "word", "longerword", "日本", "z" * 40]
    text = lambda n: r.choice([" ", "\n", ", ", "--"]).join(r.choice(vocabulary) for _ in range(n))
    items = [(1, text(30)), (2, text(12)), (3, "Only Three words!"), (4, ""), (5, None), (None, text(15)), (6, "unusual"), (7, "w " * 60), (2, text(11)), (10, text(200))]
    items.append((8, items[0][1]))
    docs = [(i, text(r.choice([0, 1, 9, 60]))) for i in range(60)]
    for i, (_, t) in enumerate(items):
        docs += [(100 + i, f"{text(5)}. {t} {text(3)}"), (200 + i, "x" + (t or ""))]
    docs += [(300, "only, three WORDS"), (301, "only three"), (302, "wordsonly three words only"), (303, ""), (304, None), (305, "unusualx unusual"), (None, items[1][1]), docs[0], docs[0], (306, " ".join([items[0][1]] * 2) + " long" * 5000)]
    df = spark.createDataFrame([(*d, k, "clash") for k, d in enumerate(docs)], "doc_id long, text string, n_words int, items string").repartition(3)
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, piece int").repartition(2)
    found = decontaminate.contamination(df, bench).collect()
    got = [(x.doc_id, x.n_words, tuple(k for s in x.spans for k in range(s["first"], s["last"] + 1)), tuple(x["items"])) for x in found]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_leaks(docs, items)))
    assert all(x.n_hit == len(g[2]) for x, g in zip(found, got, strict=True))
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    clean = decontaminate.contamination(df, bench.limit(0)).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(clean) == (0, len(docs))


def test_leaks_in_a_very_long_text(spark):
    item = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, "filler " * 600_000 + item), (2, "y" * 3_000_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert (found[1].n_words, found[1].n_hit, found[1]["items"]) == (600_015, 15, ["7"]) and found[1].spans[0]["first"] == 600_000
    assert (found[2].n_words, found[2].n_hit) == (1, 0)


def plain_audit(rows, least, most):
    groups, by_lang = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall(lowered(text))
        groups[lang or "", source or ""].update(terms)
        by_lang[lang or ""].update(set(terms))
    out = []
    for lang in by_lang:
        kept = sorted((t for t, n in by_lang[lang].items() if n >= least), key=str.encode)
        own = {s: [c[t] for t in kept] for (x, s), c in groups.items() if x == lang}
        p = lambda counts: [1 + 10**9 * (c + 5) // (sum(counts) + 5 * len(kept)) for c in counts]
        chances, q = {s: p(c) for s, c in own.items()}, p([sum(c) for c in zip(*own.values(), strict=True)])
        for s, a in chances.items():
            pairs = sorted(((-sum(abs(x - y) for x, y in zip(a, b, strict=True)), o.encode(), o) for o, b in chances.items() if o != s))
            terms = sorted((y - x, t.encode(), t) for t, n, x, y in zip(kept, own[s], a, q, strict=True) if n and x > y)[:most]
            out += [(lang, s, part, o, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, o) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("leaves, waiting, chunk, batch", [(300_000, 500_000, 10_000, 10_000), (20, 50, 7, 16)])
def test_audit_matches_the_definition(spark, monkeypatch, leaves, waiting, chunk, batch):
    for name, value in (("LEAVES", leaves), ("WAITING", waiting), ("CHUNK_LEAVES", chunk), ("PIECE_BYTES", 1 << 20 if leaves > 20 else 30), ("ROWS", 8192 if leaves > 20 else 5)):
        monkeypatch.setattr(source_audit, name, value)
    import random

    r = random.Random(4)
    stems = ["a", "ab", "abc", "Abd", "b", "né", "nèe", "日本", "日", "z", "ﬀ", "𝒳x", "tie", "tja"]
    rows = []
    for i in range(160):
        source = "hot" if i % 3 == 0 else r.choice(["s1", "S1", "é", None, ""])
        words = [r.choice(stems) + r.choice(["", "x", "Y"]) for _ in range(r.choice([0, 1, 20, 60]))]
        rows.append((r.choice([" ", "1", "--"]).join(words), ["en", "de", None][i % 3 if i % 2 else 0], source))
    rows += [rows[0], rows[0], (None, "en", "s1"), ("", "xx", "only"), ("few words here", "yy", "s1"), ("few", "yy", "s2"), ("12 34", "yy", None), ("long " * 20_000 + "q" * 100_000, "en", "s2")]
    df = spark.createDataFrame([(*x, k, 1) for k, x in enumerate(rows)], "text string, lang string, source string, n int, terms int").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = sorted(map(tuple, source_audit.divergences(df, least=4, most=6).select("lang", "source", "part", "item", "value", "rank").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == plain_audit(rows, 4, 6)
    assert {x for x in found if x[0] == "yy"} and all(x[4] == 0 for x in found if x[0] == "yy")
    assert source_audit.divergences(df.limit(0)).count() == 0


def test_trie_keeps_order_and_numbers():
    terms = sorted({w.encode() for w in "a ab abc abd b ba née nè n 日 日本 z".split()})
    trie = source_audit.RadixTrie()
    trie.insert(terms[::2], list(range(0, len(terms), 2)))
    trie.insert(terms[1::2], list(range(1, len(terms), 2)))
    assert list(trie.walk()) == [(t, k) for k, t in enumerate(terms)]


def test_chances_are_exact_beyond_64_bits():
    count = np.array([[10**11, 3], [0, 10**12]], np.int64)
    total = count.sum(0)
    want = [[1 + 10**9 * (int(c) + 5) // (int(n) + 10) for c, n in zip(row, total, strict=True)] for row in count]
    assert source_audit.scaled(count, total, 2).tolist() == want


