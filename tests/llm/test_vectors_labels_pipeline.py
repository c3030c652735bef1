import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from neighborfield.llm import pivot_index, toxicity
from tests.conftest import SF
from tests.llm import helpers as h


def brute(rows, threshold=0.93):
    """{vec_id: (links, component)} for distinct rows (vec_id, vector, label)."""
    good = [(k, np.array(v, float), x) for k, v, x in rows if k is not None and x is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = [(a[0], b[0]) for i, a in enumerate(good) for b in good[:i] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= threshold]
    root = h.components([k for k, _, _ in rows if k is not None], links)
    return {k: (sum(k in x for x in links), root[k]) for k in root}


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 8))
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(np.concatenate([base, base[:30] + 0.05 * rng.normal(size=(30, 8)), np.tile(base[0], (5, 1)) * 2]))]
    rows += [(200, None, 0), (201, [0.0] * 8, 0), (202, [float("nan")] + [1.0] * 7, 0), (203, [None] + [1.0] * 7, 0), (204, base[0].tolist(), None), (205, base[0].tolist()[:5], 0), (206, [], 0), (207, [1e300] * 8, 1), (208, [2e300] * 8, 1)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)] + [(None, base[0].tolist(), 0, 1), (*rows[0], 9)], "vec_id long, embedding array<double>, label int, rep int")
    found = pivot_index.near_vectors(df, shared=1).collect()
    want = brute(rows[:-2]) | {207: (1, 207), 208: (1, 207)}
    assert len(found) == len(rows) + 2
    for r in found:
        assert (r.n_links, r.component_id) == ((0, None) if r.vec_id is None else want[r.vec_id])
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
    assert pivot_index.near_vectors(df.limit(0)).count() == 0


def test_index_recall_near_the_threshold(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = rng.uniform(0.93, 0.95, (1500, 1))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([base, c * base + np.sqrt(1 - c * c) * other]))], "vec_id long, embedding array<double>, label int")
    assert pivot_index.near_vectors(df).agg(F.sum("n_links")).first()[0] >= 0.9 * 3000


def test_long_lists_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(i, (np.ones(8) + 0.05 * rng.normal(size=8)).tolist(), 1) for i in range(80)]
    want = brute(rows)
    found = pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shared=1).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == want


@pytest.mark.parametrize("n, noise", [(80, 0.05), (2, 0.001), (40, 0.3)])
def test_few_pivots_lose_no_link(spark, n, noise):
    rng = np.random.default_rng(3)
    rows = [(i, (np.ones(8) + noise * rng.normal(size=8)).tolist(), 1) for i in range(n)]
    found = pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = brute(rows)
    assert any(links for links, _ in want.values())
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == want


@pytest.mark.parametrize("n, width, mean", [(200, 32, 2.0), (400, 64, 1.0), (600, 16, 0.5)])
def test_recall_where_all_vectors_lean_one_way(spark, n, width, mean):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n, width)) + mean
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([base, base + 0.02 * rng.normal(size=base.shape)]))]
    found = {r.vec_id: r.n_links for r in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = {k: links for k, (links, _) in brute(rows).items()}
    assert sum(found.values()) >= 0.9 * sum(want.values()) > 0 and all(found[k] <= want[k] for k in want)


def test_vectors_of_several_widths_and_ties(spark):
    rng = np.random.default_rng(9)
    rows = []
    for width in (4, 12, 12, 40):
        base = rng.normal(size=(60, width))
        rows += [(len(rows) + i, v.tolist(), i % 2) for i, v in enumerate(np.concatenate([base, base + 0.02 * rng.normal(size=base.shape)]))]
    rows += [(1000 + i, np.eye(8)[i % 8].tolist(), 0) for i in range(24)]  # equally near to many pivots
    found = {r.vec_id: (r.n_links, r.component_id) for r in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = brute(rows)
    assert sum(n for n, _ in found.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert all(found[1000 + i] == (2, 1000 + i % 8) for i in range(24))


def test_toxic_words_are_learned_and_held_out_rows_are_not_used(spark):
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(1200):
        words = list(rng.choice(vocabulary, 60))
        toxic = i % 8 == 0
        if toxic:
            words[7:7] = [f"grob{rng.choice(vocabulary)[:3]}" if i % 16 else "idiot"] * 3
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (None, "idiot"), (5002, "word " * 20_000)], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, known)).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    toxic = [found[i].score >= 0.3 for i, t in labels if t and found[i].held]
    clean = [found[i].score >= 0.3 for i, t in labels if not t and found[i].held]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.02
    assert found[5000].score == found[5001].score < 0.3
    other = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, other)).collect()}
    assert all(abs(again[k] - found[k].score) < 1e-9 for k in again)
    assert toxicity.score(docs, toxicity.train(docs, known.limit(0))).filter("doc_id is null").first()["score"] > 0.3
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), known)).count() == 0


def test_label_model_discounts_voters_that_repeat_each_other():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    good = [(truth & (rng.random(4000) < 0.7)) | (~truth & (rng.random(4000) < 0.02)) for _ in range(3)]
    noise = rng.random(4000) < 0.2
    votes = np.stack([*good, *[noise] * 10], 1).astype(float)
    posterior, rates, _ = toxicity.label_model(votes, np.where(truth, 0.7, 0.3))
    hits = sum(g.astype(int) for g in good)
    odds = 0.3 / 0.7 * (0.7 / 0.02) ** hits * (0.3 / 0.98) ** (3 - hits)  # the best rule, from the true rates
    assert ((posterior > 0.5) == truth).mean() > ((odds > 1) == truth).mean() - 0.01 and np.all(rates[0][:3] > 5 * rates[1][:3])


def test_label_model_finds_factors_and_error_rates_from_agreement():
    rng = np.random.default_rng(1)
    n = 6000
    truth = rng.random(n) < 0.3

    def voter(on, off):
        return rng.random(n) < np.where(truth, on, off)

    first, label = voter(0.6, 0.05), voter(0.8, 0.1)
    echo = np.where(rng.random(n) < 0.9, first, voter(0.6, 0.05))
    votes = np.stack([first, echo, voter(0.7, 0.03), voter(0.5, 0.05), voter(0.6, 0.1), label], 1).astype(float)
    agreed = votes[:, :5].sum(1)
    posterior, rates, parent = toxicity.label_model(votes, np.where(agreed > 1, 0.9, 0.1), alone=1)
    assert {parent[0], parent[1]} in ({-1, 0}, {-1, 1}) and np.all(parent[2:] == -1)
    assert abs(rates[0, 5] - 0.8) < 0.05 and abs(rates[1, 5] - 0.1) < 0.03 and abs(rates[0, 2] - 0.7) < 0.05  # no row's truth was given
    assert ((posterior > 0.5) == truth).mean() > (votes[:, 5].astype(bool) == truth).mean() + 0.04
    once, again = (toxicity.label_model(np.repeat(votes, k, 0), np.repeat(np.where(agreed > 1, 0.9, 0.1), k), np.full(n * k, 1 / k), alone=1)[0] for k in (1, 3))
    assert np.allclose(np.repeat(once, 3), again, atol=1e-3)


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF).persist()
        out.append((name, docs, made))
        docs = made
    return out


def test_stages_keep_columns_and_only_drop(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "exact-dedup", "simhash", "suffix-array", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() <= before.count()


def five_word_shingles(text):
    w = h.words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_match_plain_versions(spark, stages):
    _, before, after = stages[0]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = before.collect()
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r, s in zip(rows, model.scores([r.text or "" for r in rows]), strict=True) if s < toxicity.THRESHOLD}
    _, before, after = stages[1]
    best = {}
    for r in before.collect():
        best[r.text or ""] = max(best.get(r.text or "", r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(best.values())
    _, before, after = stages[2]
    sets = {r.doc_id: five_word_shingles(r.text) for r in before.collect()}
    root = h.components(sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert sorted(r.doc_id for r in after.collect()) == sorted(k for k, v in root.items() if k == v)
    _, before, after = stages[3]
    cut = {k: (n, kept) for k, _, n, _, kept in h.cut_bytes([(r.doc_id, r.text) for r in before.collect()], 50)}
    for r in after.collect():
        n, kept = cut[r.doc_id]
        assert kept.decode(errors="ignore") == r.text if kept.isascii() else len(r.text.encode()) >= len(kept)
    assert {r.doc_id for r in stages[4][2].collect()} == {r.doc_id for r in after.collect()}


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    docs = h.documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        assert made.count() > 0, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    kept = corpus_pipeline.drop_exact_copies(spark, docs, SF).collect()
    assert len([r for r in kept if r.doc_id is not None]) == len({(r.doc_id, r.text) for r in kept if r.doc_id is not None})


def test_stages_keep_columns_that_clash(spark):
    names = ["_id", "_text", "_sha", "_node", "_rows", "_toxic_score", "score", "row", "kept", "n_bytes", "node", "component_id", "own id"]
    docs = h.documents(spark).drop("row").withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("int"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns and made.schema["doc_id"].dataType == docs.schema["doc_id"].dataType, name
        for r in made.select("doc_id", *(f"`{n}`" for n in names)).collect():
            assert all(r[n] == n + ("none" if r.doc_id is None else str(r.doc_id)) for n in names), name


def test_run_covers_what_is_kept(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    assert found.select("doc_id").distinct().count() == stages[3][2].count()


def test_near_copies_match_brute_force(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(2000)]
    rows = []
    for i in range(60):
        text = list(rng.choice(words, int(rng.integers(30, 400))))
        rows.append((len(rows), " ".join(text)))
        for part in (0.005, 0.015, 0.025, 0.05):  # one changed word breaks five shingles
            at = rng.choice(len(text), max(1, int(part * len(text))), replace=False)
            rows.append((len(rows), " ".join("new" + w if k in at else w for k, w in enumerate(text))))
    hub = list(rng.choice(words, 300))  # a large group of near copies
    rows += [(len(rows) + i, " ".join(hub[: 150 + i] + ["x" + str(i)] + hub[150 + i :])) for i in range(100)]
    rows += [(900, "two words"), (901, "Two  WORDS"), (902, ""), (903, " "), (904, None), (905, "two"), (906, rows[3][1])]
    sets = {k: five_word_shingles(t) for k, t in rows}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert sum(0.8 <= s < 0.9 for s in alike.values()) > 30 and sum(0.6 < s < 0.8 for s in alike.values()) > 30
    root = h.components(sets, [p for p, s in alike.items() if s >= 0.8])
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").repartition(3)
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(k for k, v in root.items() if k == v) and kept.count(None) == 1


def test_rare_long_vectors_lose_no_link(spark):
    rng = np.random.default_rng(11)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(3000, 8)))]
    tail = rng.normal(size=56) * 10
    rows += [(10_000 + k, np.concatenate([rng.normal(size=8), tail + 0.01 * rng.normal(size=56)]).tolist(), 0) for k in range(3)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [found[10_000 + k] for k in range(3)] == [(2, 10_000)] * 3
    want = brute(rows)
    assert sum(n for n, _ in found.values()) >= 0.9 * sum(n for n, _ in want.values())


def test_recall_where_pivots_are_capped(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "PIVOTS", (20, 20))
    rng = np.random.default_rng(12)
    base = rng.normal(size=(800, 24))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([base, base + 0.05 * rng.normal(size=base.shape)]))]
    found = {r.vec_id: r.n_links for r in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = {k: n for k, (n, _) in brute(rows).items()}
    assert sum(found.values()) >= 0.9 * sum(want.values()) > 0 and all(found[k] <= want[k] for k in want)


def test_near_copies_where_texts_share_a_hash(spark):
    from neighborfield.llm import simhash

    r = np.random.default_rng(21)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 500, 60)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate([*texts, *(t + " end" for t in texts[:5]), texts[0], ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = lambda df: sorted((x.doc_id, x.text_sha256, x.component_id) for x in df.collect())
    want = groups(simhash.near_documents(docs))
    assert [x[2] for x in want] == [*range(12), *range(5), 0, 18]
    assert groups(simhash.near_documents(docs, hashed=lambda t: F.pmod(F.xxhash64(t), F.lit(3)))) == want
