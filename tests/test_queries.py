import inspect

import pytest

from neighborfield.params import EmbeddingParams
from neighborfield.plans import queries as q
from neighborfield.plans import scale_queries  # noqa: F401  registers its queries
from tests.conftest import SF, same_rows

#: Checked at the larger scale by the driver; here one of each family is enough.
SLOW = {"dissection_check", "perplexity_affinities", "metric_spearman", "metric_minkowski", "metric_jaccard", "metric_hamming"}


@pytest.mark.parametrize("name", sorted(set(q.ORACLE_SQL) - SLOW))
def test_matches_sql(spark, duck, name):
    same_rows(q.QUERIES[name](spark, SF), duck, q.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["pca_projection", "knn_ivf_k10", "knn_lsh_k10", "shifted_grids", "box_interpolation_2d", "source_clusters", "source_random_graph", "random_rows"])
def test_has_rows(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name, lam", [("embed_graph", 5.0), ("embed_points", 1.0)])
def test_whole_embeddings_run_with_the_default_parameters(spark, monkeypatch, name, lam):
    seen = []
    monkeypatch.setattr(q.optimizer, "optimise_one_task", lambda edges, y, p: seen.append(p) or y)
    q.QUERIES[name](spark, SF)
    assert seen == [EmbeddingParams(lam=lam)]


def test_quantised_neighbours_use_the_default_codes(spark, monkeypatch):
    seen, own = [], inspect.signature(q.knn.ivfpq_knn)

    def record(*args, **given):
        bound = own.bind(*args, **given)
        bound.apply_defaults()
        seen.append(bound.arguments["codes"])
        return q.knn.exact_knn(*args[:2])

    monkeypatch.setattr(q.knn, "ivfpq_knn", record)
    q.QUERIES["knn_ivfpq_k10"](spark, SF)
    assert seen == [256]
