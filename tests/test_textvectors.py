"""Text vectors: numpy's decomposition of the same matrix, folding in, search with them, odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfrank.operators import textsearch as ts, textvectors as tv, vectors

SCHEMA = "product_id bigint, term string, weight double"


@pytest.fixture(scope="module")
def made(spark):
    """300 documents of 4 topics over 80 terms; one term stands in every document."""
    draw = np.random.default_rng(5)
    topics = draw.gamma(0.3, 1.0, (4, 80))
    dense = np.array([draw.poisson(6 * topics[i % 4]) for i in range(300)], dtype=float) * draw.uniform(0.5, 1.5, 80)
    dense[:, 0] = 1.0
    rows = [(int(i), f"t{j}", float(dense[i, j])) for i, j in zip(*dense.nonzero())]
    return dense, spark.createDataFrame(rows, SCHEMA)


def as_matrix(df, key, names):
    found = {r[0]: r[1] for r in df.select(key, "vector").collect()}
    width = len(next(iter(found.values())))
    return np.array([found.get(n, [0.0] * width) for n in names])


def test_equals_numpy(made):
    dense, weights = made
    docs, terms, values = tv.text_svd(weights, 4, rounds=6)
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(values, s[:4], rtol=1e-8)
    right = as_matrix(terms, "term", [f"t{j}" for j in range(80)])
    left = as_matrix(docs, "product_id", range(300))
    # The same subspaces, whatever the signs.
    assert np.allclose(right @ right.T, vt[:4].T @ vt[:4], atol=1e-6)
    assert np.allclose(left @ left.T, (u[:, :4] * s[:4] ** 2) @ u[:, :4].T, atol=1e-5)
    assert (right**3).sum(0).min() >= 0


def test_joins_by_shuffle_give_the_same(made, monkeypatch):
    _, weights = made
    want = tv.text_svd(weights, 3)
    monkeypatch.setattr(tv, "small_side", lambda df: df)
    got = tv.text_svd(weights.repartition(7), 3)
    assert np.allclose(as_matrix(got[0], "product_id", range(300)), as_matrix(want[0], "product_id", range(300)), atol=1e-6)


def test_a_documents_own_terms_fold_into_its_vector(made):
    _, weights = made
    docs, terms, values = tv.text_svd(weights, 4, rounds=6)
    asked = weights.filter("product_id < 20").withColumnRenamed("product_id", "query_id")
    folded = tv.fold_in(asked.union(asked.sparkSession.createDataFrame([(5, "unseen", 3.0), (99, "unseen", 1.0)], "query_id bigint, term string, weight double")), terms, len(values))
    assert folded.count() == 20
    assert np.allclose(as_matrix(folded, "query_id", range(20)), as_matrix(docs, "product_id", range(20)), atol=1e-5)
    best = vectors.dense_topk(docs, folded, 1)
    assert {r.query_id: round(r.score, 6) for r in best.collect()} == {i: 1.0 for i in range(20)}


def test_texts_of_one_topic_meet_without_shared_words(spark):
    """Documents that share no word lie near each other where a third one links their words."""
    texts = ["sofa couch", "couch settee", "sofa couch settee", "lamp bulb", "bulb light", "lamp bulb light"] * 5
    docs, _, values = tv.text_svd(ts.sparse_vectors(spark.createDataFrame(list(enumerate(texts)), "product_id bigint, text string")), 2)
    m = vectors._unit_rows(as_matrix(docs, "product_id", range(6)))
    assert len(values) == 2 and m[0] @ m[1] > 0.9 and abs(m[0] @ m[3]) < 1e-6


def test_odd_tables(spark):
    none, no_terms, values = tv.text_svd(spark.createDataFrame([], SCHEMA), 3)
    assert none.count() == no_terms.count() == len(values) == 0 and none.columns == ["product_id", "vector"]
    odd = [(1, "a", 2.0), (1, "a", 1.0), (2, "b", None), (2, None, 1.0), (None, "a", 1.0), (3, "b", float("nan")), (4, "a", 0.0), (5, "b", float("inf"))]
    docs, terms, values = tv.text_svd(spark.createDataFrame(odd, SCHEMA), 3)
    assert [round(v, 9) for v in values] == [3.0]
    assert {r.product_id: round(r.vector[0], 9) for r in docs.collect()} == {1: 3.0, 4: 0.0}
    assert {r.term: round(r.vector[0], 9) for r in terms.collect()} == {"a": 1.0}
    zero = spark.createDataFrame([(1, "a", 0.0)], SCHEMA)
    assert [x.count() for x in tv.text_svd(zero, 2)[:2]] == [0, 0]
    with pytest.raises(ValueError):
        tv.text_svd(zero, 0)
