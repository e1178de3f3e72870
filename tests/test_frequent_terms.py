"""The most frequent terms are found without a shuffle of all terms."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from plumbline.operators import vectors
from plumbline.operators.vectors import document_words, frequent_terms, term_counts, tfidf


def _texts(spark, n=120):
    rng = random.Random(5)
    pick = lambda k: f"w{int(300 ** rng.random())}" if k % 3 else f"rare{rng.randrange(4000)}"
    rows = [(str(i % (n - 4)), " ".join(["common", *[pick(k) for k in range(rng.randrange(40))]])) for i in range(n)]
    return spark.createDataFrame([*rows, ("none", None), ("blank", "")], "review_id string, review_text string"), rows


def _expected(rows, n_docs, min_df, max_df, most):
    tf = Counter()
    for i, text in rows:
        words = text.split()
        tf.update((i, t) for t in words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df, total = Counter(t for _, t in tf), Counter()
    for (_, t), k in tf.items():
        total[t] += k
    kept = sorted((t for t in df if min_df <= df[t] <= max_df * n_docs), key=lambda t: (-total[t], t))
    return tf, {t: df[t] for t in kept[:most]}


@pytest.mark.parametrize("piece, reported, counted", [(1 << 20, 4, 40), (1 << 11, 8, 40), (1 << 9, 1, 40), (1 << 11, 8, 1)])
def test_frequent_terms_are_exact(spark, monkeypatch, piece, reported, counted):
    """Whether reports tell all terms, few are counted again or all must be."""
    for name, value in (("_PIECE", piece), ("_REPORTED", reported), ("_COUNTED", counted)):
        monkeypatch.setattr(vectors, name, value)
    df, rows = _texts(spark)
    words = document_words(df)
    for min_df, max_df, most in ((5, 0.9, 25), (1, 1.0, 25), (2, 0.9, 10_000)):
        _, expected = _expected(rows, df.count(), min_df, max_df, most)
        found = frequent_terms(words, df.count(), min_df, max_df, most).collect()
        assert {r.term: r.df for r in found} == expected


def test_counts_of_longer_runs_stay_inside_their_text(spark):
    df = spark.createDataFrame(
        [("a", "red kite red kite red"), ("a", "red"), ("b", "kite"), ("c", None)], "review_id string, review_text string"
    )
    found = {(r.review_id, r.term): r.tf for r in term_counts(df, low=2, high=3).collect()}
    assert found == {("a", "red kite"): 2, ("a", "kite red"): 2, ("a", "red kite red"): 2, ("a", "kite red kite"): 1}


def test_bounded_weights_shuffle_and_sort_no_terms(spark, monkeypatch):
    """Neither the vocabulary nor the length of a document needs a table of all terms."""
    monkeypatch.setattr(vectors, "_PIECE", 1 << 11)
    df, _ = _texts(spark)
    weights = tfidf(df, max_features=50)
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    bounded = {(r.review_id, r.term): r.weight for r in weights.collect()}
    kept = spark.createDataFrame(
        list(_expected(_texts(spark)[1], df.count(), 5, 0.9, 50)[1].items()), "term string, df long"
    )
    salted = {(r.review_id, r.term): r.weight for r in tfidf(df, max_features=None, kept=kept).collect()}
    assert bounded == pytest.approx(salted) and len(bounded) > 100


def test_weights_by_document_are_the_same(spark):
    df, _ = _texts(spark)
    rows = {(r.review_id, r.term, r.weight) for r in tfidf(df, min_df=2).collect()}
    listed = tfidf(df, min_df=2, by_document=True)
    assert {(r.review_id, *w) for r in listed.collect() for w in r.weights} == rows and listed.where("size(weights) = 0").isEmpty()
