"""A few registered queries against their SQL at the smallest scale."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SOME = [
    "normalize_2023", "normalize_platform", "clean_text", "text_stats", "burst_features", "tfidf", "sentiment",
    "near_duplicates", "univariate_auc", "product_projection", "suspicious_products", "knn_exact", "stream_ingest",
]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, FOLDER), duck, entry.oracle_sql()[name]) == ""
