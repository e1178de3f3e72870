"""Top-k search against all scores, edge cases and the SQL."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from plumbline.llm import vertical_topk
from plumbline.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def slow(rows, is_query, k=10):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    out = []
    for q, v in whole:
        if is_query(q):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(df, is_query, k=10):
    return sorted(tuple(r) for r in vertical_topk.search(df, is_query, k).collect())


@pytest.mark.parametrize("rows", [vertical_topk.CANDIDATE_ROWS, 37])
def test_equals_all_scores(spark, monkeypatch, rows):
    monkeypatch.setattr(vertical_topk, "CANDIDATE_ROWS", rows)
    monkeypatch.setattr(vertical_topk, "QUERY_ROWS", 3)
    rng = random.Random(2)
    # Repeated vectors and coarse values make ties.
    kinds = [[rng.gauss(0, 1) * (3 if d < 5 else 0.2) for d in range(40)] for _ in range(30)]
    data = [(i, kinds[rng.randrange(30)] if i % 3 else [round(rng.gauss(0, 1), 1) for _ in range(40)]) for i in range(300)]
    df = spark.createDataFrame(data, SCHEMA)
    assert found(df, F.col("vec_id") % 20 == 0) == slow(data, lambda i: i % 20 == 0)


def test_bounds_discard_candidates():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-1000, 1000, (500, 64)) * np.linspace(4, 0.01, 64)
    block = vertical_topk.Vertical(vectors.astype(int).tolist(), np.arange(500), 64)
    ids, scores = block.best(vectors[7].astype(np.int64), 7, 10)
    all_scores = vectors.astype(int) @ vectors[7].astype(int)
    all_scores[7] = -(1 << 60)
    assert ids.tolist() == np.argsort(-all_scores, kind="stable")[:10].tolist()


def test_cases(spark):
    data = [
        (0, [1.0, 2.0]), (1, [1.0, None]), (2, [float("nan"), 1.0]), (3, None), (4, [float("inf"), 0.0]), (5, [1.0]),
        (6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [1.0, 1.0]), (7, []), (8, [1e30, 1.0]), (9, [-1.0, 0.0005]),
    ]
    df = spark.createDataFrame(data, SCHEMA).withColumn("score", F.lit("clash"))
    one = 1024 * 1024
    assert found(df, F.col("vec_id") == 0) == [
        (0, 1, 8, 2**63 - 1), (0, 2, 6, 5 * one), (0, 3, 6, 5 * one), (0, 4, 5, one), (0, 5, 7, 0), (0, 6, 9, -one)
    ]
    assert found(df, F.col("vec_id") == 6, 1) == [(6, 1, 8, 2**63 - 1)]
    assert found(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0) == []


def test_large_components_are_scored_exactly(spark):
    rng = random.Random(5)
    # Scores of neighbours differ by less than floating point can tell.
    data = [(i, [70000.0 + rng.randrange(3) / 1024 for _ in range(12)]) for i in range(60)]
    data += [(60 + i, [rng.uniform(-5e5, 5e5) for _ in range(12)]) for i in range(40)]
    data += [(100 + i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(60)]
    df = spark.createDataFrame(data, SCHEMA)
    assert found(df, F.col("vec_id") % 10 == 0) == slow(data, lambda i: i % 10 == 0)


@pytest.mark.parametrize("value", [1.7e308, -2.5, 65535.9999, 65536.25, -70000.0005, 2.0**60 + 512, 3e22])
def test_whole_numbers(value):
    assert vertical_topk.whole([value]) == [math.floor(Fraction(value) * 1024)]


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(QUERIES["op7_vertical_topk"](spark, folder), connect(folder), ORACLES["op7_vertical_topk"]) == ""
