"""Buckets by splitters from a quantile sketch, and what is ordered by them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.evaluation import roc_auc
from plumbline.operators.ordering import BUCKETS, quantiles, running_totals, with_even_bucket

NOW = 1_700_000_000


def bucketed(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    return with_even_bucket(df, "v", "b")


def test_narrow_values_fall_into_even_buckets(spark):
    """Seconds of one week differ by less than a fixed logarithmic bucket is wide."""
    df = spark.range(100_000).select((NOW + F.col("id") * 6 + F.rand(3)).alias("v"))
    sizes = with_even_bucket(df, "v", "b").groupBy("b").agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    rows = sizes.orderBy("b").collect()
    assert max(r.n for r in rows) <= 1.2 * 100_000 / BUCKETS + 1 and len(rows) > 0.9 * BUCKETS
    assert all(a.hi < b.lo for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize(
    "values",
    [
        [],
        [None, None],
        [0.0] * 50,
        [float("nan"), 1.0, None, -math.inf, math.inf, -1.0, 1.0],
        [1e-300 * k for k in range(200)],
        [-1e300, 1e300, 5.0],
    ],
)
def test_buckets_keep_order(spark, values):
    rows = bucketed(spark, values).orderBy("v").collect()
    numbers = [r.b for r in rows]
    assert numbers == sorted(numbers) and len(rows) == len(values)


def test_running_totals_by_stratum(spark):
    rng = random.Random(6)
    data = sorted({(rng.choice("ab"), NOW + rng.randrange(3000) / 7) for _ in range(1500)})
    df = spark.createDataFrame(data, "g string, v double")
    out = running_totals(df, ["g"], ["v"], "v", {"n": F.lit(1)}).collect()
    place = {}
    for g, v in data:
        place[g, v] = sum(1 for h, w in data if h == g and w <= v)
    assert {(r.g, r.v): r.n for r in out} == place
    assert all(r.n_all == sum(1 for h, _ in data if h == r.g) for r in out)


def test_quantiles_and_auc_of_narrow_values(spark):
    rng = random.Random(8)
    data = [(rng.choice("ab"), NOW + rng.random(), rng.randrange(2)) for _ in range(600)]
    df = spark.createDataFrame(data, "g string, v double, y int")
    got = {r.g: (r.n, r.q) for r in quantiles(df, ["g"], "v", {"q": 0.3}).collect()}
    for g in "ab":
        values = sorted(v for h, v, _ in data if h == g)
        at = (len(values) - 1) * 0.3
        low = math.floor(at)
        assert got[g] == (len(values), pytest.approx(values[low] + (values[low + 1] - values[low]) * (at - low)))
    auc = {r.g: r.roc_auc for r in roc_auc(df, ["g"], "y", "v").collect()}
    for g in "ab":
        pos = [v for h, v, y in data if h == g and y]
        neg = [v for h, v, y in data if h == g and not y]
        won = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert auc[g] == pytest.approx(won / (len(pos) * len(neg)))
