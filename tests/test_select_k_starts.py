"""The search for k takes the cheapest of as many starts as k-means itself."""

from pyspark.ml.linalg import Vectors

from plumbline.operators import cluster


def test_default_starts(spark, monkeypatch):
    seen, real = [], cluster.kmeans
    monkeypatch.setattr(cluster, "kmeans", lambda data, k, starts, seed: seen.append(starts) or real(data, k, 1, seed))
    data = spark.createDataFrame([(Vectors.dense([float(i % 3), float(i)]),) for i in range(12)], ["features"])
    assert cluster.choose_k(data, [2, 3]).count() == 2
    assert seen == [cluster.STARTS] * 2 and cluster.STARTS == 10
