"""Principal components, clusterings and review styles."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import STOP_WORDS, drop_stop_words, ngrams, tokens
from plumbline.operators.matrix import standard_scale, with_vector
from plumbline.operators.vectors import (
    cluster_top_terms,
    document_words,
    frequent_terms,
    tfidf,
)
from plumbline.session import written_table

# Clustering defaults.
SEED = 42
STARTS = 10
K_GRID = [2, 3, 4, 5, 6]
MAX_COMPONENTS = 50
VOCABULARY = 5000


def pca(df: DataFrame, columns: list[str], id_col: str, n: int = 2, scale: bool = True):
    """(scores, loadings, explained shares) of the first ``n`` components.

    Spark projects without centring, so columns are centred first. Each
    component is turned so that its largest loading is positive.
    """
    base = standard_scale(df, columns) if scale else df
    vectors = with_vector(base, columns).select(id_col, "features")
    model = PCA(k=n, inputCol="features", outputCol="pc").fit(vectors)
    matrix = model.pc.toArray()
    signs = [1.0 if abs(col.max()) >= abs(col.min()) else -1.0 for col in matrix.T]
    points = model.transform(vectors).withColumn("pc", vector_to_array("pc"))
    scores = points.select(
        id_col, *[(F.col("pc")[i] * signs[i]).alias(f"pc{i + 1}") for i in range(n)]
    )
    spark = df.sparkSession
    loadings = spark.createDataFrame(
        [(c, *[float(matrix[r, i] * signs[i]) for i in range(n)]) for r, c in enumerate(columns)],
        "feature string, " + ", ".join(f"pc{i + 1} double" for i in range(n)),
    )
    return scores, loadings, [float(v) for v in model.explainedVariance]


def kmeans(vectors: DataFrame, k: int, starts: int = STARTS, seed: int = SEED):
    """The cheapest of several starts; ``vectors`` has a ``features`` column."""
    models = [KMeans(k=k, seed=seed + i).fit(vectors) for i in range(starts)]
    return min(models, key=lambda m: m.summary.trainingCost)


def assign_nearest(df: DataFrame, id_col: str, vector: str, centres: list[list[float]]) -> DataFrame:
    """(id, cluster) by given centres; ties go to the first."""

    def squared(centre: list[float]):
        terms = F.zip_with(vector, F.array(*[F.lit(float(v)) for v in centre]), lambda a, b: (a - b) * (a - b))
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)

    options = F.array(*[F.struct(squared(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    return df.select(id_col, F.array_min(options)["i"].alias("cluster"))


def choose_k(vectors: DataFrame, grid: list[int] = K_GRID, starts: int = STARTS, seed: int = SEED) -> DataFrame:
    """(k, silhouette): Spark's squared Euclidean silhouette, linear in the rows."""
    n = vectors.count()
    judge = ClusteringEvaluator(metricName="silhouette")
    rows = []
    for k in grid:
        if 2 <= k < n:
            labelled = kmeans(vectors, k, starts, seed).transform(vectors)
            several = labelled.select("prediction").distinct().count() > 1
            rows.append((k, float(judge.evaluate(labelled)) if several else -1.0))
    return vectors.sparkSession.createDataFrame(rows, "k int, silhouette double")


def hierarchical(vectors: DataFrame, n_clusters: int, seed: int = SEED):
    """Top-down hierarchy by repeated halving, in place of bottom-up merging."""
    return BisectingKMeans(k=n_clusters, seed=seed).fit(vectors)


def svd_embed(
    df: DataFrame,
    id_col: str = "review_id",
    text_col: str = "review_text",
    components: int = MAX_COMPONENTS,
    max_features: int = VOCABULARY,
    stop_words: list[str] = STOP_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """((id, svd array), (id, term, weight)): truncated SVD of uncentred TF-IDF.

    The vocabulary is bounded, so its square fits the driver, where Spark
    factorises it. Rows are projected by a join with the loadings, broadcast
    because at most ``max_features`` rows of them exist.
    """
    n_docs = df.count()
    words = document_words(df, id_col, text_col, stop_words, n_docs)
    kept = frequent_terms(words, n_docs, 1, 1.0, max_features)
    idf = F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1
    vocab = kept.select("term", "df", idf.alias("idf")).orderBy("term").collect()
    names = [r["term"] for r in vocab]
    known = df.sparkSession.createDataFrame([(r["term"], r["df"]) for r in vocab], "term string, df long")

    listed = df.select(
        id_col, ngrams(drop_stop_words(tokens(text_col), stop_words)).alias("terms")
    )
    session = df.sparkSession
    counter = CountVectorizerModel.from_vocabulary(names, inputCol="terms", outputCol="tf")
    scaler = ElementwiseProduct(
        scalingVec=Vectors.dense([r["idf"] for r in vocab]), inputCol="tf", outputCol="raw"
    )
    unit = Normalizer(p=2.0, inputCol="raw", outputCol="w")
    vectors = unit.transform(scaler.transform(counter.transform(listed))).select("w")
    rank = max(2, min(components, len(names) - 1, n_docs - 1))
    # The factorisation passes over the rows many times, so they are kept at hand.
    # Every partition sends a square of the vocabulary, so there are no more than cores.
    vectors = vectors.coalesce(df.sparkSession.sparkContext.defaultParallelism)
    rows = MLUtils.convertVectorColumnsFromML(vectors, "w").persist(StorageLevel.MEMORY_AND_DISK)
    svd = RowMatrix(rows).computeSVD(rank)
    rows.unpersist()
    loadings = np.array(svd.V.toArray())
    rank = loadings.shape[1]
    for i in range(rank):
        if abs(loadings[:, i].min()) > abs(loadings[:, i].max()):
            loadings[:, i] *= -1
    table = session.createDataFrame(
        [(t, [float(x) for x in row]) for t, row in zip(names, loadings)],
        "term string, v array<double>",
    )
    weights = tfidf(df, id_col, text_col, 1, 1.0, max_features, stop_words=stop_words, kept=known, words=words)
    sums = [F.sum(F.col("weight") * F.col("v")[i]).alias(f"s{i}") for i in range(rank)]
    placed = weights.join(F.broadcast(table), "term").groupBy(id_col).agg(*sums)
    zeros = F.array(*[F.lit(0.0)] * rank)
    embedded = df.select(id_col).join(
        placed.select(id_col, F.array(*[f"s{i}" for i in range(rank)]).alias("svd")), id_col, "left"
    )
    return embedded.withColumn("svd", F.coalesce("svd", zeros)), weights


def review_styles(
    df: DataFrame,
    n_clusters: int = 3,
    id_col: str = "review_id",
    text_col: str = "review_text",
    components: int = MAX_COMPONENTS,
    starts: int = STARTS,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """((id, cluster), top terms per cluster) of texts in TF-IDF/SVD space."""
    embedded, weights = svd_embed(df, id_col, text_col, components)
    vectors = written_table(embedded, "styles").select(
        id_col, array_to_vector("svd").alias("features")
    )
    model = kmeans(vectors, n_clusters, starts, seed)
    clusters = model.transform(vectors).select(id_col, F.col("prediction").alias("cluster"))
    return clusters, cluster_top_terms(weights, clusters, id_col)
