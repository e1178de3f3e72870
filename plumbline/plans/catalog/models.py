"""Scaling, neighbours, classifiers, components, clusterings and review styles."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import text_stats
from plumbline.operators.classify import (
    balanced_weights,
    forest_importances,
    forest_scores,
    grid_scores,
    run_classification,
    search_forest,
)
from plumbline.operators.cluster import (
    assign_nearest,
    choose_k,
    hierarchical,
    kmeans,
    pca,
    review_styles,
    svd_embed,
)
from plumbline.operators.labels import proxy_label
from plumbline.operators.matrix import design_matrix, matrix_columns, standard_scale, with_vector
from plumbline.operators.neighbors import knn_scores, nearest, nearest_lsh, silhouette
from plumbline.operators.sampling import sample_rows, stratified_folds, stratified_split
from plumbline.plans.catalog.registry import items_sql, query, r6
from plumbline.plans.catalog.texts import docs_features
from plumbline.schema import TEXT_COLUMNS
from plumbline.sources.tables import reviews_docs, reviews_items, table
from plumbline.session import written_table

SCALED = ["rating", "helpful_votes", "price"]


@query(
    "standard_scale",
    items_sql(
        "SELECT review_id, "
        + ", ".join(
            f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in SCALED
        )
        + ", 0.0 AS constant FROM reviews_items"
    ),
)
def standard_scale_query(spark, folder):
    df = reviews_items(spark, folder).select("review_id", *SCALED, F.lit(7.0).alias("constant"))
    out = standard_scale(df, [*SCALED, "constant"])
    return out.select("review_id", *[r6(c) for c in SCALED], "constant")


# -- neighbours on the embedding table ---------------------------------------


def vectors(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("x"),
        F.col("label").alias("group"),
        (F.col("label") < 5).cast("int").alias("y"),
    )


def _sides(spark, folder):
    split = stratified_split(vectors(spark, folder), "vec_id", "y")
    return (split.where(F.col("part") == p) for p in ("train", "test"))


VECTORS_SQL = """vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label, CAST(label < 5 AS INT) AS y
  FROM embeddings)"""
GRID = [3, 5, 11, 21]


@query(
    "knn_exact",
    f"""WITH {VECTORS_SQL},
      split AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY sha1(vec_id || '|42'), vec_id)
        <= round(count(*) OVER (PARTITION BY y) * 0.2) AS test FROM vectors),
      d AS (SELECT a.vec_id AS vec_id, b.y AS y, row_number() OVER (PARTITION BY a.vec_id
          ORDER BY list_distance(a.x, b.x), b.vec_id) AS place
        FROM split a JOIN split b ON a.test AND NOT b.test)
      """
    + " UNION ALL ".join(
        f"""SELECT vec_id, {k} AS k, round(avg(CAST(y AS DOUBLE)) FILTER (WHERE place <= {k}), 6) AS score
          FROM d GROUP BY 1"""
        for k in GRID
    ),
)
def knn_exact(spark, folder):
    train, test = _sides(spark, folder)
    near = nearest(train, test, max(GRID), "vec_id", "x", "y", block_rows=512)
    return knn_scores(near, "vec_id", GRID).select("vec_id", "k", r6("score"))


@query("knn_lsh")
def knn_lsh(spark, folder):
    train, test = _sides(spark, folder)
    return nearest_lsh(train, test, 5, "vec_id", "x", "y", bucket_length=1.0, max_distance=1.2)


@query(
    "silhouette_exact",
    f"""WITH {VECTORS_SQL},
      d AS (SELECT a.vec_id, a.label AS c, b.label AS o, sum(list_distance(a.x, b.x)) AS t, count(*) AS n
        FROM vectors a, vectors b GROUP BY 1, 2, 3),
      m AS (SELECT vec_id, c, max(n) FILTER (WHERE c = o) AS n, max(t / (n - 1)) FILTER (WHERE c = o AND n > 1) AS a,
        min(t / n) FILTER (WHERE c <> o) AS b FROM d GROUP BY 1, 2)
      SELECT vec_id, c AS cluster, round(CASE WHEN n = 1 THEN 0.0 ELSE coalesce((b - a) / greatest(a, b), 0.0) END, 6)
        AS silhouette FROM m""",
)
def silhouette_exact(spark, folder):
    out = silhouette(vectors(spark, folder), "vec_id", "x", "group", block_rows=512)
    return out.select("vec_id", "cluster", r6("silhouette"))


@query(
    "kmeans_assign",
    f"""WITH {VECTORS_SQL},
      e AS (SELECT label, unnest(x) AS v, unnest(range(len(x))) AS i FROM vectors),
      m AS (SELECT label, i, avg(v) AS v FROM e GROUP BY 1, 2),
      c AS (SELECT label, list(v ORDER BY i) AS x FROM m GROUP BY 1)
      SELECT vec_id, arg_min(c.label, list_distance(vectors.x, c.x)) AS cluster FROM vectors, c GROUP BY 1""",
)
def kmeans_assign(spark, folder):
    """Centres are the means of the ten labels; only they reach the driver."""
    df = vectors(spark, folder)
    size = df.select(F.size("x")).first()[0]
    means = df.groupBy("group").agg(*[F.avg(F.col("x")[i]) for i in range(size)])
    centres = [list(r)[1:] for r in means.orderBy("group").collect()]
    return assign_nearest(df, "vec_id", "x", centres)


def _features_of(df: DataFrame) -> DataFrame:
    return df.select("vec_id", array_to_vector("x").alias("features"))


@query("kmeans")
def kmeans_query(spark, folder):
    data = _features_of(vectors(spark, folder))
    return kmeans(data, 4).transform(data).select("vec_id", F.col("prediction").alias("cluster"))


@query("select_k")
def select_k(spark, folder):
    return choose_k(_features_of(vectors(spark, folder)))


@query("hierarchical_clusters")
def hierarchical_clusters(spark, folder):
    data = _features_of(vectors(spark, folder))
    return hierarchical(data, 4).transform(data).select("vec_id", F.col("prediction").alias("cluster"))


# -- reviews -----------------------------------------------------------------


@query("pca")
def pca_query(spark, folder):
    """Two components of the text and rating features, with the proxy for each point."""
    return _pca_points(spark, folder)


@query("pca_sample")
def pca_sample_query(spark, folder):
    """As many of the points as a plot can show."""
    return sample_rows(_pca_points(spark, folder), "review_id", 2000)


def _pca_points(spark, folder) -> DataFrame:
    df = reviews_docs(spark, folder).withColumns(text_stats("review_text"))
    columns = matrix_columns(df)
    matrix = written_table(design_matrix(df, ["review_id", "verified_purchase"]), "matrix")
    scores, _, _ = pca(matrix, columns, "review_id")
    return scores.join(matrix.select("review_id", "verified_purchase"), "review_id")


@query("svd_embed")
def svd_embed_query(spark, folder):
    return svd_embed(written_table(reviews_docs(spark, folder), "reviews"))[0]


@query("review_styles")
def review_styles_query(spark, folder):
    df = written_table(reviews_docs(spark, folder), "reviews")
    return review_styles(df, 4)[1]


def _labelled(spark, folder) -> tuple[DataFrame, list[str]]:
    df = proxy_label(reviews_docs(spark, folder).withColumns(text_stats("review_text")))
    columns = matrix_columns(df)
    return written_table(design_matrix(df, ["review_id", "y"]), "matrix"), columns


@query("rf_classify")
def rf_classify(spark, folder):
    """Importances of one balanced forest on the text and rating features."""
    matrix, columns = _labelled(spark, folder)
    return forest_importances(with_vector(balanced_weights(matrix), columns), columns, 200, maxDepth=30)


@query("cv_grid")
def cv_grid(spark, folder):
    matrix, columns = _labelled(spark, folder)
    folded = written_table(balanced_weights(stratified_folds(matrix, "review_id", "y", 2)), "folds")
    search = search_forest(with_vector(folded, columns), 2, [10, 20], [5])
    return spark.createDataFrame(grid_scores(search), "trees int, depth int, cv_auc double")


@query("classify_pipeline")
def classify_pipeline(spark, folder):
    """Both classifiers end to end on the full feature table, small grids."""
    features = written_table(docs_features(spark, folder).drop(*TEXT_COLUMNS), "features")
    out = run_classification(features, folds=2, trees=[20], depths=[10])
    tables = [
        out["results"][name]["roc_auc"].select(F.lit(name).alias("model"), "roc_auc")
        for name in ("knn", "random_forest")
    ]
    return tables[0].unionAll(tables[1])
