"""The feature table and the ranking of suspicious products."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.sentiment import sentiment, small_lexicon
from plumbline.functions.text import text_stats
from plumbline.operators.behavior import (
    burst_peak,
    helpful_ratio,
    product_stats,
    reviewer_stats,
    vote_stats,
    votes_zscore,
)
from plumbline.operators.graph import communities, product_degree, project_products
from plumbline.operators.identity import ROW_ID, with_row_id
from plumbline.operators.matrix import scaling
from plumbline.operators.near_duplicates import BLOCK_ROWS, max_sibling_similarity
from plumbline.operators.skew import HOT_ROWS, join_per_key, row_counts
from plumbline.schema import TEXT_COLUMNS
from plumbline.session import written_table

# Feature defaults.
WINDOW_DAYS = 7.0
SMOOTHING = 1.0
NEAR_DUPLICATE = 0.90
MIN_SHARED = 2


def build_feature_table(
    df: DataFrame,
    lexicon: DataFrame | None = None,
    window_days: float = WINDOW_DAYS,
    smoothing: float = SMOOTHING,
    threshold: float = NEAR_DUPLICATE,
    hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All text and behavioural features on every review.

    Statistics of one key are computed and joined together, on rows without
    their texts. Texts rejoin at the end, by a number given to every row, so long
    values are shuffled once and rows with one review id stay apart. The numbered
    rows are stored, as several branches read them.
    """
    df = with_row_id(df)
    lexicon = lexicon if lexicon is not None else small_lexicon(df.sparkSession)
    texts = [c for c in TEXT_COLUMNS if c in df.columns]
    rows = df.drop(*texts)

    of_reviewer = reviewer_stats(df).join(
        burst_peak(df, "reviewer_id", window_days, out="reviewer_burst_max"), "reviewer_id"
    )
    of_product = (
        product_stats(df)
        .join(burst_peak(df, "product_id", window_days, out="product_burst_max"), "product_id")
        .join(vote_stats(df), "product_id")
    )
    for key, stats in (("reviewer_id", of_reviewer), ("product_id", of_product)):
        counts = row_counts(df, [key])
        rows = join_per_key(rows, stats, [key], ROW_ID, counts=counts, hot_rows=hot_rows)
    rows = rows.withColumns(
        {"helpful_ratio": helpful_ratio(smoothing), "helpful_votes_pz": votes_zscore()}
    ).drop("__votes_mean", "__votes_std")
    similar = max_sibling_similarity(df, id_col=ROW_ID, block_rows=block_rows, hot_rows=hot_rows)
    styled = df.select(ROW_ID, *texts, *[c.alias(n) for n, c in text_stats("review_text").items()])
    return (
        rows.join(sentiment(df, lexicon, ROW_ID), ROW_ID)
        .join(similar, ROW_ID)
        .join(styled, ROW_ID)
        .withColumn("is_near_duplicate", F.col("max_intra_product_similarity") >= threshold)
        .drop(ROW_ID)
    )


def product_signals(df: DataFrame, window_days: float = WINDOW_DAYS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per product: counts, ratios, burst peak and mean similarity."""
    stats = df.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("review_count"),
        F.avg(F.col("verified_purchase").cast("double")).alias("verified_ratio"),
        F.avg("rating").alias("mean_rating"),
        F.count_distinct("reviewer_id").alias("n_reviewers"),
    )
    if "product_burst_max" in df.columns and "max_intra_product_similarity" in df.columns:
        rest = df.groupBy("product_id").agg(
            F.max("product_burst_max").alias("burst_max"),
            F.avg("max_intra_product_similarity").alias("mean_near_dup"),
        )
        return stats.join(rest, "product_id")
    df = with_row_id(df)
    similar = max_sibling_similarity(df, id_col=ROW_ID, block_rows=block_rows)
    near = (
        df.select(ROW_ID, "product_id")
        .join(similar, ROW_ID)
        .groupBy("product_id")
        .agg(F.avg("max_intra_product_similarity").alias("mean_near_dup"))
    )
    return stats.join(burst_peak(df, "product_id", window_days), "product_id").join(near, "product_id")


def suspicious_products(
    df: DataFrame,
    min_shared: int = MIN_SHARED,
    with_communities: bool = True,
    window_days: float = WINDOW_DAYS,
    skip_blank: bool = False,
) -> DataFrame:
    """Products ranked by low verified share, bursts, similar texts and shared reviewers."""
    # One row per product each, stored, so that the shuffles behind one part are deleted before the next.
    signals = written_table(product_signals(df, window_days), "of-products")
    links = project_products(df, min_shared, skip_blank)
    products = signals.select("product_id")
    degree = product_degree(links, products).withColumnRenamed("degree", "shared_reviewer_degree")
    degree = written_table(degree, "degrees")
    table = signals.join(degree, "product_id")
    if with_communities:
        table = table.join(communities(links, products), "product_id")
    parts = {
        "unverified": 1.0 - F.col("verified_ratio"),
        "burst": F.col("burst_max").cast("double"),
        "near": F.coalesce("mean_near_dup", F.lit(0.0)),
        "degree": F.col("shared_reviewer_degree").cast("double"),
    }
    # One row per product is stored, so that its moments and the final ranking do
    # not run the work above twice.
    marked = written_table(table.withColumns({f"__{k}": v for k, v in parts.items()}), "signals")
    fitted = scaling(marked, [f"__{k}" for k in parts])
    # Products without any flag take the mean ratio: rows added at the mean leave
    # it alone and shrink the deviation by the share of rows filled.
    n, n_flagged = marked.agg(F.count(F.lit(1)), F.count("__unverified")).first()
    shrink = {"__unverified": math.sqrt(n_flagged / n) if n else 1.0}
    score = F.lit(0.0)
    for name, (mean, deviation) in fitted.items():
        if deviation:
            value = (F.col(name) - mean) / (deviation * shrink.get(name, 1.0))
            score = score + F.coalesce(value, F.lit(0.0))
    return marked.withColumn("suspicion_score", score).drop(*fitted)


def ranked(table: DataFrame, n: int | None = None) -> DataFrame:
    """Most suspicious first; ties by product."""
    ordered = table.orderBy(F.desc("suspicion_score"), F.asc("product_id"))
    return ordered.limit(n) if n else ordered
