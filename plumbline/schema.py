"""The unified review table: one row per review, the same columns from every source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names, order and types of the unified table.
REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("product_category", T.StringType()),
        T.StructField("reviewer_id", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("review_title", T.StringType()),
        T.StructField("review_text", T.StringType()),
        T.StructField("verified_purchase", T.BooleanType()),
        T.StructField("review_date", T.TimestampType()),
        T.StructField("helpful_votes", T.LongType()),
        T.StructField("total_votes", T.LongType()),
        T.StructField("product_title", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("brand", T.StringType()),
        T.StructField("main_category", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

REVIEW_COLUMNS = REVIEW_SCHEMA.fieldNames()
TEXT_COLUMNS = ["review_title", "review_text"]
META_COLUMNS = ["product_title", "price", "brand", "main_category"]

# Extra columns that single sources carry beside the unified ones.
EXTRA_TYPES = {
    "received_for_free": T.BooleanType(),
    "author_num_reviews": T.LongType(),
    "author_num_games_owned": T.LongType(),
    "author_playtime_forever": T.LongType(),
    "weighted_vote_score": T.DoubleType(),
    "votes_funny": T.LongType(),
    "comment_count": T.LongType(),
    "early_access": T.BooleanType(),
}

# Numeric columns that may enter the design matrix, in matrix order.
MATRIX_COLUMNS = [
    "rating", "helpful_votes", "price",
    "char_count", "word_count", "avg_word_len",
    "exclaim_count", "question_count", "upper_ratio", "digit_ratio",
    "sentiment_compound", "sentiment_pos", "sentiment_neg", "sentiment_neu",
    "reviewer_review_count", "reviewer_product_count", "reviewer_category_breadth",
    "reviewer_mean_rating", "reviewer_rating_std",
    "product_review_count", "product_mean_rating", "product_rating_std",
    "product_rating_skew", "product_verified_ratio",
    "reviewer_burst_max", "product_burst_max",
    "helpful_ratio", "helpful_votes_pz", "max_intra_product_similarity",
    "author_num_reviews", "author_num_games_owned", "author_playtime_forever",
    "weighted_vote_score", "votes_funny", "comment_count",
]

# Fixed value: the column computed from the label itself.
LEAKY_COLUMNS = ["product_verified_ratio"]


def validate_schema(df: DataFrame, required: list[str] = REVIEW_COLUMNS) -> DataFrame:
    """Fail while the plan is built, not when it runs, if a unified column is absent."""
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"not a unified review table, missing: {', '.join(missing)}")
    return df
