"""Projections of raw review and metadata rows onto the unified columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import (
    PAGE_TRUE_WORDS,
    coerce_bool,
    first_filled,
    non_empty,
    parse_epoch,
    parse_price,
    stable_id,
    to_number,
)
from plumbline.schema import EXTRA_TYPES, META_COLUMNS, REVIEW_COLUMNS, REVIEW_SCHEMA

# Raw record layouts. Numbers occur quoted and with a fraction too,
# flags as words, so they are read as text and parsed afterwards.
REVIEW_2023 = """
    review_id string, parent_asin string, asin string, user_id string, rating string,
    title string, text string, verified_purchase string, timestamp string,
    helpful_vote string, helpful_votes string
"""
META_2023 = """
    parent_asin string, asin string, title string, price string, store string,
    main_category string
"""
REVIEW_2014 = """
    asin string, reviewerID string, reviewText string, summary string, overall string,
    unixReviewTime string, helpful array<string>
"""
META_2014 = """
    asin string, title string, brand string, price string, categories array<array<string>>
"""
PLATFORM_REVIEW = """
    recommendationid string,
    author struct<steamid:string, num_reviews:string, num_games_owned:string, playtime_forever:string>,
    review string, timestamp_created string, voted_up boolean, votes_up string, votes_funny string,
    weighted_vote_score string, comment_count string, steam_purchase boolean,
    received_for_free boolean, written_during_early_access boolean
"""
PLATFORM_META = """
    name string, genres array<struct<description:string>>,
    price_overview struct<final:double>, developers array<string>
"""
PAGE_REVIEW = """
    id string, user_id string, rating string, title string, text string,
    verified_purchase string, date string, helpful_vote string
"""
PAGE_META = "title string, price string, brand string, store string, main_category string"


def unified(df: DataFrame, columns: dict[str, Column], extras: dict[str, Column] | None = None) -> DataFrame:
    """Unified columns in order, typed; those not given are null."""
    out = []
    for field in REVIEW_SCHEMA.fields:
        value = columns.get(field.name, F.lit(None))
        out.append(value.cast(field.dataType).alias(field.name))
    for name, value in (extras or {}).items():
        out.append(value.alias(name))
    return df.select(*out)


def _whole(c: Column | str) -> Column:
    """A whole number from text, cut at the point; null where there is none."""
    number = to_number(c)
    return F.when(F.abs(number) < 2.0**62, number).cast("long")


def _votes(*names: str) -> Column:
    return F.coalesce(*[F.nullif(_whole(n), F.lit(0).cast("long")) for n in names], F.lit(0).cast("long"))


def normalize_review_2023(df: DataFrame, category: Column) -> DataFrame:
    product, reviewer = first_filled("parent_asin", "asin"), first_filled("user_id")
    text = first_filled("text")
    return unified(
        df,
        {
            "review_id": F.coalesce(non_empty("review_id"), stable_id(product, reviewer, text)),
            "product_id": product,
            "product_category": category,
            "reviewer_id": reviewer,
            "rating": to_number("rating"),
            "review_title": first_filled("title"),
            "review_text": text,
            "verified_purchase": coerce_bool("verified_purchase"),
            "review_date": parse_epoch("timestamp", "auto"),
            "helpful_votes": _votes("helpful_vote", "helpful_votes"),
            "source": F.lit("fallback"),
        },
    )


def normalize_review_2014(df: DataFrame, category: Column) -> DataFrame:
    """No purchase flag and no id in this edition; ``helpful`` is [up, total]."""
    product, reviewer = first_filled("asin"), first_filled("reviewerID")
    text = first_filled("reviewText")
    return unified(
        df,
        {
            "review_id": stable_id(product, reviewer, text),
            "product_id": product,
            "product_category": category,
            "reviewer_id": reviewer,
            "rating": to_number("overall"),
            "review_title": first_filled("summary"),
            "review_text": text,
            "review_date": parse_epoch("unixReviewTime", "s"),
            "helpful_votes": F.coalesce(_whole(F.get("helpful", F.lit(0))), F.lit(0)),
            "total_votes": F.nullif(_whole(F.get("helpful", F.lit(1))), F.lit(0).cast("long")),
            "source": F.lit("fallback"),
        },
    )


def normalize_meta_2023(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(
        first_filled("parent_asin", "asin").alias("product_id"),
        first_filled("title").alias("product_title"),
        parse_price("price").alias("price"),
        F.col("store").alias("brand"),
        F.col("main_category"),
        *keep,
    )


def normalize_meta_2014(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(
        first_filled("asin").alias("product_id"),
        first_filled("title").alias("product_title"),
        parse_price("price").alias("price"),
        F.col("brand"),
        F.get(F.get("categories", F.lit(0)), F.lit(0)).alias("main_category"),
        *keep,
    )


def normalize_platform_meta(df: DataFrame, app_id: Column) -> DataFrame:
    """Price in cents, 0 meaning unknown; the first genre and developer count."""
    return df.select(
        app_id.cast("string").alias("product_id"),
        first_filled("name").alias("product_title"),
        (F.nullif(F.col("price_overview.final"), F.lit(0.0)) / 100).alias("price"),
        F.get("developers", F.lit(0)).alias("brand"),
        F.when(
            F.coalesce(F.size("genres"), F.lit(0)) > 0, F.get("genres", F.lit(0))["description"]
        ).otherwise("Steam").alias("main_category"),
    )


def normalize_platform_review(df: DataFrame, app_id: Column) -> DataFrame:
    """Recommended or not becomes 5 or 1; absent flags are false, absent counts 0.

    Metadata columns are taken from ``df`` where it has them (after a join).
    """
    text, author = first_filled("review"), F.col("author")
    meta = {c: F.col(c) for c in META_COLUMNS if c in df.columns}
    title = meta.pop("product_title", F.lit(None).cast("string"))
    category = meta.get("main_category", F.lit(None).cast("string"))

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    def count(c: Column) -> Column:
        return F.coalesce(_whole(c), F.lit(0)).cast("long")

    extras = {
        "received_for_free": flag("received_for_free"),
        "author_num_reviews": count(author["num_reviews"]),
        "author_num_games_owned": count(author["num_games_owned"]),
        "author_playtime_forever": count(author["playtime_forever"]),
        "weighted_vote_score": F.coalesce(to_number("weighted_vote_score"), F.lit(0.0)),
        "votes_funny": count(F.col("votes_funny")),
        "comment_count": count(F.col("comment_count")),
        "early_access": flag("written_during_early_access"),
    }
    return unified(
        df,
        {
            "review_id": F.coalesce(
                non_empty("recommendationid"), stable_id(app_id, author["steamid"], text)
            ),
            "product_id": app_id,
            "product_category": F.coalesce(non_empty(category), F.lit("Steam")),
            "reviewer_id": first_filled(author["steamid"]),
            "rating": F.when(F.col("voted_up"), 5.0).otherwise(1.0),
            "review_title": F.lit(""),
            "review_text": text,
            "verified_purchase": flag("steam_purchase"),
            "review_date": parse_epoch("timestamp_created", "s"),
            "helpful_votes": count(F.col("votes_up")),
            "product_title": first_filled(title),
            "source": F.lit("steam"),
            **meta,
        },
        {name: extras[name] for name in EXTRA_TYPES},
    )


def normalize_page_review(df: DataFrame, product_id: Column, category: Column) -> DataFrame:
    """A review object embedded in a page: ISO date taken as UTC, bad dates null."""
    reviewer, text = first_filled("user_id"), first_filled("text")
    return unified(
        df,
        {
            "review_id": F.coalesce(non_empty("id"), stable_id(product_id, reviewer, text)),
            "product_id": product_id,
            "product_category": category,
            "reviewer_id": reviewer,
            "rating": to_number("rating"),
            "review_title": first_filled("title"),
            "review_text": text,
            "verified_purchase": coerce_bool("verified_purchase", PAGE_TRUE_WORDS),
            "review_date": F.col("date").try_cast("timestamp_ntz").cast("timestamp"),
            "helpful_votes": _votes("helpful_vote"),
            "source": F.lit("scrape"),
        },
    )


# Names of the two editions.
EDITIONS = {
    "amazon_reviews_2023": (REVIEW_2023, normalize_review_2023, META_2023, normalize_meta_2023),
    "amazon_reviews_2014": (REVIEW_2014, normalize_review_2014, META_2014, normalize_meta_2014),
}


def edition(name: str):
    """(review layout, review normalizer, metadata layout, metadata normalizer)."""
    if name not in EDITIONS:
        raise ValueError(f"unknown edition {name!r}, expected one of {sorted(EDITIONS)}")
    return EDITIONS[name]


def select_unified(df: DataFrame) -> DataFrame:
    extras = [c for c in df.columns if c not in REVIEW_COLUMNS]
    return df.select(*REVIEW_COLUMNS, *extras)
