"""Landed pages: API responses and HTML, taken apart with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import parse_price
from plumbline.sources.normalizers import (
    PAGE_META,
    PAGE_REVIEW,
    PLATFORM_META,
    PLATFORM_REVIEW,
    normalize_page_review,
    normalize_platform_meta,
    normalize_platform_review,
)

# The shape of product links, of review blocks and of star texts.
PRODUCT_LINK = r"/dp/([A-Z0-9]{10})"
BLOCK_MARK = r'data-hook="review"'
STARS = r"([0-5](?:\.\d)?)"


def _records(layout: str) -> T.ArrayType:
    return T.ArrayType(T.StructType.fromDDL(layout))


def explode_api_pages(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per review of every successful page; other columns are kept."""
    layout = (
        T.StructType()
        .add("success", T.IntegerType())
        .add("cursor", T.StringType())
        .add("reviews", _records(PLATFORM_REVIEW))
    )
    parsed = pages.withColumn("__p", F.from_json(payload, layout)).drop(payload)
    good = parsed.where(F.col("__p.success") != 0)
    rest = [c for c in good.columns if c != "__p"]
    return good.select(*rest, F.explode("__p.reviews").alias("r")).select(*rest, "r.*")


def explode_api_meta(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Metadata responses, a map from app id to data, as one row per known app."""
    node = T.StructType().add("success", T.BooleanType()).add("data", T.StructType.fromDDL(PLATFORM_META))
    layout = T.MapType(T.StringType(), node)
    apps = payloads.select(F.explode(F.from_json(payload, layout)).alias("app_id", "node"))
    known = apps.where(F.col("node.success")).select("app_id", "node.data.*")
    return normalize_platform_meta(known, F.col("app_id"))


def platform_reviews(pages: DataFrame, meta: DataFrame, app_id: str = "app_id") -> DataFrame:
    """Reviews of landed API pages joined with the metadata of their app.

    The catalogue is not forced to be broadcast; AQE does so when it is small.
    """
    reviews = explode_api_pages(pages).withColumn("product_id", F.col(app_id).cast("string"))
    joined = reviews.join(meta, "product_id", "left")
    return normalize_platform_review(joined, F.col("product_id"))


def json_island(html: str | Column, island: str) -> Column:
    """Body of the JSON script element with the given id (id before type), or null."""
    pattern = (
        rf'(?s)<script[^>]*id="{island}"[^>]*type="application/json"[^>]*>(.*?)</script>'
    )
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def page_reviews(
    pages: DataFrame, product_id: Column, category: Column, html: str = "html"
) -> DataFrame:
    """Reviews embedded as JSON in product pages."""
    body = F.from_json(json_island(html, "reviews-data"), _records(PAGE_REVIEW))
    rows = pages.select(
        product_id.alias("__product"), category.alias("__category"), F.explode(body).alias("r")
    ).select("__product", "__category", "r.*")
    return normalize_page_review(rows, F.col("__product"), F.col("__category"))


def page_meta(pages: DataFrame, product_id: Column, html: str = "html") -> DataFrame:
    """Product metadata embedded as JSON; a page without it gives an empty row."""
    raw = pages.select(
        product_id.alias("product_id"),
        F.from_json(json_island(html, "product-meta"), PAGE_META).alias("m"),
    )
    return raw.select(
        "product_id",
        F.coalesce("m.title", F.lit("")).alias("product_title"),
        parse_price("m.price").alias("price"),
        F.coalesce(F.nullif(F.col("m.brand"), F.lit("")), "m.store").alias("brand"),
        F.col("m.main_category").alias("main_category"),
    )


def _inner_text(block: str, mark: str) -> Column:
    """Text of the first element carrying ``mark``, up to its closing tag."""
    body = F.regexp_extract(block, rf"(?s)<(\w+)[^>]*{mark}[^>]*>(.*?)</\1>", 2)
    return F.trim(F.regexp_replace(body, r"<[^>]+>", ""))


def review_blocks(
    pages: DataFrame, product_id: Column, category: Column, html: str = "html"
) -> DataFrame:
    """Reviews of pages without JSON, cut at the review marker and read by attributes.

    Each block runs to the next marker. An element ends at the first closing tag
    of its own name, so same-named nested elements are cut short.
    """
    blocks = pages.select(
        product_id.alias("__product"),
        category.alias("__category"),
        F.posexplode(F.split(html, BLOCK_MARK)).alias("__pos", "block"),
    ).where(F.col("__pos") > 0)
    stars = _inner_text("block", 'data-hook="(?:cmps-)?review-star-rating"')
    rows = blocks.select(
        "__product",
        "__category",
        F.lit(None).cast("string").alias("id"),
        _inner_text("block", r'class="[^"]*a-profile-name[^"]*"').alias("user_id"),
        F.regexp_extract(stars, STARS, 1).try_cast("double").alias("rating"),
        _inner_text("block", 'data-hook="review-title"').alias("title"),
        _inner_text("block", 'data-hook="review-body"').alias("text"),
        F.col("block").contains('data-hook="avp-badge"').cast("string").alias("verified_purchase"),
        F.lit(None).cast("string").alias("date"),
        F.lit(None).cast("long").alias("helpful_vote"),
    )
    return normalize_page_review(rows, F.col("__product"), F.col("__category"))


def page_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, first heading and paragraphs of any page."""
    return pages.withColumns(
        {
            "title": F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1),
            "heading": F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1),
            "paragraphs": F.regexp_extract_all(html, F.lit(r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1)),
        }
    )


def discover_links(
    pages: DataFrame, page_key: str, html: str = "html", pattern: str = PRODUCT_LINK
) -> DataFrame:
    """Distinct links of each page in the order of their first appearance.

    ``array_distinct`` keeps first occurrences, so nothing is shuffled.
    """
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))
    return pages.select(page_key, F.posexplode(found).alias("place", "link"))
