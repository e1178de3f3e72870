"""Joins of reviews with product metadata and with what was already collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import HOT_ROWS, join_per_key
from plumbline.schema import META_COLUMNS


def latest_meta(
    meta: DataFrame, order: Column, keys: tuple[str, ...] = ("product_id",)
) -> DataFrame:
    """One metadata row per product: the last in ``order``."""
    packed = F.struct(*META_COLUMNS)
    return meta.groupBy(*keys).agg(F.max_by(packed, order).alias("m")).select(*keys, "m.*")


def join_reviews_meta(
    reviews: DataFrame,
    meta: DataFrame,
    order: Column | None = None,
    keys: tuple[str, ...] = ("product_id",),
    spread_by: str = "review_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join on product; a product without metadata gets an empty title and nulls.

    ``order`` says which of several metadata rows of a product counts (the last);
    without it, products must be unique. No side is forced to be broadcast: the
    metadata grows with the catalogue, so AQE decides by its measured size, and
    products with very many reviews are salted.
    """
    single = meta.select(*keys, *META_COLUMNS) if order is None else latest_meta(meta, order, keys)
    bare = reviews.drop(*META_COLUMNS)
    out = join_per_key(bare, single, list(keys), spread_by, hot_rows=hot_rows)
    return out.withColumn("product_title", F.coalesce("product_title", F.lit("")))


def not_yet_done(items: DataFrame, done: DataFrame, key: str = "product_id") -> DataFrame:
    """Items whose key is not in the manifest of finished ones."""
    return items.join(done.select(key).distinct(), key, "left_anti")
