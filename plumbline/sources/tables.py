"""Unified review views over the star-schema and document tables of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.skew import ROWS_PER_TASK, dealt_evenly
from plumbline.schema import REVIEW_SCHEMA

# How an event type reads as stars.
EVENT_STARS = {"error": 1, "view": 2, "click": 3, "signup": 4, "purchase": 5}


# Tables of long texts, where every row is worth a core.
LARGE = ["documents", "pages"]


def spread(df: DataFrame) -> DataFrame:
    """Give every core a part of a table whose files split into too few tasks.

    A table of many files already has enough tasks and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in LARGE else df


def _typed(df: DataFrame, columns: dict[str, Column], *extras: Column) -> DataFrame:
    return df.select(
        *[columns[f.name].cast(f.dataType).alias(f.name) for f in REVIEW_SCHEMA.fields], *extras
    )


def reviews_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as review texts, written by the user of the event of equal number."""
    docs, events = table(spark, folder, "documents"), table(spark, folder, "events")
    labels, part = table(spark, folder, "labels"), table(spark, folder, "part")
    joined = (
        docs.join(events, docs.doc_id == events.event_id)
        .join(labels, "doc_id", "left")
        .join(part, part.p_partkey == F.substring("source", 4, 9).cast("long"), "left")
    )
    stars = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in EVENT_STARS.items()])
    votes = F.get_json_object("props", "$.k").cast("long")
    return _typed(
        joined,
        {
            "review_id": F.col("doc_id"),
            "product_id": F.col("source"),
            "product_category": F.col("lang"),
            "reviewer_id": F.col("user_id"),
            "rating": stars,
            "review_title": F.lit(""),
            "review_text": F.col("text"),
            "verified_purchase": F.col("quality") == 1,
            "review_date": F.col("ts"),
            "helpful_votes": votes,
            "total_votes": F.when(F.col("doc_id") % 3 == 0, votes + 10),
            "product_title": F.col("p_name"),
            "price": F.col("p_retailprice"),
            "brand": F.col("p_brand"),
            "main_category": F.col("p_type"),
            "source": F.lit("fallback"),
        },
        F.col("toxic").alias("is_fake"),
    )


def reviews_items(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as reviews of parts by customers; large, without text."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    tasks = -(-lines.count() // ROWS_PER_TASK)
    lines, orders = dealt_evenly(lines, ["l_orderkey"], tasks), dealt_evenly(orders, ["o_orderkey"], tasks)
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    day = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    none = F.lit(None)
    return _typed(
        joined,
        {
            "review_id": F.concat_ws(
                "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day.cast("string")
            ),
            "product_id": F.col("l_partkey"),
            "product_category": F.lit("items"),
            "reviewer_id": F.col("o_custkey"),
            "rating": 1 + F.floor("l_quantity") % 5,
            "review_title": F.lit(""),
            "review_text": F.lit(""),
            "verified_purchase": F.when(F.col("l_returnflag") == "R", False).when(
                F.col("l_returnflag") == "A", True
            ),
            "review_date": F.col("l_shipdate"),
            "helpful_votes": F.round(F.col("l_tax") * 100),
            "total_votes": none,
            "product_title": F.lit(""),
            "price": F.col("l_extendedprice"),
            "brand": none,
            "main_category": none,
            "source": F.lit("fallback"),
        },
    )
