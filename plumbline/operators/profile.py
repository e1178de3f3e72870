"""Descriptive tables: profiles, balances, contrasts and box-plot summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import epoch_micros
from plumbline.operators.labels import proxy_group
from plumbline.operators.ordering import quantiles


def table_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    flag = F.col("verified_purchase")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        distinct("product_id").alias("n_products"),
        distinct("reviewer_id").alias("n_reviewers"),
        F.min(epoch_micros("review_date")).alias("first_micros"),
        F.max(epoch_micros("review_date")).alias("last_micros"),
        F.count_if(flag).alias("n_verified"),
        F.count_if(~flag).alias("n_unverified"),
        F.avg(F.coalesce(flag, F.lit(False)).cast("int")).alias("verified_rate"),
    )


def class_balance(df: DataFrame) -> DataFrame:
    return df.groupBy(proxy_group().alias("proxy")).agg(F.count(F.lit(1)).alias("n_rows"))


def rating_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy(proxy_group().alias("proxy"), "rating").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def box_summary(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Quartiles, extremes and whiskers at 1.5 interquartile ranges, all exact."""
    data = df.where(F.col(value).isNotNull()).select(
        *group, F.col(value).cast("double").alias("v")
    )
    counted = data.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("c"))
    parts = quantiles(data, group, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - reach, F.col("q3") + reach
    return (
        counted.join(parts, group)
        .groupBy(*group)
        .agg(
            F.max("n").alias("n_rows"),
            F.min("v").alias("min"),
            *[F.max(c).alias(c) for c in ("q1", "median", "q3")],
            F.max("v").alias("max"),
            F.min(F.when(F.col("v") >= low, F.col("v"))).alias("whisker_low"),
            F.max(F.when(F.col("v") <= high, F.col("v"))).alias("whisker_high"),
        )
    )


def contrasts(df: DataFrame) -> DataFrame:
    """Median words, mean sentiment and flagged copies per side of the proxy."""
    marked = df.withColumn("proxy", proxy_group())
    means = marked.groupBy("proxy").agg(
        F.avg("sentiment_compound").alias("mean_sentiment"),
        F.count_if("is_exact_duplicate").alias("n_exact_duplicates"),
    )
    medians = quantiles(marked, ["proxy"], "word_count", {"median_words": 0.5}).drop("n")
    return medians.join(means, "proxy")


def means_by_proxy(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its mean on either side of the proxy."""
    flag = F.col("verified_purchase")
    sides = {"verified": flag, "unverified": ~flag}
    sums = [
        F.avg(F.when(cond, F.col(c))).alias(f"{c}__{side}")
        for c in columns
        for side, cond in sides.items()
    ]
    rows = ", ".join(f"'{c}', `{c}__verified`, `{c}__unverified`" for c in columns)
    return df.agg(*sums).selectExpr(
        f"stack({len(columns)}, {rows}) AS (feature, verified, unverified)"
    )


def product_summary(df: DataFrame, by: str = "product_title") -> DataFrame:
    """Rows, verified and free shares (null counts as no) and the first price."""

    def share(name: str):
        return F.avg(F.coalesce(F.col(name), F.lit(False)).cast("int"))

    free = share("received_for_free") if "received_for_free" in df.columns else F.lit(None)
    priced = F.when(F.col("price").isNotNull(), F.col("review_id"))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        share("verified_purchase").alias("verified_rate"),
        free.cast("double").alias("free_rate"),
        F.min_by("price", priced).alias("first_price"),
    )
