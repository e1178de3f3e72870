"""Behavioural signals of reviewers and products, brought back onto each review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.scalars import epoch_micros
from plumbline.operators.skew import HOT_ROWS, ROWS_PER_TASK, join_per_key
from plumbline.session import written_table

DAY_MICROS = 86_400_000_000
_BUCKET_MICROS = 3_600_000_000
# Tasks that the rows of one product go to.
_SPREAD = 4


def reviewer_stats(df: DataFrame) -> DataFrame:
    """History of each reviewer; the two distinct counts aggregate in two steps."""
    return df.groupBy("reviewer_id").agg(
        F.count(F.lit(1)).alias("reviewer_review_count"),
        F.count_distinct("product_id").alias("reviewer_product_count"),
        F.count_distinct("product_category").alias("reviewer_category_breadth"),
        F.avg("rating").alias("reviewer_mean_rating"),
        F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("reviewer_rating_std"),
    )


def corrected_skew(value: str) -> Column:
    """Bias-corrected skewness; 0 for fewer than three values or no spread."""
    n = F.count(value).cast("double")
    spread = F.stddev_pop(value)
    factor = F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.when((n > 2) & (spread > 0), factor * F.skewness(value)).otherwise(0.0)


def product_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("product_review_count"),
        F.avg("rating").alias("product_mean_rating"),
        F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("product_rating_std"),
        corrected_skew("rating").alias("product_rating_skew"),
        F.avg(F.col("verified_purchase").cast("double")).alias("product_verified_ratio"),
    )


def vote_stats(df: DataFrame) -> DataFrame:
    votes = F.col("helpful_votes").cast("double")
    return df.groupBy("product_id").agg(
        F.avg(votes).alias("__votes_mean"),
        F.stddev_samp(votes).alias("__votes_std"),
    )


def burst_peak(
    df: DataFrame,
    key: str,
    window_days: float = 7.0,
    time_col: str = "review_date",
    out: str = "burst_max",
) -> DataFrame:
    """Most events of a key inside any closed window of ``window_days``.

    Each event adds one at its time and takes it away just after the window has
    passed; the peak is the largest running total. Events of equal time are
    merged first. The running total is taken inside buckets of one hour, each
    summed up by (total, largest prefix), and then over those summaries, so a key
    with very many events is spread over as many tasks as it has busy hours.
    Keys without any time get 0.
    """
    width = int(window_days * DAY_MICROS) + 1
    merged = (
        df.select(F.col(key), epoch_micros(time_col).alias("t"))
        .groupBy(key, "t")
        .agg(F.count("t").alias("n"))
    )

    def step(at: Column, d: Column) -> Column:
        return F.struct(F.floor(at / _BUCKET_MICROS).alias("b"), at.alias("at"), d.alias("d"))

    dated = F.array(step(F.col("t"), F.col("n")), step(F.col("t") + width, -F.col("n")))
    undated = F.array(step(F.lit(0).cast("long"), F.lit(0).cast("long")))
    steps = merged.select(key, F.inline(F.when(F.col("t").isNull(), undated).otherwise(dated)))
    # At equal times the departures come first: they lie outside the closed window.
    inside = W.partitionBy(key, "b").orderBy("at", "d").rowsBetween(W.unboundedPreceding, 0)
    summaries = (
        steps.withColumn("run", F.sum("d").over(inside))
        .groupBy(key, "b")
        .agg(F.sum("d").alias("total"), F.max("run").alias("top"))
    )
    before = W.partitionBy(key).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    carried = F.coalesce(F.sum("total").over(before), F.lit(0))
    return (
        summaries.withColumn("top", F.col("top") + carried)
        .groupBy(key)
        .agg(F.greatest(F.max("top"), F.lit(0)).cast("long").alias(out))
    )


def _attach(df: DataFrame, stats: DataFrame, key: str, hot_rows: int) -> DataFrame:
    return join_per_key(df, stats, [key], "review_id", hot_rows=hot_rows)


def add_reviewer_features(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    return _attach(df, reviewer_stats(df), "reviewer_id", hot_rows)


def add_product_features(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Statistics of its product on every row.

    Narrow rows are dealt by product, ``ROWS_PER_TASK`` a task, before they are summed up: a task
    then holds sums of its own products and not of all that its part of the files has.
    """
    salt = F.pmod(F.xxhash64("review_id"), F.lit(_SPREAD)).cast("byte").alias("__salt")
    rated = written_table(df.select("product_id", "rating", "verified_purchase", salt), "rated")
    tasks = max(1, -(-rated.count() // ROWS_PER_TASK))
    stats = written_table(product_stats(rated.repartition(tasks, "product_id", "__salt")), "products")
    counts = stats.select("product_id", "product_review_count")
    return join_per_key(df, stats, ["product_id"], "review_id", counts=counts, hot_rows=hot_rows, tasks=tasks)


def add_burst_features(
    df: DataFrame, window_days: float = 7.0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The peak of its reviewer and of its product on every row, dated or not."""
    # Peaks and rows per key read narrow columns of one stored table.
    df = out = written_table(df, "dated")
    for key, name in (("reviewer_id", "reviewer_burst_max"), ("product_id", "product_burst_max")):
        out = _attach(out, burst_peak(df, key, window_days, out=name), key, hot_rows)
    return out


def helpful_ratio(smoothing: float = 1.0) -> Column:
    """Laplace-smoothed share of helpful votes; null where the total is unknown."""
    return (F.col("helpful_votes") + smoothing) / (F.col("total_votes") + 2 * smoothing)


def votes_zscore() -> Column:
    spread = F.nullif(F.col("__votes_std"), F.lit(0.0))
    return F.coalesce((F.col("helpful_votes") - F.col("__votes_mean")) / spread, F.lit(0.0))


def add_helpful_ratio(
    df: DataFrame, smoothing: float = 1.0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    joined = _attach(df, vote_stats(df), "product_id", hot_rows)
    return joined.withColumns(
        {"helpful_ratio": helpful_ratio(smoothing), "helpful_votes_pz": votes_zscore()}
    ).drop("__votes_mean", "__votes_std")


def cap_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group; Spark limits groups before it shuffles them."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)
