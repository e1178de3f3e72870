"""Behavioural features, profiles, samples and graph signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.sentiment import base_valence, sentiment
from plumbline.functions.text import text_stats
from plumbline.operators.behavior import (
    add_burst_features,
    add_helpful_ratio,
    add_product_features,
    add_reviewer_features,
    burst_peak,
    cap_per_group,
)
from plumbline.operators.cleaning import flag_exact_duplicates
from plumbline.operators.labels import proxy_group
from plumbline.operators.profile import (
    box_summary,
    class_balance,
    contrasts,
    means_by_proxy,
    product_summary,
    rating_histogram,
    table_profile,
)
from plumbline.operators.sampling import sample_rows, stratified_folds, stratified_split
from plumbline.plans.catalog.cleaning import TEXT_STATS_SQL
from plumbline.plans.catalog.registry import docs_sql, items_sql, query, r6
from plumbline.plans.catalog.sources import platform_sql, platform_table
from plumbline.session import written_table
from plumbline.sources.tables import reviews_docs, reviews_items, table

PROXY_SQL = """CASE WHEN verified_purchase THEN 'verified' WHEN NOT verified_purchase
  THEN 'unverified' ELSE 'unknown' END"""


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def reviewer_sql(view: str) -> str:
    return f"""reviewers AS (SELECT reviewer_id, count(*) AS reviewer_review_count,
      count(DISTINCT product_id) AS reviewer_product_count,
      count(DISTINCT product_category) AS reviewer_category_breadth,
      avg(rating) AS reviewer_mean_rating,
      coalesce(stddev_samp(rating), 0.0) AS reviewer_rating_std FROM {view} GROUP BY 1)"""


def product_sql(view: str) -> str:
    return f"""products AS (SELECT product_id, count(*) AS product_review_count,
      avg(rating) AS product_mean_rating, coalesce(stddev_samp(rating), 0.0) AS product_rating_std,
      CASE WHEN count(rating) > 2 AND stddev_pop(rating) > 0 THEN skewness(rating) ELSE 0.0 END
        AS product_rating_skew,
      avg(CAST(verified_purchase AS DOUBLE)) AS product_verified_ratio,
      avg(helpful_votes) AS votes_mean, stddev_samp(helpful_votes) AS votes_std
      FROM {view} GROUP BY 1)"""


@query(
    "reviewer_features",
    items_sql(
        f"""{reviewer_sql('reviews_items')} SELECT review_id, reviewer_review_count, reviewer_product_count,
          reviewer_category_breadth, round(reviewer_mean_rating, 6) AS reviewer_mean_rating,
          round(reviewer_rating_std, 6) AS reviewer_rating_std FROM reviews_items JOIN reviewers USING (reviewer_id)"""
    ),
)
def reviewer_features(spark, folder):
    out = add_reviewer_features(reviews_items(spark, folder)).select(
        "review_id", "reviewer_review_count", "reviewer_product_count", "reviewer_category_breadth",
        "reviewer_mean_rating", "reviewer_rating_std",
    )
    return _rounded(out, "reviewer_mean_rating", "reviewer_rating_std")


@query(
    "product_features",
    items_sql(
        f"""{product_sql('reviews_items')} SELECT review_id, product_review_count,
          round(product_mean_rating, 6) AS product_mean_rating, round(product_rating_std, 6) AS product_rating_std,
          round(product_rating_skew, 6) AS product_rating_skew,
          round(product_verified_ratio, 6) AS product_verified_ratio
          FROM reviews_items JOIN products USING (product_id)"""
    ),
)
def product_features(spark, folder):
    ratios = ["product_mean_rating", "product_rating_std", "product_rating_skew", "product_verified_ratio"]
    out = add_product_features(reviews_items(spark, folder)).select("review_id", "product_review_count", *ratios)
    return _rounded(out, *ratios)


@query(
    "helpful_ratio",
    docs_sql(
        f"""{product_sql('reviews_docs')} SELECT review_id,
          round((helpful_votes + 1) / (total_votes + 2), 6) AS helpful_ratio,
          round(coalesce((helpful_votes - votes_mean) / nullif(votes_std, 0), 0.0), 6) AS helpful_votes_pz
          FROM reviews_docs JOIN products USING (product_id)"""
    ),
)
def helpful_ratio_query(spark, folder):
    out = add_helpful_ratio(reviews_docs(spark, folder))
    return out.select("review_id", r6("helpful_ratio"), r6("helpful_votes_pz"))


def burst_sql(view: str, key: str, out: str, micros: str = "epoch_us(review_date)") -> str:
    """Independent form: a self-join that counts the events of the week up to each event."""
    return f"""{out}_t AS (SELECT {key} AS k, {micros} AS t FROM {view}),
      {out}_c AS (SELECT a.k, a.t, count(*) AS c FROM (SELECT DISTINCT k, t FROM {out}_t) a
        JOIN {out}_t b ON a.k = b.k AND b.t BETWEEN a.t - 604800000000 AND a.t GROUP BY 1, 2),
      {out}_m AS (SELECT k AS {key}, max(c) AS {out} FROM {out}_c GROUP BY 1)"""


@query(
    "burst_max",
    f"""WITH events2 AS (SELECT user_id, ts AS review_date FROM events),
      {burst_sql('events2', 'user_id', 'burst_max')} SELECT user_id, burst_max FROM burst_max_m""",
)
def burst_max(spark, folder):
    return burst_peak(table(spark, folder, "events"), "user_id", 7.0, "ts")


@query(
    "burst_features",
    items_sql(
        f"""{burst_sql('reviews_items', 'reviewer_id', 'reviewer_burst_max')},
          {burst_sql('reviews_items', 'product_id', 'product_burst_max')}
          SELECT review_id, reviewer_burst_max, product_burst_max FROM reviews_items
          JOIN reviewer_burst_max_m USING (reviewer_id) JOIN product_burst_max_m USING (product_id)"""
    ),
)
def burst_features(spark, folder):
    items = reviews_items(spark, folder).select("review_id", "reviewer_id", "product_id", "review_date")
    return add_burst_features(items).select(
        "review_id", "reviewer_burst_max", "product_burst_max"
    )


@query(
    "cap_per_group",
    items_sql(
        """SELECT product_id, review_id, CAST(row_number() OVER w AS INT) AS place FROM reviews_items
          WINDOW w AS (PARTITION BY product_id ORDER BY review_date DESC, review_id)
          QUALIFY row_number() OVER w <= 3"""
    ),
)
def cap_per_group_query(spark, folder):
    capped = cap_per_group(
        reviews_items(spark, folder), ["product_id"], [F.desc("review_date"), F.asc("review_id")], 3
    )
    return capped.select("product_id", "review_id", "place")


# -- profiles ----------------------------------------------------------------


@query(
    "table_profile",
    items_sql(
        """SELECT count(*) AS n_rows, count(DISTINCT product_id) AS n_products,
          count(DISTINCT reviewer_id) AS n_reviewers, min(epoch_us(review_date)) AS first_micros,
          max(epoch_us(review_date)) AS last_micros, count(*) FILTER (WHERE verified_purchase) AS n_verified,
          count(*) FILTER (WHERE NOT verified_purchase) AS n_unverified,
          round(avg(CAST(coalesce(verified_purchase, false) AS INT)), 6) AS verified_rate FROM reviews_items"""
    ),
)
def table_profile_query(spark, folder):
    return _rounded(table_profile(reviews_items(spark, folder)), "verified_rate")


@query("class_balance", items_sql(f"SELECT {PROXY_SQL} AS proxy, count(*) AS n_rows FROM reviews_items GROUP BY 1"))
def class_balance_query(spark, folder):
    return class_balance(reviews_items(spark, folder))


@query(
    "rating_histogram",
    items_sql(f"SELECT {PROXY_SQL} AS proxy, rating, count(*) AS n_rows FROM reviews_items GROUP BY 1, 2"),
)
def rating_histogram_query(spark, folder):
    return rating_histogram(reviews_items(spark, folder))


@query(
    "box_summary",
    items_sql(
        f"""v AS (SELECT {PROXY_SQL} AS proxy, price AS v FROM reviews_items),
          q AS (SELECT proxy, count(*) AS n_rows, min(v) AS lo, max(v) AS hi,
            quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY 1)
          SELECT proxy, any_value(n_rows) AS n_rows, round(any_value(lo), 6) AS "min", round(any_value(q1), 6) AS q1,
            round(any_value(med), 6) AS median, round(any_value(q3), 6) AS q3, round(any_value(hi), 6) AS "max",
            round(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
            round(max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high
          FROM v JOIN q USING (proxy) GROUP BY 1"""
    ),
)
def box_summary_query(spark, folder):
    df = reviews_items(spark, folder).withColumn("proxy", proxy_group())
    out = box_summary(df, ["proxy"], "price")
    return _rounded(out, "min", "q1", "median", "q3", "max", "whisker_low", "whisker_high")


@query(
    "eda_contrasts",
    docs_sql(
        f"""{TEXT_STATS_SQL}, d AS (SELECT r.*, word_count, upper_ratio,
            count(*) OVER (PARTITION BY product_id, review_text) > 1 AS dup
            FROM reviews_docs r JOIN text_stats ON review_id = CAST(doc_id AS VARCHAR))
          SELECT {PROXY_SQL} AS proxy, quantile_cont(word_count, 0.5) AS median_words,
            round(avg(upper_ratio), 6) AS mean_sentiment, count(*) FILTER (WHERE dup) AS n_exact_duplicates
          FROM d GROUP BY 1"""
    ),
)
def eda_contrasts(spark, folder):
    """The share of capitals stands in for the score, so that SQL can follow."""
    df = reviews_docs(spark, folder).withColumns(text_stats("review_text"))
    flagged = flag_exact_duplicates(df).select(
        "verified_purchase", "word_count", F.col("upper_ratio").alias("sentiment_compound"), "is_exact_duplicate"
    )
    # Stored without texts, as means and medians read it.
    return _rounded(contrasts(written_table(flagged, "flagged")), "mean_sentiment")


@query(
    "behavior_means_by_proxy",
    docs_sql(
        f"""{TEXT_STATS_SQL}, d AS (SELECT r.*, word_count, upper_ratio
            FROM reviews_docs r JOIN text_stats ON review_id = CAST(doc_id AS VARCHAR))
          """
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, round(avg({c}) FILTER (WHERE verified_purchase), 6) AS verified,
              round(avg({c}) FILTER (WHERE NOT verified_purchase), 6) AS unverified FROM d"""
            for c in ("helpful_votes", "word_count", "upper_ratio", "rating", "total_votes")
        )
    ),
)
def behavior_means_by_proxy(spark, folder):
    df = reviews_docs(spark, folder).withColumns(text_stats("review_text"))
    out = means_by_proxy(df, ["helpful_votes", "word_count", "upper_ratio", "rating", "total_votes"])
    return _rounded(out, "verified", "unverified")


@query(
    "product_summary",
    platform_sql(
        """SELECT product_title, count(*) AS n_rows, round(avg(CAST(verified_purchase AS INT)), 6) AS verified_rate,
          round(avg(CAST(received_for_free AS INT)), 6) AS free_rate,
          min_by(price, review_id) FILTER (WHERE price IS NOT NULL) AS first_price FROM normal GROUP BY 1"""
    ),
)
def product_summary_query(spark, folder):
    return _rounded(product_summary(platform_table(spark, folder)), "verified_rate", "free_rate")


# -- samples -----------------------------------------------------------------


@query(
    "seeded_sample",
    items_sql(
        """SELECT review_id, product_id FROM reviews_items
          ORDER BY sha1(review_id || '|42'), review_id LIMIT 2000"""
    ),
)
def seeded_sample(spark, folder):
    return sample_rows(reviews_items(spark, folder), "review_id", 2000, 42).select("review_id", "product_id")


LABELLED_ITEMS = "WHERE verified_purchase IS NOT NULL"


@query(
    "stratified_split",
    items_sql(
        f"""n AS (SELECT review_id, verified_purchase AS v,
            row_number() OVER (PARTITION BY verified_purchase ORDER BY sha1(review_id || '|42'), review_id) AS p,
            count(*) OVER (PARTITION BY verified_purchase) AS c FROM reviews_items {LABELLED_ITEMS})
          SELECT review_id, v AS y, CASE WHEN p <= round(c * 0.2) THEN 'test' ELSE 'train' END AS part FROM n"""
    ),
)
def stratified_split_query(spark, folder):
    df = reviews_items(spark, folder).where(F.col("verified_purchase").isNotNull())
    return stratified_split(df.select("review_id", F.col("verified_purchase").alias("y")), "review_id", "y")


@query(
    "stratified_folds",
    items_sql(
        f"""SELECT review_id, verified_purchase AS y,
            CAST((row_number() OVER (PARTITION BY verified_purchase
              ORDER BY sha1(review_id || '|42'), review_id) - 1) % 5 AS INT) AS fold
          FROM reviews_items {LABELLED_ITEMS}"""
    ),
)
def stratified_folds_query(spark, folder):
    df = reviews_items(spark, folder).where(F.col("verified_purchase").isNotNull())
    return stratified_folds(df.select("review_id", F.col("verified_purchase").alias("y")), "review_id", "y", 5)
