"""Scalar functions, text functions, cleaning and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import coerce_bool, parse_epoch, parse_price, stable_id
from plumbline.functions.text import (
    STOP_WORDS,
    clean_text,
    drop_stop_words,
    ngrams,
    text_stats,
    tokens,
)
from plumbline.operators.cleaning import (
    clean_reviews,
    coerce_types,
    drop_exact_duplicates,
    flag_exact_duplicates,
)
from plumbline.operators.labels import proxy_label
from plumbline.operators.matrix import design_matrix
from plumbline.plans.catalog.registry import docs_sql, query, r6, with_micros
from plumbline.schema import REVIEW_COLUMNS
from plumbline.sources.tables import reviews_docs, table

STOP_SQL = ", ".join("'" + w + "'" for w in STOP_WORDS)
TOKENS_SQL = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def clean_sql(c: str) -> str:
    """The cleaning rules for the four entities that the pages use."""
    plain = f"coalesce({c}, '')"
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        plain = f"replace({plain}, '{name}', '{char}')"
    return f"trim(regexp_replace(regexp_replace({plain}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    "parse_price",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_retailprice WHEN 1 THEN 1000 + p_partkey % 1000 * 0.5
         WHEN 2 THEN p_partkey END AS price FROM part""",
)
def parse_price_query(spark, folder):
    n = F.col("p_partkey")
    text = (
        F.when(n % 5 == 0, F.concat(F.lit("$"), F.col("p_retailprice").cast("string")))
        .when(n % 5 == 1, F.format_number((n % 1000) * 0.5 + 1000, 2))
        .when(n % 5 == 2, F.concat(F.lit("  "), n.cast("string"), F.lit(" ")))
        .when(n % 5 == 3, "call us")
        .otherwise("")
    )
    return table(spark, folder, "part").select("p_partkey", parse_price(text).alias("price"))


@query(
    "parse_epoch",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000 * 1000
         WHEN 1 THEN epoch_us(ts) // 1000000 * 1000000
         WHEN 2 THEN epoch_us(ts) // 1000000 * 1000000 + 500000 END AS parsed FROM events""",
)
def parse_epoch_query(spark, folder):
    n, us = F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    raw = (
        F.when(n % 4 == 0, F.floor(us / 1000).cast("string"))
        .when(n % 4 == 1, F.floor(us / 1000000).cast("string"))
        .when(n % 4 == 2, F.concat(F.floor(us / 1000000).cast("string"), F.lit(".5")))
        .otherwise("soon")
    )
    return table(spark, folder, "events").select(
        "event_id", F.unix_micros(parse_epoch(raw, "auto")).alias("parsed")
    )


@query(
    "coerce_bool",
    """SELECT event_id, CASE user_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true
         WHEN 3 THEN false WHEN 4 THEN false END AS flag FROM events""",
)
def coerce_bool_query(spark, folder):
    n = F.col("user_id") % 6
    raw = F.when(n == 0, "TRUE").when(n == 1, " yes ").when(n == 2, "Y").when(n == 3, "1.0").when(n == 4, "no")
    return table(spark, folder, "events").select("event_id", coerce_bool(raw).alias("flag"))


@query(
    "stable_id",
    """SELECT doc_id, substr(sha1(concat(source, '||', coalesce(CASE WHEN doc_id % 3 <> 0 THEN lang END, ''),
         '||', text)), 1, 16) AS id16,
         substr(sha1(CAST(doc_id AS VARCHAR)), 1, 24) AS id24 FROM documents""",
)
def stable_id_query(spark, folder):
    lang = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    return table(spark, folder, "documents").select(
        "doc_id",
        stable_id("source", lang, "text").alias("id16"),
        stable_id("doc_id", length=24).alias("id24"),
    )


@query("clean_text", f"SELECT page_id, {clean_sql('html')} AS cleaned FROM pages")
def clean_text_query(spark, folder):
    return table(spark, folder, "pages").select("page_id", clean_text("html").alias("cleaned"))


TEXT_STATS_SQL = r"""text_stats AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS char_count,
  CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS word_count,
  CASE WHEN len(regexp_extract_all(text, '\S+')) > 0 THEN
    length(regexp_replace(text, '\s+', '', 'g')) / len(regexp_extract_all(text, '\S+')) ELSE 0.0 END
    AS avg_word_len,
  CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS exclaim_count,
  CAST(length(text) - length(replace(text, '?', '')) AS BIGINT) AS question_count,
  CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) / length(text)
    ELSE 0.0 END AS upper_ratio,
  CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\p{Nd}]', '', 'g')) / length(text)
    ELSE 0.0 END AS digit_ratio FROM documents)"""


@query(
    "text_stats",
    f"""WITH {TEXT_STATS_SQL} SELECT doc_id, char_count, word_count,
      round(avg_word_len, 6) AS avg_word_len, exclaim_count, question_count,
      round(upper_ratio, 6) AS upper_ratio, round(digit_ratio, 6) AS digit_ratio FROM text_stats""",
)
def text_stats_query(spark, folder):
    stats = table(spark, folder, "documents").select(
        "doc_id", *[c.alias(n) for n, c in text_stats("text").items()]
    )
    ratios = ["avg_word_len", "upper_ratio", "digit_ratio"]
    return stats.withColumns({c: F.round(c, 6) for c in ratios})


@query(
    "tokenize",
    f"""SELECT doc_id, CAST(len({TOKENS_SQL.format('text')}) AS INT) AS n_tokens,
      array_to_string({TOKENS_SQL.format('text')}, ' ') AS tokens FROM documents""",
)
def tokenize_query(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tokens("text").alias("t")).select(
        "doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens")
    )


KEPT_SQL = f"list_filter({TOKENS_SQL.format('text')}, lambda t: t NOT IN ({STOP_SQL}))"


@query(
    "remove_stopwords",
    f"""SELECT doc_id, CAST(len({KEPT_SQL}) AS INT) AS n_tokens,
      array_to_string({KEPT_SQL}, ' ') AS tokens FROM documents""",
)
def remove_stopwords_query(spark, folder):
    kept = drop_stop_words(tokens("text"))
    return table(spark, folder, "documents").select("doc_id", kept.alias("t")).select(
        "doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens")
    )


@query(
    "ngrams",
    f"""WITH k AS (SELECT doc_id, {KEPT_SQL} AS t FROM documents),
      g AS (SELECT doc_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM k)
      SELECT doc_id, CAST(len(g) AS INT) AS n_terms, sha1(array_to_string(g, '|')) AS digest FROM g""",
)
def ngrams_query(spark, folder):
    terms = ngrams(drop_stop_words(tokens("text")), 1, 2)
    return table(spark, folder, "documents").select("doc_id", terms.alias("g")).select(
        "doc_id", F.size("g").alias("n_terms"), F.sha1(F.array_join("g", "|")).alias("digest")
    )


# -- cleaning ----------------------------------------------------------------


def raw_strings(spark, folder) -> DataFrame:
    """Reviews with every value as text, some of them unreadable."""
    n = F.col("review_id").cast("long")
    df = reviews_docs(spark, folder)
    return df.select(
        "review_id",
        "product_id",
        "product_category",
        F.when(n % 13 != 0, F.col("reviewer_id")).alias("reviewer_id"),
        F.when(n % 7 == 0, "five").otherwise(F.col("rating").cast("string")).alias("rating"),
        "review_title",
        "review_text",
        F.when(F.col("verified_purchase"), "Yes").when(~F.col("verified_purchase"), "0").alias("verified_purchase"),
        F.when(n % 5 == 0, "yesterday").otherwise(F.col("review_date").cast("string")).alias("review_date"),
        F.when(n % 9 == 0, "many").otherwise(F.col("helpful_votes").cast("string")).alias("helpful_votes"),
        F.col("total_votes").cast("string").alias("total_votes"),
        "product_title",
        F.when(n % 4 == 0, "").otherwise(F.col("price").cast("string")).alias("price"),
        F.when(n % 2 == 0, F.col("brand")).alias("brand"),
        "main_category",
        "source",
    )


TYPED_SQL = """typed AS (SELECT review_id, product_id, product_category,
  CASE WHEN CAST(review_id AS BIGINT) % 13 <> 0 THEN reviewer_id ELSE '' END AS reviewer_id,
  CASE WHEN CAST(review_id AS BIGINT) % 7 <> 0 THEN rating END AS rating, review_title, review_text,
  verified_purchase,
  CASE WHEN CAST(review_id AS BIGINT) % 5 <> 0 THEN epoch_us(review_date) END AS review_date,
  CASE WHEN CAST(review_id AS BIGINT) % 9 <> 0 THEN helpful_votes ELSE 0 END AS helpful_votes,
  total_votes, coalesce(product_title, '') AS product_title,
  CASE WHEN CAST(review_id AS BIGINT) % 4 <> 0 THEN price END AS price,
  CASE WHEN CAST(review_id AS BIGINT) % 2 = 0 THEN coalesce(brand, '') ELSE '' END AS brand,
  coalesce(main_category, '') AS main_category, source FROM reviews_docs)"""


@query("coerce_types", docs_sql(f"{TYPED_SQL} SELECT * FROM typed"))
def coerce_types_query(spark, folder):
    return with_micros(coerce_types(raw_strings(spark, folder)))


@query(
    "clean_reviews",
    docs_sql(
        f"""{TYPED_SQL}, cleaned AS (SELECT t.* REPLACE ({clean_sql('p.html')} AS review_title,
            {clean_sql('t.review_text')} AS review_text)
          FROM typed t LEFT JOIN pages p ON p.page_id = CAST(t.review_id AS BIGINT))
        SELECT *, count(*) OVER (PARTITION BY product_id, review_text) > 1 AS is_exact_duplicate FROM cleaned"""
    ),
)
def clean_reviews_query(spark, folder):
    pages = table(spark, folder, "pages").select(F.col("page_id").cast("string").alias("review_id"), "html")
    raw = raw_strings(spark, folder).join(pages, "review_id", "left")
    raw = raw.withColumn("review_title", F.col("html")).select(*REVIEW_COLUMNS)
    return with_micros(clean_reviews(raw))


@query(
    "exact_duplicates",
    docs_sql(
        """SELECT review_id, count(*) OVER (PARTITION BY product_id, review_text) > 1 AS is_exact_duplicate,
          count(*) OVER (PARTITION BY product_category, review_text) > 1 AS in_category FROM reviews_docs"""
    ),
)
def exact_duplicates_query(spark, folder):
    df = reviews_docs(spark, folder)
    wide = flag_exact_duplicates(df, ("product_category", "review_text"))
    wide = wide.select("review_id", "product_id", "review_text", F.col("is_exact_duplicate").alias("in_category"))
    return flag_exact_duplicates(wide).select("review_id", "is_exact_duplicate", "in_category")


@query(
    "drop_duplicates",
    docs_sql(
        """SELECT review_id, product_category, review_text FROM reviews_docs
          QUALIFY row_number() OVER (PARTITION BY product_category, review_text
            ORDER BY review_date, review_id) = 1"""
    ),
)
def drop_duplicates_query(spark, folder):
    kept = drop_exact_duplicates(reviews_docs(spark, folder), ("product_category", "review_text"))
    return kept.select("review_id", "product_category", "review_text")


@query(
    "proxy_label",
    docs_sql(
        """SELECT review_id, 1 - CAST(verified_purchase AS INT) AS y, CAST(verified_purchase AS INT) AS y_verified
          FROM reviews_docs WHERE verified_purchase IS NOT NULL"""
    ),
)
def proxy_label_query(spark, folder):
    both = proxy_label(reviews_docs(spark, folder)).transform(
        proxy_label, positive="verified", out="y_verified"
    )
    return both.select("review_id", "y", "y_verified")


@query(
    "design_matrix",
    docs_sql(
        f"""{TEXT_STATS_SQL} SELECT review_id, rating, CAST(helpful_votes AS DOUBLE) AS helpful_votes,
          coalesce(price, 0.0) AS price, CAST(char_count AS DOUBLE) AS char_count,
          CAST(word_count AS DOUBLE) AS word_count, round(avg_word_len, 6) AS avg_word_len,
          CAST(exclaim_count AS DOUBLE) AS exclaim_count, CAST(question_count AS DOUBLE) AS question_count,
          round(upper_ratio, 6) AS upper_ratio, round(digit_ratio, 6) AS digit_ratio,
          round(coalesce((helpful_votes + 1) / (total_votes + 2), 0.0), 6) AS helpful_ratio
          FROM reviews_docs JOIN text_stats ON review_id = CAST(doc_id AS VARCHAR)"""
    ),
)
def design_matrix_query(spark, folder):
    from plumbline.operators.behavior import helpful_ratio

    df = reviews_docs(spark, folder).withColumns(
        {**text_stats("review_text"), "helpful_ratio": helpful_ratio(), "product_verified_ratio": F.lit(0.5)}
    )
    matrix = design_matrix(df, ["review_id"])
    rounded = ["avg_word_len", "upper_ratio", "digit_ratio", "helpful_ratio"]
    return matrix.withColumns({c: F.round(c, 6) for c in rounded})
