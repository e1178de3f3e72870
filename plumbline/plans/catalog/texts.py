"""Term vectors, sentiment, near-duplicates and the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.sentiment import (
    AFTER_BUT,
    ALPHA,
    BEFORE_BUT,
    BOOST,
    CAPITALS,
    EXCLAIM,
    EXCLAIM_MAX,
    FADE,
    NEGATE,
    NEGATIONS,
    QUESTION,
    QUESTIONS_CAPPED,
    STRONGER,
    WEAKER,
    base_valence,
    sentiment,
)
from plumbline.functions.text import text_stats, tokens
from plumbline.operators.cleaning import flag_exact_duplicates
from plumbline.operators.identity import ROW_ID, with_row_id
from plumbline.operators.near_duplicates import max_sibling_similarity
from plumbline.operators.profile import contrasts
from plumbline.operators.vectors import (
    bag_of_words,
    cluster_top_terms,
    document_count,
    lexical_lean,
    mean_weights,
    tfidf,
    top_terms,
)
from plumbline.plans.catalog.behavior import PROXY_SQL, burst_sql, product_sql, reviewer_sql
from plumbline.plans.catalog.cleaning import STOP_SQL, TEXT_STATS_SQL, TOKENS_SQL
from plumbline.plans.catalog.registry import docs_sql, query, r6, with_micros
from plumbline.plans.features import build_feature_table
from plumbline.session import written_table
from plumbline.sources.tables import reviews_docs, table

# -- term vectors ------------------------------------------------------------

TF_SQL = f"""kept AS (SELECT review_id, list_filter({TOKENS_SQL.format('review_text')},
    lambda t: t NOT IN ({STOP_SQL})) AS t FROM reviews_docs),
  grams AS (SELECT review_id, unnest(list_concat(t,
    list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM kept),
  tf AS (SELECT review_id, term, count(*) AS tf FROM grams GROUP BY ALL),
  terms AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1)"""


def weights_sql(min_df: int, max_df: float, cap: int) -> str:
    return f"""{TF_SQL}, n AS (SELECT count(*) AS n FROM reviews_docs),
      vocab AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM terms, n
        WHERE df >= {min_df} AND df <= {max_df} * n ORDER BY total DESC, term LIMIT {cap}),
      raw AS (SELECT review_id, term, tf * idf AS w FROM tf JOIN vocab USING (term)),
      weights AS (SELECT review_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY review_id)) AS weight FROM raw)"""


DEFAULT_WEIGHTS = weights_sql(5, 0.9, 5000)


@query(
    "bag_of_words",
    docs_sql(f"{TF_SQL} SELECT review_id, term, tf FROM tf JOIN terms USING (term) WHERE df >= 5"),
)
def bag_of_words_query(spark, folder):
    return bag_of_words(reviews_docs(spark, folder))


@query("tfidf", docs_sql(f"{DEFAULT_WEIGHTS} SELECT review_id, term, round(weight, 6) AS weight FROM weights"))
def tfidf_query(spark, folder):
    return tfidf(reviews_docs(spark, folder)).select("review_id", "term", r6("weight"))


MEANS_SQL = f"""{DEFAULT_WEIGHTS}, means AS (SELECT term, sum(weight) / any_value(n) AS mean_weight
  FROM weights, n GROUP BY 1)"""


def _means(spark, folder):
    df = reviews_docs(spark, folder)
    return mean_weights(tfidf(df), document_count(df))


@query(
    "top_terms",
    docs_sql(
        f"""{MEANS_SQL} SELECT term, round(mean_weight, 6) AS mean_weight FROM means
          ORDER BY means.mean_weight DESC, term LIMIT 15"""
    ),
)
def top_terms_query(spark, folder):
    return top_terms(_means(spark, folder)).select("term", r6("mean_weight"))


@query(
    "top_bigrams",
    docs_sql(
        f"""{MEANS_SQL} SELECT term, round(mean_weight, 6) AS mean_weight FROM means WHERE term LIKE '% %'
          ORDER BY means.mean_weight DESC, term LIMIT 10"""
    ),
)
def top_bigrams(spark, folder):
    return top_terms(_means(spark, folder), 10, words=2).select("term", r6("mean_weight"))


@query(
    "lexical_lean",
    docs_sql(
        f"""{DEFAULT_WEIGHTS},
          sizes AS (SELECT count(*) FILTER (WHERE verified_purchase) AS yes,
            count(*) FILTER (WHERE NOT verified_purchase) AS no FROM reviews_docs),
          lean AS (SELECT term, coalesce(sum(weight) FILTER (WHERE NOT verified_purchase), 0) / any_value(no)
            - coalesce(sum(weight) FILTER (WHERE verified_purchase), 0) / any_value(yes) AS lean
            FROM weights JOIN reviews_docs USING (review_id), sizes
            WHERE verified_purchase IS NOT NULL GROUP BY 1)
          (SELECT term, round(lean, 6) AS lean, 'verified' AS side FROM lean ORDER BY lean.lean, term LIMIT 8)
          UNION ALL
          (SELECT term, round(lean, 6) AS lean, 'unverified' AS side FROM lean ORDER BY lean.lean DESC, term LIMIT 8)"""
    ),
)
def lexical_lean_query(spark, folder):
    df = reviews_docs(spark, folder)
    return lexical_lean(tfidf(df, by_document=True), df).select("term", r6("lean"), "side")


@query(
    "cluster_top_terms",
    docs_sql(
        f"""{DEFAULT_WEIGHTS}, c AS (SELECT review_id, CAST(helpful_votes % 3 AS INT) AS cluster FROM reviews_docs),
          sizes AS (SELECT cluster, count(*) AS size FROM c GROUP BY 1),
          m AS (SELECT cluster, term, sum(weight) / any_value(size) AS m
            FROM weights JOIN c USING (review_id) JOIN sizes USING (cluster) GROUP BY 1, 2)
          SELECT cluster, CAST(row_number() OVER w AS INT) AS place, term, round(m, 6) AS mean_weight FROM m
          WINDOW w AS (PARTITION BY cluster ORDER BY m DESC, term) QUALIFY row_number() OVER w <= 8"""
    ),
)
def cluster_top_terms_query(spark, folder):
    df = reviews_docs(spark, folder)
    clusters = df.select("review_id", (F.col("helpful_votes") % 3).cast("int").alias("cluster"))
    return cluster_top_terms(tfidf(df, by_document=True), clusters).select("cluster", "place", "term", r6("mean_weight"))


# -- sentiment ---------------------------------------------------------------


def table_lexicon(spark, folder) -> DataFrame:
    """A lexicon over the words of the benchmark texts, valence -4 to 4 by hash."""
    words = table(spark, folder, "benchmark").select(F.explode(tokens("text")).alias("token")).distinct()
    valence = F.conv(F.substring(F.sha1("token"), 1, 4), 16, 10).cast("long") % 9 - 4
    return words.select("token", valence.cast("double").alias("valence")).where(F.col("valence") != 0)


LEXICON_SQL = f"""lexicon AS (SELECT token,
    CAST(CAST('0x' || substr(sha1(token), 1, 4) AS BIGINT) % 9 - 4 AS DOUBLE) AS valence
    FROM (SELECT DISTINCT unnest({TOKENS_SQL.format('text')}) AS token FROM benchmark)
    WHERE CAST('0x' || substr(sha1(token), 1, 4) AS BIGINT) % 9 <> 4)"""

WORDS_SQL = r"""pieces AS (SELECT review_id, list_filter(list_transform(regexp_split_to_array(review_text, '\s+'),
    lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: length(w) > 1) AS ws
    FROM reviews_docs),
  words AS (SELECT review_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM pieces)"""


@query(
    "sentiment_base",
    docs_sql(
        f"""{LEXICON_SQL}, {WORDS_SQL}, hits AS (SELECT review_id, count(*) AS c, sum(valence) AS v
            FROM words JOIN lexicon ON token = lower(w) GROUP BY 1)
          SELECT review_id, coalesce(c, 0) AS n_hits, coalesce(v, 0.0) AS valence
          FROM reviews_docs LEFT JOIN hits USING (review_id)"""
    ),
)
def sentiment_base(spark, folder):
    return base_valence(reviews_docs(spark, folder), table_lexicon(spark, folder))


def _sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _push_sql() -> str:
    parts = []
    for k, fade in FADE.items():
        loud = f"CASE WHEN mixed AND c{k} THEN {CAPITALS} ELSE 0 END"
        parts.append(
            f"""{fade} * CASE WHEN p{k} IN ({_sql_list(STRONGER)}) THEN sign(valence) * ({BOOST} + {loud})
              WHEN p{k} IN ({_sql_list(WEAKER)}) THEN -sign(valence) * ({BOOST} + {loud}) ELSE 0 END"""
        )
    return " + ".join(parts)


_LAGS = ", ".join(
    f"lag(lower(w), {k}) OVER o AS p{k}, lag(upper(w) = w AND lower(w) <> w, {k}) OVER o AS c{k}" for k in FADE
)
_NEGATED = " OR ".join(f"coalesce(p{k} IN ({_sql_list(NEGATIONS)}), false)" for k in FADE)

SENTIMENT_SQL = f"""{LEXICON_SQL}, {WORDS_SQL},
  ctx AS (SELECT review_id, pos, lower(w) AS token, upper(w) = w AND lower(w) <> w AS caps, {_LAGS} FROM words
    WINDOW o AS (PARTITION BY review_id ORDER BY pos)),
  whole AS (SELECT review_id, count(*) AS n_words, bool_or(caps) AND bool_or(NOT caps) AS mixed,
    min(pos) FILTER (WHERE token = 'but') AS but_at FROM ctx GROUP BY 1),
  v1 AS (SELECT review_id, pos, but_at, n_words, {_NEGATED} AS negated,
    valence + CASE WHEN mixed AND caps THEN sign(valence) * {CAPITALS} ELSE 0 END + {_push_sql()} AS v
    FROM ctx JOIN whole USING (review_id) JOIN lexicon USING (token)),
  v2 AS (SELECT review_id, n_words, CASE WHEN negated THEN v * {NEGATE} ELSE v END
    * CASE WHEN pos < but_at THEN {BEFORE_BUT} WHEN pos > but_at THEN {AFTER_BUT} ELSE 1 END AS v FROM v1),
  sums AS (SELECT review_id, sum(v) AS total, coalesce(sum(v + 1) FILTER (WHERE v > 0), 0) AS up,
    coalesce(sum(1 - v) FILTER (WHERE v < 0), 0) AS down, count(*) AS hits,
    count(*) FILTER (WHERE v = 0) AS flat0, any_value(n_words) AS n_words FROM v2 GROUP BY 1),
  marks AS (SELECT review_id, least(length(review_text) - length(replace(review_text, '!', '')), {EXCLAIM_MAX})
      * {EXCLAIM} + CASE WHEN length(review_text) - length(replace(review_text, '?', '')) > 3 THEN {QUESTIONS_CAPPED}
        WHEN length(review_text) - length(replace(review_text, '?', '')) > 1
        THEN (length(review_text) - length(replace(review_text, '?', ''))) * {QUESTION} ELSE 0 END AS mark,
    regexp_matches(review_text, '\\S') AS any_word FROM reviews_docs),
  parts AS (SELECT review_id, any_word, total + sign(total) * mark AS total,
    up + CASE WHEN up > down THEN mark ELSE 0 END AS up, down + CASE WHEN up < down THEN mark ELSE 0 END AS down,
    n_words - hits + flat0 AS flat FROM marks LEFT JOIN sums USING (review_id)),
  feelings AS (SELECT review_id, coalesce(round(total / sqrt(total * total + {ALPHA}), 4), 0.0) AS sentiment_compound,
    coalesce(round(up / (up + down + flat), 3), 0.0) AS sentiment_pos,
    coalesce(round(down / (up + down + flat), 3), 0.0) AS sentiment_neg,
    coalesce(round(flat / (up + down + flat), 3), CASE WHEN any_word THEN 1.0 ELSE 0.0 END) AS sentiment_neu
    FROM parts)"""


@query("sentiment", docs_sql(f"{SENTIMENT_SQL} SELECT * FROM feelings"))
def sentiment_query(spark, folder):
    return sentiment(reviews_docs(spark, folder), table_lexicon(spark, folder))


@query(
    "eda_contrasts_sentiment",
    docs_sql(
        f"""{SENTIMENT_SQL}, {TEXT_STATS_SQL}, d AS (SELECT r.*, word_count, sentiment_compound,
            count(*) OVER (PARTITION BY product_id, review_text) > 1 AS dup
            FROM reviews_docs r JOIN text_stats ON review_id = CAST(doc_id AS VARCHAR) JOIN feelings USING (review_id))
          SELECT {PROXY_SQL} AS proxy, quantile_cont(word_count, 0.5) AS median_words,
            round(avg(sentiment_compound), 6) AS mean_sentiment, count(*) FILTER (WHERE dup) AS n_exact_duplicates
          FROM d GROUP BY 1"""
    ),
)
def eda_contrasts_sentiment(spark, folder):
    """Median words, mean lexicon sentiment and exact copies on the sides of the proxy label."""
    df = with_row_id(reviews_docs(spark, folder).select("review_id", "product_id", "review_text", "verified_purchase"))
    measured = flag_exact_duplicates(df.withColumns(text_stats("review_text")), spread_by=ROW_ID)
    sides = measured.select(ROW_ID, "verified_purchase", "word_count", "is_exact_duplicate")
    scored = sides.join(sentiment(df, table_lexicon(spark, folder), ROW_ID), ROW_ID)
    # Stored without texts, as means and medians read it.
    return contrasts(written_table(scored, "scored")).withColumn("mean_sentiment", F.round("mean_sentiment", 6))


# -- near-duplicates ---------------------------------------------------------


def similar_sql(group: str) -> str:
    """All pairs by an inner join on terms; fine for the SQL side at small scale."""
    return f"""toks AS (SELECT review_id AS id, {group} AS g, unnest({TOKENS_SQL.format('review_text')}) AS term
      FROM reviews_docs),
    gtf AS (SELECT id, g, term, count(*) AS tf FROM toks GROUP BY ALL),
    gdf AS (SELECT g, term, count(*) AS df FROM gtf GROUP BY ALL),
    gn AS (SELECT {group} AS g, count(*) AS n FROM reviews_docs GROUP BY 1),
    gw AS (SELECT id, g, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w
      FROM gtf JOIN gdf USING (g, term) JOIN gn USING (g)),
    gu AS (SELECT id, g, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM gw),
    gp AS (SELECT a.id, b.id AS other, sum(a.w * b.w) AS c FROM gu a
      JOIN gu b ON a.g = b.g AND a.term = b.term AND a.id <> b.id GROUP BY 1, 2),
    gm AS (SELECT id, max(c) AS c FROM gp GROUP BY 1),
    similar_rows AS (SELECT review_id, coalesce(c, 0.0) AS max_intra_product_similarity
      FROM reviews_docs LEFT JOIN gm ON id = review_id)"""


SIMILAR_OUT = """SELECT review_id, round(max_intra_product_similarity, 6) AS max_intra_product_similarity,
  round(max_intra_product_similarity, 6) >= 0.9 AS is_near_duplicate FROM similar_rows"""


def _similar(spark, folder, group):
    sims = max_sibling_similarity(reviews_docs(spark, folder), group)
    out = sims.select("review_id", r6("max_intra_product_similarity"))
    return out.withColumn("is_near_duplicate", F.col("max_intra_product_similarity") >= 0.9)


@query("near_duplicates", docs_sql(f"{similar_sql('product_id')} {SIMILAR_OUT}"))
def near_duplicates(spark, folder):
    return _similar(spark, folder, "product_id")


@query("near_duplicates_by_category", docs_sql(f"{similar_sql('product_category')} {SIMILAR_OUT}"))
def near_duplicates_by_category(spark, folder):
    return _similar(spark, folder, "product_category")


# -- feature table -----------------------------------------------------------

ROUNDED = [
    "avg_word_len", "upper_ratio", "digit_ratio", "reviewer_mean_rating", "reviewer_rating_std",
    "product_mean_rating", "product_rating_std", "product_rating_skew", "product_verified_ratio",
    "helpful_ratio", "helpful_votes_pz", "max_intra_product_similarity",
]
COUNTED = [
    "char_count", "word_count", "exclaim_count", "question_count", "sentiment_compound", "sentiment_pos",
    "sentiment_neg", "sentiment_neu", "reviewer_review_count", "reviewer_product_count",
    "reviewer_category_breadth", "product_review_count", "reviewer_burst_max", "product_burst_max",
]
KEPT = ["review_id", "product_id", "reviewer_id", "rating", "helpful_votes", "price", "verified_purchase", "is_fake"]

FEATURES_SQL = f"""{TEXT_STATS_SQL}, {SENTIMENT_SQL}, {reviewer_sql('reviews_docs')}, {product_sql('reviews_docs')},
  {burst_sql('reviews_docs', 'reviewer_id', 'reviewer_burst_max')},
  {burst_sql('reviews_docs', 'product_id', 'product_burst_max')},
  {similar_sql('product_id')},
  features AS (SELECT *, (helpful_votes + 1) / (total_votes + 2) AS helpful_ratio,
    coalesce((helpful_votes - votes_mean) / nullif(votes_std, 0), 0.0) AS helpful_votes_pz
    FROM reviews_docs JOIN text_stats ON review_id = CAST(doc_id AS VARCHAR)
    JOIN feelings USING (review_id) JOIN similar_rows USING (review_id)
    JOIN reviewers USING (reviewer_id) JOIN products USING (product_id)
    JOIN reviewer_burst_max_m USING (reviewer_id) JOIN product_burst_max_m USING (product_id))"""


def docs_features(spark, folder) -> DataFrame:
    return build_feature_table(reviews_docs(spark, folder), table_lexicon(spark, folder))


@query(
    "feature_table",
    docs_sql(
        f"""{FEATURES_SQL} SELECT {', '.join(KEPT + COUNTED)},
          {', '.join(f'round({c}, 6) AS {c}' for c in ROUNDED)} FROM features"""
    ),
)
def feature_table(spark, folder):
    return docs_features(spark, folder).select(*KEPT, *COUNTED, *[r6(c) for c in ROUNDED])
