"""Sources, sinks and normalizers on raw records that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.cleaning import filter_paid
from plumbline.operators.joins import join_reviews_meta, not_yet_done
from plumbline.operators.labels import STRATEGIES, real_label, strategy_sweep
from plumbline.plans.catalog.registry import (
    UNIFIED,
    docs_sql,
    query,
    r6,
    select_body,
    with_micros,
)
from plumbline.schema import META_COLUMNS, REVIEW_COLUMNS
from plumbline.session import scratch_path
from plumbline.sources.files import (
    load_categories,
    load_category,
    load_groundtruth,
    normalize_groundtruth,
    read_reviews,
    save_reviews,
    scan_groundtruth,
    scan_jsonl,
)
from plumbline.sources.normalizers import (
    REVIEW_2023,
    normalize_meta_2014,
    normalize_meta_2023,
    normalize_review_2014,
    normalize_review_2023,
)
from plumbline.sources.pages import (
    discover_links,
    explode_api_meta,
    explode_api_pages,
    page_fields,
    page_meta,
    page_reviews,
    platform_reviews,
    review_blocks,
)
from plumbline.sources.synthetic import Market, phrases_of, synthetic_reviews
from plumbline.sources.tables import reviews_docs, reviews_items, table


def _base(spark: SparkSession, folder: str) -> DataFrame:
    docs, events = table(spark, folder, "documents"), table(spark, folder, "events")
    return docs.join(events, docs.doc_id == events.event_id).select(
        "*",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
    )


BASE = """base AS (SELECT d.*, e.*, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k,
  epoch_us(e.ts) AS us FROM documents d JOIN events e ON d.doc_id = e.event_id)"""


def raw_2023(spark: SparkSession, folder: str) -> DataFrame:
    """Raw review records of the newer edition, with gaps and both field spellings."""
    n = F.col("doc_id")
    return _base(spark, folder).select(
        F.when(n % 4 == 0, n.cast("string")).alias("review_id"),
        F.when(n % 5 == 0, None).when(n % 7 == 0, "").otherwise(F.col("source")).alias("parent_asin"),
        F.col("source").alias("asin"),
        F.when(n % 11 != 0, F.col("user_id").cast("string")).alias("user_id"),
        (F.col("k") % 5 + 1).cast("double").alias("rating"),
        F.when(n % 2 == 0, F.col("event_type")).alias("title"),
        "text",
        F.when(n % 3 == 0, "true").when(n % 3 == 1, "No").alias("verified_purchase"),
        F.when(n % 2 == 0, F.floor(F.col("us") / 1000))
        .otherwise(F.floor(F.col("us") / 1000000))
        .cast("string")
        .alias("timestamp"),
        F.when(n % 2 == 0, F.col("k")).otherwise(0).alias("helpful_vote"),
        F.when(n % 2 == 1, F.col("k")).alias("helpful_votes"),
        "lang",
    )


RAW_2023 = """raw AS (SELECT
  CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id AS VARCHAR) END AS review_id,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '' ELSE source END AS parent_asin,
  source AS asin, CASE WHEN doc_id % 11 <> 0 THEN CAST(user_id AS VARCHAR) END AS user_id,
  CAST(k % 5 + 1 AS DOUBLE) AS rating, CASE WHEN doc_id % 2 = 0 THEN event_type END AS title,
  text, CASE doc_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'No' END AS verified_purchase,
  CASE WHEN doc_id % 2 = 0 THEN us // 1000 ELSE us // 1000000 END AS "timestamp",
  CASE WHEN doc_id % 2 = 0 THEN k ELSE 0 END AS helpful_vote,
  CASE WHEN doc_id % 2 = 1 THEN k END AS helpful_votes, lang FROM base)"""

NORMAL_2023 = """normal AS (SELECT
  coalesce(nullif(review_id, ''), substr(sha1(concat(
    coalesce(nullif(parent_asin, ''), asin), '||', coalesce(user_id, ''), '||', text)), 1, 16))
    AS review_id,
  coalesce(nullif(parent_asin, ''), asin) AS product_id, lang AS product_category,
  coalesce(user_id, '') AS reviewer_id, rating, coalesce(title, '') AS review_title,
  text AS review_text,
  CASE verified_purchase WHEN 'true' THEN true WHEN 'No' THEN false END AS verified_purchase,
  CASE WHEN "timestamp" > 1000000000000 THEN "timestamp" * 1000 ELSE "timestamp" * 1000000 END
    AS review_date,
  coalesce(nullif(helpful_vote, 0), helpful_votes, 0) AS helpful_votes,
  CAST(NULL AS BIGINT) AS total_votes, CAST(NULL AS VARCHAR) AS product_title,
  CAST(NULL AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS brand,
  CAST(NULL AS VARCHAR) AS main_category, 'fallback' AS source FROM raw)"""


@query("normalize_2023", select_body([BASE, RAW_2023, NORMAL_2023], f"SELECT {UNIFIED} FROM normal"))
def normalize_2023(spark, folder):
    return with_micros(normalize_review_2023(raw_2023(spark, folder), F.col("lang")))


@query(
    "normalize_2014",
    select_body(
        [BASE],
        f"""raw AS (SELECT source AS asin, CAST(user_id AS VARCHAR) AS rid, text, event_type,
          us // 1000000 AS sec, lang,
          CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN [k]
            WHEN doc_id % 4 = 2 THEN [k, 0] ELSE [k, k + 3] END AS helpful,
          CASE WHEN doc_id % 9 <> 0 THEN CAST(k % 5 + 1 AS DOUBLE) END AS overall FROM base),
        normal AS (SELECT substr(sha1(concat(asin, '||', rid, '||', text)), 1, 16) AS review_id,
          asin AS product_id, lang AS product_category, rid AS reviewer_id, overall AS rating,
          event_type AS review_title, text AS review_text,
          CAST(NULL AS BOOLEAN) AS verified_purchase, sec * 1000000 AS review_date,
          coalesce(helpful[1], 0) AS helpful_votes, nullif(helpful[2], 0) AS total_votes,
          CAST(NULL AS VARCHAR) AS product_title, CAST(NULL AS DOUBLE) AS price,
          CAST(NULL AS VARCHAR) AS brand, CAST(NULL AS VARCHAR) AS main_category,
          'fallback' AS source FROM raw)
        SELECT {UNIFIED} FROM normal""",
    ),
)
def normalize_2014(spark, folder):
    n, k = F.col("doc_id"), F.col("k")
    raw = _base(spark, folder).select(
        F.col("source").alias("asin"),
        F.col("user_id").cast("string").alias("reviewerID"),
        F.col("text").alias("reviewText"),
        F.col("event_type").alias("summary"),
        F.floor(F.col("us") / 1000000).alias("unixReviewTime"),
        F.when(n % 4 == 1, F.array(k))
        .when(n % 4 == 2, F.array(k, F.lit(0).cast("long")))
        .when(n % 4 == 3, F.array(k, k + 3))
        .alias("helpful"),
        F.when(n % 9 != 0, (k % 5 + 1).cast("double")).alias("overall"),
        "lang",
    )
    return with_micros(normalize_review_2014(raw, F.col("lang")))


@query(
    "normalize_meta",
    """SELECT '2023' AS edition, CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_title,
         CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS price,
         p_brand AS brand, p_type AS main_category FROM part
       UNION ALL
       SELECT '2014', CAST(p_partkey AS VARCHAR), p_name,
         CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END, p_brand,
         CASE WHEN p_partkey % 2 = 0 THEN p_type END FROM part""",
)
def normalize_meta(spark, folder):
    part, n = table(spark, folder, "part"), F.col("p_partkey")
    price = F.when(n % 3 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.col("p_retailprice").cast("string")))
    newer = part.select(
        F.when(n % 2 == 0, n.cast("string")).alias("parent_asin"),
        n.cast("string").alias("asin"),
        F.col("p_name").alias("title"),
        price.alias("price"),
        F.col("p_brand").alias("store"),
        F.col("p_type").alias("main_category"),
    )
    older = part.select(
        n.cast("string").alias("asin"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        price.alias("price"),
        F.when(n % 2 == 0, F.array(F.array("p_type", "p_brand"))).alias("categories"),
    )
    tagged = [
        df.select(F.lit(edition).alias("edition"), "*")
        for edition, df in (("2023", normalize_meta_2023(newer)), ("2014", normalize_meta_2014(older)))
    ]
    return tagged[0].unionByName(tagged[1])


# -- platform pages ----------------------------------------------------------


def api_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Landed API pages: up to 50 neighbouring documents of one app; one in ten failed."""
    n = F.col("doc_id")
    review = F.struct(
        F.when(n % 6 != 0, n.cast("string")).alias("recommendationid"),
        F.struct(
            F.col("user_id").cast("string").alias("steamid"),
            F.when(n % 5 != 0, F.col("k")).alias("num_reviews"),
            (F.col("k") * 2).alias("num_games_owned"),
            F.floor(F.col("value") * 10).alias("playtime_forever"),
        ).alias("author"),
        F.col("text").alias("review"),
        F.floor(F.col("us") / 1000000).alias("timestamp_created"),
        (F.col("k") % 2 == 0).alias("voted_up"),
        F.col("k").alias("votes_up"),
        F.when(n % 2 == 0, F.col("k") % 7).alias("votes_funny"),
        F.when(n % 8 == 0, "none").otherwise(F.concat(F.lit("0."), F.col("k").cast("string"))).alias("weighted_vote_score"),
        (n % 3).alias("comment_count"),
        F.when(n % 4 != 0, n % 4 == 1).alias("steam_purchase"),
        F.when(n % 10 == 0, True).alias("received_for_free"),
        F.lit(False).alias("written_during_early_access"),
    )
    page = F.floor(n / 50)
    app = F.substring("source", 4, 9).cast("long")
    return (
        _base(spark, folder)
        .groupBy(app.alias("app_id"), page.alias("page"))
        .agg(F.collect_list(review).alias("reviews"))
        .select(
            "app_id",
            "page",
            F.to_json(
                F.struct(
                    F.when(F.col("page") % 10 == 9, 0).otherwise(1).alias("success"),
                    F.lit("*").alias("cursor"),
                    "reviews",
                )
            ).alias("payload"),
        )
    )


def api_meta(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("p_partkey")
    data = F.struct(
        F.col("p_name").alias("name"),
        F.when(n % 5 != 0, F.array(F.struct(F.col("p_type").alias("description")))).alias("genres"),
        F.when(n % 4 != 3, F.struct(F.when(n % 3 == 0, 0.0).otherwise(n * 100.0 + 99).alias("final"))).alias("price_overview"),
        F.array("p_brand").alias("developers"),
    )
    node = F.struct((n % 7 != 6).alias("success"), data.alias("data"))
    return table(spark, folder, "part").select(
        F.to_json(F.create_map(n.cast("string"), node)).alias("payload")
    )


GOOD = "WHERE (doc_id // 50) % 10 <> 9"


@query(
    "explode_api_pages",
    select_body(
        [BASE],
        f"""SELECT CAST(substr(source, 4) AS BIGINT) AS app_id, CAST(doc_id // 50 AS BIGINT) AS page,
          CASE WHEN doc_id % 6 <> 0 THEN CAST(doc_id AS VARCHAR) END AS recommendationid,
          CAST(user_id AS VARCHAR) AS steamid, text AS review, k AS votes_up,
          k % 2 = 0 AS voted_up FROM base {GOOD}""",
    ),
)
def explode_api_pages_query(spark, folder):
    rows = explode_api_pages(api_pages(spark, folder))
    return rows.select(
        "app_id", "page", "recommendationid", F.col("author.steamid").alias("steamid"), "review", "votes_up", "voted_up"
    )


PLATFORM_META_SQL = """meta AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id,
  p_name AS product_title,
  CASE WHEN p_partkey % 4 <> 3 AND p_partkey % 3 <> 0
    THEN (p_partkey * 100.0 + 99) / 100 END AS price,
  p_brand AS brand, CASE WHEN p_partkey % 5 <> 0 THEN p_type ELSE 'Steam' END AS main_category
  FROM part WHERE p_partkey % 7 <> 6)"""

PLATFORM_SQL = f"""normal AS (SELECT
  CASE WHEN doc_id % 6 <> 0 THEN CAST(doc_id AS VARCHAR) ELSE substr(sha1(concat(
    substr(b.source, 4), '||', user_id, '||', text)), 1, 16) END AS review_id,
  substr(b.source, 4) AS product_id, coalesce(main_category, 'Steam') AS product_category,
  CAST(user_id AS VARCHAR) AS reviewer_id, CASE WHEN k % 2 = 0 THEN 5.0 ELSE 1.0 END AS rating,
  '' AS review_title, text AS review_text, doc_id % 4 = 1 AS verified_purchase,
  (us // 1000000) * 1000000 AS review_date, k AS helpful_votes,
  CAST(NULL AS BIGINT) AS total_votes, coalesce(product_title, '') AS product_title,
  CAST(price AS DOUBLE) AS price, brand, main_category, 'steam' AS source,
  doc_id % 10 = 0 AS received_for_free,
  CASE WHEN doc_id % 5 <> 0 THEN k ELSE 0 END AS author_num_reviews,
  k * 2 AS author_num_games_owned, CAST(floor(value * 10) AS BIGINT) AS author_playtime_forever,
  CASE WHEN doc_id % 8 = 0 THEN 0.0 ELSE CAST('0.' || k AS DOUBLE) END AS weighted_vote_score,
  CASE WHEN doc_id % 2 = 0 THEN k % 7 ELSE 0 END AS votes_funny, doc_id % 3 AS comment_count,
  false AS early_access
  FROM base b LEFT JOIN meta m ON m.product_id = substr(b.source, 4) {GOOD})"""

EXTRAS = (
    "received_for_free, author_num_reviews, author_num_games_owned, author_playtime_forever, "
    "weighted_vote_score, votes_funny, comment_count, early_access"
)


def platform_table(spark, folder):
    return platform_reviews(api_pages(spark, folder), explode_api_meta(api_meta(spark, folder)))


def platform_sql(body: str) -> str:
    return select_body([BASE, PLATFORM_META_SQL, PLATFORM_SQL], body)


@query("normalize_platform", platform_sql(f"SELECT {UNIFIED}, {EXTRAS} FROM normal"))
def normalize_platform(spark, folder):
    return with_micros(platform_table(spark, folder))


@query(
    "filter_paid",
    platform_sql("SELECT review_id, product_id, price, verified_purchase FROM normal WHERE price > 0"),
)
def filter_paid_query(spark, folder):
    return filter_paid(platform_table(spark, folder)).select(
        "review_id", "product_id", "price", "verified_purchase"
    )


# -- files -------------------------------------------------------------------


def landed_json(spark: SparkSession, folder: str) -> tuple[str, list[str]]:
    """Raw reviews and metadata written as one JSON-lines folder per category."""
    root = scratch_path(spark, "landed")
    raw, part = raw_2023(spark, folder), table(spark, folder, "part")
    cats = sorted(r[0] for r in raw.select("lang").distinct().collect())
    meta = part.select(
        F.concat(F.lit("src"), F.col("p_partkey").cast("string")).alias("parent_asin"),
        F.col("p_name").alias("title"),
        F.concat(F.lit("$"), F.col("p_retailprice").cast("string")).alias("price"),
        F.col("p_brand").alias("store"),
        F.col("p_type").alias("main_category"),
    )
    for c in cats:
        raw.where(F.col("lang") == c).drop("lang").write.json(f"{root}/{c}.jsonl")
        meta.write.json(f"{root}/meta_{c}.jsonl")
    return root, cats


@query(
    "scan_jsonl",
    select_body(
        [BASE, RAW_2023],
        """SELECT review_id, asin, user_id, rating, text, CAST("timestamp" AS VARCHAR) AS "timestamp",
          helpful_vote, lang AS category FROM raw""",
    ),
)
def scan_jsonl_query(spark, folder):
    root, cats = landed_json(spark, folder)
    rows = scan_jsonl(spark, [f"{root}/{c}.jsonl" for c in cats], REVIEW_2023)
    return rows.select(
        "review_id", "asin", "user_id", "rating", "text", "timestamp", "helpful_vote",
        F.col("file_category").alias("category"),
    )


LOADED = """loaded AS (SELECT n.* REPLACE (coalesce(p_name, '') AS product_title,
  p_retailprice AS price, p_brand AS brand, p_type AS main_category)
  FROM normal n LEFT JOIN part ON n.product_id = 'src' || p_partkey)"""


@query(
    "load_category",
    select_body([BASE, RAW_2023, NORMAL_2023, LOADED], f"SELECT {UNIFIED} FROM loaded WHERE product_category = 'en'"),
)
def load_category_query(spark, folder):
    root, _ = landed_json(spark, folder)
    return with_micros(load_category(spark, root, "en"))


@query(
    "union_sources",
    select_body([BASE, RAW_2023, NORMAL_2023, LOADED], f"SELECT {UNIFIED} FROM loaded"),
)
def union_sources_query(spark, folder):
    root, _ = landed_json(spark, folder)
    return with_micros(load_categories(spark, root))


@query("roundtrip_parquet", docs_sql(f"SELECT {UNIFIED.replace('review_date', 'epoch_us(review_date) AS review_date')} FROM reviews_docs"))
def roundtrip_parquet(spark, folder):
    path = scratch_path(spark, "saved")
    save_reviews(reviews_docs(spark, folder), path, ["product_category"])
    return with_micros(read_reviews(spark, path))


# -- labelled file -----------------------------------------------------------


def labelled_rows(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    n = F.col("doc_id")
    return _base(spark, folder).join(labels, "doc_id", "left").select(
        F.col("source").alias("asin"),
        n.cast("string").alias("review_id"),
        F.col("user_id").cast("string").alias("reviewer_id"),
        F.col("event_type").alias("review_title"),
        F.col("text").alias("review_text"),
        (F.col("k") % 3 + 3).cast("double").alias("review_rating"),
        F.date_format("ts", "yyyy-MM-dd").alias("review_date"),
        F.col("lang").alias("product_title"),
        F.col("k").cast("double").alias("number_of_helpful"),
        F.when(n % 5 != 0, (n % 3 != 0).cast("string")).alias("fake_review_product"),
        (F.col("user_id") % 2 == 0).cast("string").alias("reviewer_classified_fake"),
        (F.col("user_id") % 2 == 1).cast("string").alias("reviewer_classified_honest"),
        F.col("toxic").cast("double").alias("reviewer_labeled_fake"),
        (1 - F.col("toxic")).cast("double").alias("reviewer_labeled_honest"),
        F.when(n % 4 != 0, (n % 4 == 1).cast("int")).cast("double").alias("review_is_removed_by_amazon"),
        F.lit(None).cast("string").alias("fake_review_campaign_start_date"),
    )


LABELLED = """labelled AS (SELECT b.source AS product_id, CAST(b.doc_id AS VARCHAR) AS review_id,
  CAST(user_id AS VARCHAR) AS reviewer_id, event_type AS review_title, text AS review_text,
  CAST(k % 3 + 3 AS DOUBLE) AS rating, epoch_us(date_trunc('day', ts)) AS review_date,
  lang AS product_title, k AS helpful_votes, l.toxic AS toxic, b.doc_id AS doc_id,
  (k % 3 = 2 AND b.doc_id % 5 <> 0 AND b.doc_id % 3 <> 0 AND user_id % 2 = 0) AS prime,
  CASE WHEN b.doc_id % 4 <> 0 THEN b.doc_id % 4 = 1 END AS removed
  FROM base b LEFT JOIN labels l ON l.doc_id = b.doc_id)"""

LABEL_SQL = {
    "primary": "CAST(prime AS INT)",
    "primary_or_deleted": "CAST(prime OR coalesce(removed, false) AS INT)",
    "deleted": "CAST(removed AS INT)",
    "labeled": "CAST(toxic = 1 AS INT)",
}

GT_UNIFIED = """review_id, product_id, 'unknown' AS product_category, reviewer_id, rating,
  review_title, review_text, CAST(NULL AS BOOLEAN) AS verified_purchase, review_date,
  helpful_votes, CAST(NULL AS BIGINT) AS total_votes, product_title,
  CAST(NULL AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS brand,
  CAST(NULL AS VARCHAR) AS main_category, 'groundtruth' AS source"""


def landed_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "labelled")
    labelled_rows(spark, folder).write.csv(path, header=True, escape='"', quoteAll=True)
    return scan_groundtruth(spark, path)


@query(
    "scan_groundtruth",
    select_body(
        [BASE, LABELLED],
        """SELECT review_id, product_id AS asin, review_text, rating AS review_rating,
          CAST(toxic AS DOUBLE) AS reviewer_labeled_fake,
          CASE WHEN removed THEN 1.0 WHEN NOT removed THEN 0.0 END AS review_is_removed_by_amazon
          FROM labelled""",
    ),
)
def scan_groundtruth_query(spark, folder):
    return landed_csv(spark, folder).select(
        "review_id", "asin", "review_text", "review_rating", "reviewer_labeled_fake", "review_is_removed_by_amazon"
    )


@query(
    "normalize_groundtruth",
    select_body([BASE, LABELLED], f"SELECT {GT_UNIFIED}, CAST({LABEL_SQL['primary']} AS DOUBLE) AS is_fake FROM labelled"),
)
def normalize_groundtruth_query(spark, folder):
    return with_micros(normalize_groundtruth(labelled_rows(spark, folder)))


@query(
    "load_groundtruth",
    select_body(
        [BASE, LABELLED],
        f"""SELECT {GT_UNIFIED}, {LABEL_SQL['deleted']} AS is_fake FROM labelled WHERE removed IS NOT NULL""",
    ),
)
def load_groundtruth_query(spark, folder):
    return with_micros(load_groundtruth(landed_csv(spark, folder), "deleted"))


def _label_query(strategy: str) -> None:
    sql = f"SELECT review_id, CAST({LABEL_SQL[strategy]} AS DOUBLE) AS is_fake FROM labelled"

    @query(f"groundtruth_label_{strategy}", select_body([BASE, LABELLED], sql))
    def run(spark, folder):
        return labelled_rows(spark, folder).select("review_id", real_label(strategy).alias("is_fake"))


for _strategy in STRATEGIES:
    _label_query(_strategy)


@query(
    "label_strategy_sweep",
    select_body(
        [BASE, LABELLED],
        " UNION ALL ".join(
            f"SELECT '{s}' AS strategy, count({e}) AS n_rows, round(avg({e}), 6) AS fake_rate FROM labelled"
            for s, e in LABEL_SQL.items()
        ),
    ),
)
def label_strategy_sweep(spark, folder):
    return strategy_sweep(labelled_rows(spark, folder)).select("strategy", "n_rows", r6("fake_rate"))


# -- HTML --------------------------------------------------------------------


def island_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Product pages with embedded JSON, one per document; one in six has none."""
    n = F.col("doc_id")
    review = F.struct(
        F.when(n % 2 == 0, n.cast("string")).alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        (F.col("k") % 5 + 1).cast("double").alias("rating"),
        F.col("event_type").alias("title"),
        "text",
        F.when(n % 3 == 0, "yes").when(n % 3 == 1, "y").alias("verified_purchase"),
        F.when(n % 4 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        F.col("k").alias("helpful_vote"),
    )
    meta = F.struct(
        F.col("event_type").alias("title"),
        F.concat(F.lit("$1,0"), (F.col("k") % 90 + 10).cast("string"), F.lit(".50")).alias("price"),
        F.when(n % 2 == 0, "").alias("brand"),
        F.concat(F.lit("store"), F.col("k").cast("string")).alias("store"),
        F.col("lang").alias("main_category"),
    )
    island = '<script id="{}" type="application/json">'
    html = F.concat(
        F.lit("<!doctype html><html><body><h1>page</h1>" + island.format("reviews-data")),
        F.to_json(F.array(review)),
        F.lit("</script>" + island.format("product-meta")),
        F.to_json(meta),
        F.lit("</script></body></html>"),
    )
    bare = F.lit("<html><body>nothing here</body></html>")
    return _base(spark, folder).select(
        "doc_id", "source", "lang", F.when(n % 6 == 5, bare).otherwise(html).alias("html")
    )


@query(
    "html_json_island",
    select_body(
        [BASE],
        """SELECT CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR)
            ELSE substr(sha1(concat(source, '||', user_id, '||', text)), 1, 16) END AS review_id,
          source AS product_id, lang AS product_category, CAST(user_id AS VARCHAR) AS reviewer_id,
          CAST(k % 5 + 1 AS DOUBLE) AS rating, event_type AS review_title, text AS review_text,
          CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS verified_purchase,
          CASE WHEN doc_id % 4 <> 0 THEN epoch_us(date_trunc('day', ts)) END AS review_date,
          k AS helpful_votes FROM base WHERE doc_id % 6 <> 5""",
    ),
)
def html_json_island(spark, folder):
    rows = page_reviews(island_pages(spark, folder), F.col("source"), F.col("lang"))
    return with_micros(rows).select(
        "review_id", "product_id", "product_category", "reviewer_id", "rating", "review_title",
        "review_text", "verified_purchase", "review_date", "helpful_votes",
    )


@query(
    "html_product_meta",
    select_body(
        [BASE],
        """SELECT CAST(doc_id AS VARCHAR) AS product_id,
          CASE WHEN doc_id % 6 <> 5 THEN event_type ELSE '' END AS product_title,
          CASE WHEN doc_id % 6 <> 5 THEN 1000 + k % 90 + 10.5 END AS price,
          CASE WHEN doc_id % 6 <> 5 THEN 'store' || k END AS brand,
          CASE WHEN doc_id % 6 <> 5 THEN lang END AS main_category FROM base""",
    ),
)
def html_product_meta(spark, folder):
    return page_meta(island_pages(spark, folder), F.col("doc_id").cast("string"))


@query(
    "html_review_blocks",
    select_body(
        [BASE],
        """SELECT source AS product_id, CAST(user_id AS VARCHAR) AS reviewer_id,
          CAST(k % 5 AS DOUBLE) + 0.5 AS rating, event_type AS review_title,
          regexp_replace(text, '^[ ]+|[ ]+$', '', 'g') AS review_text, doc_id % 2 = 0 AS verified_purchase
          FROM base""",
    ),
)
def html_review_blocks(spark, folder):
    n = F.col("doc_id")
    block = F.concat(
        F.lit('<div data-hook="review"><span class="a-profile-name">'),
        F.col("user_id").cast("string"),
        F.lit('</span><i data-hook="review-star-rating"><span>'),
        (F.col("k") % 5).cast("string"),
        F.lit('.5 out of 5 stars</span></i><a data-hook="review-title"><span>'),
        F.col("event_type"),
        F.lit("</span></a>"),
        F.when(n % 2 == 0, '<span data-hook="avp-badge">Verified</span>').otherwise(""),
        F.lit('<div data-hook="review-body">'),
        F.col("text"),
        F.lit("</div></div>"),
    )
    pages = _base(spark, folder).groupBy("source", "lang", F.floor(n / 20)).agg(
        F.array_join(F.collect_list(block), "").alias("html")
    )
    return review_blocks(pages, F.col("source"), F.col("lang")).select(
        "product_id", "reviewer_id", "rating", "review_title", "review_text", "verified_purchase"
    )


@query(
    "html_extract_fields",
    r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
          regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS heading,
          CAST(len(regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1)) AS INT) AS n_paragraphs,
          array_to_string(regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1), ' | ') AS paragraphs
        FROM pages""",
)
def html_extract_fields(spark, folder):
    return page_fields(table(spark, folder, "pages")).select(
        "page_id", "title", "heading", F.size("paragraphs").alias("n_paragraphs"),
        F.array_join("paragraphs", " | ").alias("paragraphs"),
    )


@query(
    "html_discover_links",
    """WITH found AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS ls FROM pages),
         rows AS (SELECT page_id, unnest(ls) AS link, unnest(range(len(ls))) AS pos FROM found),
         firsts AS (SELECT page_id, link, min(pos) AS pos FROM rows GROUP BY ALL)
       SELECT page_id, link,
         CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INT) AS place FROM firsts""",
)
def html_discover_links(spark, folder):
    return discover_links(table(spark, folder, "pages"), "page_id", pattern=r'href="([^"]+)"')


# -- joins and generator -----------------------------------------------------


@query(
    "join_reviews_meta",
    docs_sql(
        """meta AS (SELECT 'src' || (p_partkey % 23) AS product_id, max_by(p_name, p_partkey) AS t,
             max_by(p_retailprice, p_partkey) AS p, max_by(p_brand, p_partkey) AS b,
             max_by(p_type, p_partkey) AS m FROM part WHERE p_partkey % 23 <> 7 GROUP BY 1)
           SELECT review_id, r.product_id, coalesce(t, '') AS product_title, p AS price, b AS brand,
             m AS main_category FROM reviews_docs r LEFT JOIN meta USING (product_id)"""
    ),
)
def join_reviews_meta_query(spark, folder):
    part = table(spark, folder, "part")
    meta = part.where(F.col("p_partkey") % 23 != 7).select(
        F.concat(F.lit("src"), (F.col("p_partkey") % 23).cast("string")).alias("product_id"),
        F.col("p_name").alias("product_title"),
        F.col("p_retailprice").alias("price"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("main_category"),
        "p_partkey",
    )
    joined = join_reviews_meta(reviews_docs(spark, folder), meta, F.col("p_partkey"))
    return joined.select("review_id", "product_id", *META_COLUMNS)


@query(
    "incremental_anti_join",
    """SELECT p_partkey AS product_id FROM part
       WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 7)""",
)
def incremental_anti_join(spark, folder):
    items = table(spark, folder, "part").select(F.col("p_partkey").alias("product_id"))
    done = table(spark, folder, "lineitem").where(F.col("l_quantity") == 7)
    return not_yet_done(items, done.select(F.col("l_partkey").alias("product_id")))


_MARKET = Market()
_WHEEL = [s for s, n in _MARKET.stars.items() for _ in range(n)]


def _draw(sides: int, what: str, *parts: str) -> str:
    listed = ", ".join(["'42'", f"'{what}'", "a", *parts])
    return f"CAST('0x' || substr(sha1(concat_ws('|', {listed})), 1, 8) AS BIGINT) % {sides}"


@query(
    "synthetic_reviews",
    f"""WITH openings AS (
        SELECT array_to_string(regexp_extract_all(text, '[A-Za-z]+')[1:6], ' ') AS phrase,
          row_number() OVER (ORDER BY sha1(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS n FROM documents),
      listed AS (SELECT list(phrase ORDER BY n) AS ps FROM openings WHERE n < 40),
      rows AS (SELECT CAST(p_partkey AS VARCHAR) AS a, unnest(range(1, {_MARKET.reviews + 1})) AS j FROM part),
      marked AS (SELECT *, {_draw(100, 'campaign')} < {_MARKET.campaign_percent} AS pushed FROM rows),
      drawn AS (SELECT *,
        ps[1 + CASE WHEN pushed THEN {_draw(40, 'slogan')} ELSE {_draw(40, 'first', 'j')} END] AS one,
        ps[1 + {_draw(40, 'second', 'j')}] AS two,
        CASE WHEN pushed THEN {_draw(365, 'day')} ELSE {_draw(365, 'day', 'j')} END * 1440 AS day,
        {_draw(1440, 'minute', 'j')} * CASE WHEN pushed THEN {_MARKET.campaign_hours / 24}::DOUBLE ELSE 1.0::DOUBLE END AS minute
        FROM marked CROSS JOIN listed)
      SELECT concat_ws(':', 'made', a, j) AS review_id, a AS product_id,
        CASE WHEN pushed THEN 'crew' || {_draw(_MARKET.crew, 'who', 'j')}
          ELSE 'buyer' || {_draw(_MARKET.public, 'who', 'j')} END AS reviewer_id,
        CAST(CASE WHEN pushed THEN 4 + {_draw(2, 'stars', 'j')}
          ELSE {_WHEEL}[1 + {_draw(len(_WHEEL), 'stars', 'j')}] END AS DOUBLE) AS rating,
        concat_ws('. ', one, two) AS review_text,
        NOT pushed AND {_draw(100, 'verified', 'j')} < {_MARKET.verified_percent} AS verified_purchase,
        epoch_us(TIMESTAMP '{_MARKET.year}-01-01') + CAST(day + floor(minute) AS BIGINT) * 60000000 AS review_date,
        {_draw(18, 'votes', 'j')} AS helpful_votes FROM drawn""",
)
def synthetic_reviews_query(spark, folder):
    phrases = phrases_of(table(spark, folder, "documents"))
    raw = synthetic_reviews(table(spark, folder, "part"), "p_partkey", phrases, _MARKET)
    rows = normalize_review_2023(raw, F.lit("made"))
    return with_micros(rows).select(
        "review_id", "product_id", "reviewer_id", "rating", "review_text", "verified_purchase",
        "review_date", "helpful_votes",
    )
