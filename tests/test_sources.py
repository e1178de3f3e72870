import gzip
import json

import pytest
from conftest import by_id
from pyspark.sql import functions as F

from plumbline.operators.joins import join_reviews_meta, not_yet_done
from plumbline.schema import EXTRA_TYPES, REVIEW_COLUMNS
from plumbline.sources.files import discover_categories, load_categories, load_category, load_groundtruth, scan_groundtruth
from plumbline.sources.normalizers import PLATFORM_REVIEW, REVIEW_2023, normalize_platform_review, normalize_review_2023
from plumbline.sources.pages import explode_api_meta, page_meta, page_reviews, review_blocks
from plumbline.sources.synthetic import Market, phrases_of, synthetic_reviews
from plumbline.streaming.ingest import ingest_available, latest_per_url, read_landed


@pytest.fixture(scope="module")
def raw_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    reviews = [
        {"parent_asin": "A1", "asin": "A1x", "user_id": "u1", "rating": 5, "title": "t", "text": "one",
         "verified_purchase": True, "timestamp": 1672531200000, "helpful_vote": 3},
        {"asin": "A2", "user_id": "u2", "rating": 2, "text": "two", "verified_purchase": False,
         "timestamp": 1672531200, "helpful_votes": 7},
    ]
    meta = [
        {"parent_asin": "A1", "title": "old", "price": "$1.00", "store": "S", "main_category": "M"},
        {"parent_asin": "A1", "title": "new", "price": 9.99, "store": "S", "main_category": "M"},
    ]
    (root / "Tools.jsonl").write_text("\n".join(json.dumps(r) for r in reviews) + "\n\n  \n")
    (root / "meta_Tools.jsonl").write_text("\n".join(json.dumps(r) for r in meta))
    with gzip.open(root / "Books.jsonl.gz", "wt") as fh:
        fh.write(json.dumps(reviews[0]) + "\n")
    return str(root)


def test_load_category(spark, raw_dir):
    assert discover_categories(spark, raw_dir) == ["Books", "Tools"]
    rows = {r["product_id"]: r for r in load_category(spark, raw_dir, "Tools").collect()}
    assert set(rows) == {"A1", "A2"} and rows["A1"]["helpful_votes"] == 3 and rows["A2"]["helpful_votes"] == 7
    assert rows["A1"]["review_date"].year == rows["A2"]["review_date"].year == 2023
    assert rows["A1"]["price"] == 9.99 and rows["A1"]["product_title"] == "new"
    assert rows["A2"]["product_title"] == "" and rows["A2"]["price"] is None


def test_load_all_and_missing(spark, raw_dir):
    table = load_categories(spark, raw_dir, ["Tools", "Books", "Absent"])
    assert table.columns == REVIEW_COLUMNS and table.count() == 3
    with pytest.raises(FileNotFoundError):
        load_category(spark, raw_dir, "Absent")
    with pytest.raises(ValueError):
        load_categories(spark, raw_dir, edition_name="someone_else")
    assert load_categories(spark, raw_dir, ["Tools"], sample_rows=1).count() == 1


def platform_rows(spark, *objects):
    raw = spark.createDataFrame([(json.dumps(o),) for o in objects], "line string")
    parsed = raw.select(F.from_json("line", PLATFORM_REVIEW).alias("o")).select("o.*")
    return normalize_platform_review(parsed, F.lit("440")).collect()


def test_platform_review_fields(spark):
    liked = {
        "recommendationid": "88001", "voted_up": True, "review": "Runs on an old machine", "timestamp_created": 1510000000,
        "author": {"steamid": "owner-7", "num_reviews": "31", "num_games_owned": 204, "playtime_forever": 95.0},
        "votes_up": "14", "votes_funny": 2, "comment_count": 1, "weighted_vote_score": 0.47, "steam_purchase": False,
        "received_for_free": True, "written_during_early_access": True,
    }
    row = platform_rows(spark, liked)[0].asDict()
    assert (row["review_id"], row["product_id"], row["reviewer_id"], row["rating"]) == ("88001", "440", "owner-7", 5.0)
    assert (row["author_num_reviews"], row["author_num_games_owned"], row["author_playtime_forever"]) == (31, 204, 95)
    assert (row["helpful_votes"], row["votes_funny"], row["comment_count"]) == (14, 2, 1)
    assert row["weighted_vote_score"] == 0.47 and row["received_for_free"] is True and row["early_access"] is True
    assert row["verified_purchase"] is False and row["review_date"].year == 2017
    assert list(row)[-len(EXTRA_TYPES):] == list(EXTRA_TYPES)


def test_platform_review_gaps(spark):
    row = platform_rows(spark, {"review": "meh"})[0]
    assert row["rating"] == 1.0 and row["verified_purchase"] is False and row["received_for_free"] is False
    assert row["author_num_games_owned"] == 0 and row["weighted_vote_score"] == 0.0 and len(row["review_id"]) == 16


def test_platform_meta_entries(spark):
    shop = {
        "620": {"success": True, "data": {"name": "Portico", "developers": ["Arch", "Beam"],
                                          "genres": [{"description": "Puzzle"}, {"description": "Indie"}],
                                          "price_overview": {"final": 1249}}},
        "621": {"success": True, "data": {"name": "Free Portico", "genres": [], "price_overview": {"final": 0}}},
        "622": {"success": False},
    }
    entries = explode_api_meta(spark.createDataFrame([(json.dumps(shop),)], "payload string")).collect()
    found = {r["product_id"]: (r["product_title"], r["price"], r["brand"], r["main_category"]) for r in entries}
    assert found == {"620": ("Portico", 12.49, "Arch", "Puzzle"), "621": ("Free Portico", None, None, "Steam")}


def test_raw_numbers_come_quoted_or_with_a_fraction(spark):
    lines = ['{"rating":"4.0","helpful_vote":3.0}', '{"rating":2,"helpful_votes":"5"}', '{"rating":"none","helpful_vote":"many"}']
    parsed = spark.createDataFrame([(x,) for x in lines], "j string").select(F.from_json("j", REVIEW_2023).alias("r")).select("r.*")
    got = [(r.rating, r.helpful_votes) for r in normalize_review_2023(parsed, F.lit("c")).collect()]
    assert got == [(4.0, 3), (2.0, 5), (None, 0)]


def test_groundtruth_csv(spark, tmp_path):
    path = tmp_path / "labelled.csv"
    path.write_text(
        "review_id,asin,reviewer_id,review_title,review_text,review_rating,review_date,product_title,number_of_helpful,"
        "fake_review_product,reviewer_classified_fake,reviewer_classified_honest,reviewer_labeled_fake,"
        "reviewer_labeled_honest,review_is_removed_by_amazon,fake_review_campaign_start_date,other\n"
        'g1,a,u,t,"two ""quoted""\nlines",5,2021-03-04,p,2.0,True,True,False,1,0,0,,x\n'
        "g2,a,u,t,short,3,bad,p,,True,True,False,,,1,,x\n"
    )
    raw = scan_groundtruth(spark, str(path))
    assert "other" not in raw.columns
    rows = {r["review_id"]: r for r in load_groundtruth(raw).collect()}
    assert rows["g1"]["is_fake"] == 1 and rows["g2"]["is_fake"] == 0
    assert rows["g1"]["review_text"] == 'two "quoted"\nlines' and rows["g2"]["review_date"] is None
    assert rows["g1"]["verified_purchase"] is None and rows["g1"]["source"] == "groundtruth"
    assert load_groundtruth(raw, "labeled").count() == 1


def test_page_island(spark):
    body = json.dumps([{"id": "x1", "user_id": "u", "rating": 4, "text": "ok", "verified_purchase": "y",
                        "date": "2023-01-05", "helpful_vote": 2}, {"user_id": "v", "date": "never"}])
    html = f'<html><script id="reviews-data" type="application/json">{body}</script>'
    html += '<script id="product-meta" type="application/json">{"title": "T", "price": "$3", "store": "S"}</script>'
    pages = spark.createDataFrame([("p", html), ("q", "<html></html>")], "id string, html string")
    rows = {r["reviewer_id"]: r for r in page_reviews(pages, F.col("id"), F.lit("c")).collect()}
    assert rows["u"]["verified_purchase"] is False and rows["u"]["review_date"].day == 5
    assert rows["v"]["review_date"] is None and len(rows["v"]["review_id"]) == 16
    meta = {r["product_id"]: r for r in page_meta(pages, F.col("id")).collect()}
    assert meta["p"]["price"] == 3.0 and meta["p"]["brand"] == "S" and meta["q"]["product_title"] == ""


def test_review_blocks(spark):
    html = (
        '<div data-hook="review"><span class="x a-profile-name">Ann</span><i data-hook="review-star-rating">'
        "<span>4.0 out of 5</span></i><span data-hook=\"avp-badge\">v</span><div data-hook=\"review-body\">"
        "<span>Good\nthing</span></div></div><div data-hook=\"review\"><div data-hook=\"review-body\">No stars</div></div>"
    )
    pages = spark.createDataFrame([(html,)], "html string")
    rows = {r["review_text"]: r for r in review_blocks(pages, F.lit("p"), F.lit("c")).collect()}
    assert rows["Good\nthing"]["rating"] == 4.0 and rows["Good\nthing"]["verified_purchase"] is True
    assert rows["Good\nthing"]["reviewer_id"] == "Ann"
    assert rows["No stars"]["rating"] is None and rows["No stars"]["verified_purchase"] is False


def test_meta_join_with_hot_products(small, spark):
    meta = spark.createDataFrame([("lamp", "T", 1.0, "b", "m")], "product_id string, product_title string, price double, brand string, main_category string")
    titles = by_id(join_reviews_meta(small, meta, hot_rows=1), "product_title")
    assert titles["a1"] == "T" and titles["b1"] == "" and len(titles) == 8
    assert not_yet_done(small, meta).count() == 4


def test_synthetic_campaigns(spark):
    documents = spark.createDataFrame([(i, f"some words of text {chr(97 + i)} and more of it") for i in range(9)], "doc_id long, text string")
    phrases = phrases_of(documents, 5)
    assert len(set(phrases)) == 5 and all(p.startswith("some words of text") for p in phrases)
    market = Market(reviews=8, campaign_percent=25)
    rows = normalize_review_2023(synthetic_reviews(spark.range(200), "id", phrases, market), F.lit("c")).cache()
    assert rows.count() == 1600 and rows.select("review_id").distinct().count() == 1600
    pushed = rows.where(F.col("reviewer_id").startswith("crew"))
    assert 160 < pushed.count() < 720 and pushed.where("rating < 4 OR verified_purchase").isEmpty()
    spans = pushed.groupBy("product_id").agg((F.unix_seconds(F.max("review_date")) - F.unix_seconds(F.min("review_date"))).alias("s"))
    assert spans.agg(F.max("s")).first()[0] <= market.campaign_hours * 3600
    again = normalize_review_2023(synthetic_reviews(spark.range(200).repartition(7), "id", phrases, market), F.lit("c"))
    assert rows.exceptAll(again).isEmpty()


def test_ingest_continues_where_it_stopped(spark, tmp_path):
    landed, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    spark.range(5).write.parquet(landed)
    schema = spark.read.parquet(landed).schema
    for expected in (5, 5, 8):
        if expected == 8:
            spark.range(5, 8).write.mode("append").parquet(landed)
        ingest_available(read_landed(spark, landed, schema), out, marks)
        assert spark.read.parquet(out).count() == expected


def test_latest_page(spark):
    rows = [("u", 1, "old"), ("u", 5, "new"), ("v", -100, "stale")]
    df = spark.createDataFrame(rows, "url string, d int, body string").withColumn(
        "fetched_at", F.timestamp_seconds(F.col("d") * 86400)
    )
    got = latest_per_url(df, F.timestamp_seconds(F.lit(10 * 86400)), 30).collect()
    assert [(r["url"], r["body"]) for r in got] == [("u", "new")]
    tied = df.unionAll(df.where("body = 'new'").withColumn("body", F.lit("newer")))
    assert latest_per_url(tied, F.timestamp_seconds(F.lit(10 * 86400)), 30).first()["body"] == "newer"
