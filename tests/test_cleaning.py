import pytest
from conftest import by_id
from pyspark.sql import functions as F

from plumbline.functions.scalars import coerce_bool, parse_epoch, parse_price, stable_id
from plumbline.functions.text import clean_text, ngrams, text_stats, tokens
from plumbline.operators.cleaning import clean_reviews, drop_exact_duplicates, flag_exact_duplicates
from plumbline.operators.labels import STRATEGIES, proxy_label, real_label, strategy_sweep
from plumbline.schema import validate_schema
from plumbline.sources.normalizers import normalize_review_2014


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("a &amp; b   c", "a & b c"),
        ("Fine<br />item <b>really</b>", "Fine item really"),
        ("one&lt;br&gt;two", "one two"),
        ("ＡＢＣ", "ABC"),
        ("no break", "no break"),
        (None, ""),
        ("plain <i>ascii</i>", "plain ascii"),
    ],
)
def test_clean_text(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(clean_text("t")).first()[0] == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("of&amp;&amp;&amp<b>x</b>", "of&&&amp x"),
        ("?a=1&copy=2&quo", "?a=1&copy=2&quo"),
        ("&eacute;&#233;&#xE9; &none; &#;", "ééé &none; &#;"),
        ("&amp;quot;", "&quot;"),
    ],
)
def test_entities_end_with_a_semicolon(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(clean_text("t")).first()[0] == expected


def test_clean_text_lowercase(spark):
    df = spark.createDataFrame([("Loud TEXT",)], "t string")
    assert df.select(clean_text("t", lowercase=True)).first()[0] == "loud text"


def test_clean_reviews(cleaned):
    flags = by_id(cleaned, "is_exact_duplicate")
    assert {k for k, v in flags.items() if v} == {"a3", "b1", "b2", "b3"}
    assert by_id(cleaned, "verified_purchase")["a4"] is None
    assert by_id(cleaned, "review_text")["a4"] == "Switch feels cheap & wobbly"
    assert cleaned.count() == 9


def test_drop_exact_duplicates(cleaned):
    left = drop_exact_duplicates(cleaned)
    assert left.columns == cleaned.columns
    assert sorted(r.review_id for r in left.collect()) == ["a1", "a2", "a3", "a4", "b1", "b2", "c1"]
    left = drop_exact_duplicates(cleaned, ("product_id", "review_text")).collect()
    assert sorted(r.review_id for r in left) == ["a1", "a2", "a3", "a4", "b1", "c1"]


def test_copies_of_raw_records_share_an_id_and_are_dropped(spark):
    raw = [("p", "u", "fine", "5.0")] * 3 + [("p", "u", "bad", "1.0")]
    df = spark.createDataFrame(raw, "asin string, reviewerID string, reviewText string, overall string").selectExpr(
        "*", "'' AS summary", "'1400000000' AS unixReviewTime", "array('1', '2.0') AS helpful"
    )
    rows = clean_reviews(normalize_review_2014(df, F.lit("c")))
    assert rows.select("review_id").distinct().count() == 2
    assert sorted(r.rating for r in drop_exact_duplicates(rows).collect()) == [1.0, 5.0]
    assert rows.select("helpful_votes", "total_votes").distinct().collect() == [(1, 2)]


def test_duplicates_do_not_depend_on_salting(small):
    plain = by_id(flag_exact_duplicates(small), "is_exact_duplicate")
    assert plain == by_id(flag_exact_duplicates(small, hot_rows=1), "is_exact_duplicate")


def test_missing_column_is_named(small):
    with pytest.raises(ValueError, match="rating"):
        validate_schema(small.drop("rating"))


def test_prices(spark):
    df = spark.createDataFrame([("$12.99",), ("1,234.50",), ("12.99",), ("",), ("n/a",), (None,)], "p string")
    got = [r[0] for r in df.select(parse_price("p")).collect()]
    assert got == [12.99, 1234.5, 12.99, None, None, None]


def test_epochs(spark):
    df = spark.createDataFrame([("1672531200000",), ("1672531200",), ("soon",), (None,)], "t string")
    years = [r[0] for r in df.select(F.year(parse_epoch("t", "auto"))).collect()]
    assert years == [2023, 2023, None, None]


def test_bools(spark):
    df = spark.createDataFrame([("TRUE",), (" y ",), ("1.0",), ("no",), (None,)], "b string")
    assert [r[0] for r in df.select(coerce_bool("b")).collect()] == [True, True, False, False, None]


def test_stable_id(spark):
    import hashlib

    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    assert df.select(stable_id("x", "y", "z")).first()[0] == hashlib.sha1(b"a||||c").hexdigest()[:16]


def test_text_stats(cleaned):
    stats = cleaned.select("review_id", *[c.alias(n) for n, c in text_stats("review_text").items()])
    assert by_id(stats, "word_count")["a1"] == 8
    assert by_id(stats, "exclaim_count")["a1"] == 0 and by_id(stats, "exclaim_count")["b1"] == 1
    empty = cleaned.limit(1).select(*[c.alias(n) for n, c in text_stats(F.lit("")).items()]).first()
    assert set(empty) == {0}


def test_ngrams_of_short_texts(spark):
    df = spark.createDataFrame([("one two three",), ("only",), ("",)], "t string")
    got = [r[0] for r in df.select(ngrams(tokens("t"))).collect()]
    assert got == [["one", "two", "three", "one two", "two three"], ["only"], []]


LABELLED = [
    # id, rating, fake product, fake reviewer, removed, labelled, and the four labels
    ("g1", 5.0, "True", "True", 0.0, 1.0, [1, 1, 0, 1]),
    ("g2", 3.0, "True", "True", 0.0, 0.0, [0, 0, 0, 0]),
    ("g3", 5.0, "False", "False", 1.0, None, [0, 1, 1, None]),
    ("g4", 5.0, "False", "True", 0.0, None, [0, 0, 0, None]),
    ("g5", 5.0, "True", "False", 1.0, 0.0, [0, 1, 1, 0]),
    ("g6", 5.0, "True", "True", None, None, [1, 1, None, None]),
    ("g7", None, None, None, None, None, [0, 0, None, None]),
]


@pytest.fixture(scope="module")
def labelled(spark):
    schema = (
        "review_id string, review_rating double, fake_review_product string, reviewer_classified_fake string, "
        "review_is_removed_by_amazon double, reviewer_labeled_fake double"
    )
    return spark.createDataFrame([r[:6] for r in LABELLED], schema)


@pytest.mark.parametrize("place, strategy", list(enumerate(STRATEGIES)))
def test_real_labels(labelled, place, strategy):
    got = by_id(labelled.withColumn("y", real_label(strategy)), "y")
    assert got == {r[0]: r[6][place] for r in LABELLED}


def test_label_sweep_and_unknown_strategy(labelled):
    sweep = {r["strategy"]: (r["n_rows"], r["fake_rate"]) for r in strategy_sweep(labelled).collect()}
    assert sweep["deleted"] == (5, 0.4) and sweep["labeled"][0] == 3
    with pytest.raises(ValueError):
        real_label("guess")


def test_proxy_label(cleaned):
    y = by_id(proxy_label(cleaned), "y")
    assert "a4" not in y and y["a3"] == 1 and y["a1"] == 0
