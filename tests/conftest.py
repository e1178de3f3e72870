"""One session for all tests and a small review table with planted patterns."""

from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from plumbline.operators.cleaning import clean_reviews  # noqa: E402
from plumbline.schema import REVIEW_COLUMNS, REVIEW_SCHEMA  # noqa: E402
from plumbline.session import local_session  # noqa: E402

OPENING = dt.datetime(2021, 9, 14, 8, 30, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# Reviews of three shops' goods. Minutes count from the opening.
#   lamp: two texts of the same words, a raw record that came twice under one id,
#         and one without date or purchase flag, with markup to clean
#   kite: one text three times, two of them at one instant, two by one reviewer
#   oar:  no rating and no text
LAMP = "I love this wonderful lamp, light all evening"
GOODS = [
    dict(review_id="a1", product_id="lamp", product_category="Home", reviewer_id="ann", rating=5, review_text=LAMP,
         verified_purchase=True, minutes=0, helpful_votes=4, total_votes=9),
    dict(review_id="a2", product_id="lamp", product_category="Home", reviewer_id="bob", rating=4,
         review_text="light all evening, I love this wonderful lamp", verified_purchase=True, minutes=30, total_votes=1),
    *[dict(review_id="a3", product_id="lamp", product_category="Home", reviewer_id="cyd", rating=1,
           review_text="Terrible lamp and useless", verified_purchase=False, minutes=3 * 1440)] * 2,
    dict(review_id="a4", product_id="lamp", product_category="Home", reviewer_id="dee", rating=2,
         review_text="Switch feels  cheap &amp; <b>wobbly</b>", helpful_votes=2, total_votes=6),
    dict(review_id="b1", product_id="kite", product_category="Toys", reviewer_id="ann", rating=5,
         review_text="Flies well!", verified_purchase=True, minutes=10),
    dict(review_id="b2", product_id="kite", product_category="Toys", reviewer_id="eve", rating=5,
         review_text="Flies well!", verified_purchase=False, minutes=10),
    dict(review_id="b3", product_id="kite", product_category="Toys", reviewer_id="eve", rating=5,
         review_text="Flies well!", verified_purchase=False, minutes=20, helpful_votes=3),
    dict(review_id="c1", product_id="oar", product_category="Boats", reviewer_id="bob", review_text="",
         verified_purchase=True, minutes=40 * 1440, helpful_votes=7, total_votes=7),
]


@pytest.fixture(scope="session")
def small(spark):
    rows = []
    for given in GOODS:
        row = {"helpful_votes": 0, "review_title": "", "product_title": "", "source": "fallback", **given}
        if "minutes" in row:
            row["review_date"] = OPENING + dt.timedelta(minutes=row["minutes"])
        if "rating" in row:
            row["rating"] = float(row["rating"])
        rows.append(tuple(row.get(c) for c in REVIEW_COLUMNS))
    return spark.createDataFrame(rows, REVIEW_SCHEMA)


@pytest.fixture(scope="session")
def cleaned(small):
    return clean_reviews(small).cache()


def by_id(df, column, key="review_id"):
    return {r[key]: r[column] for r in df.select(key, column).collect()}
