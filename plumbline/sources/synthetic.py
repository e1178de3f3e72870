"""Made-up raw reviews of any size, with campaigns whose reviewers know each other.

Texts are put together from phrases of given documents. Ordinary reviews are
spread over a year and a large pool of reviewers; a campaign pushes its product
within hours, through a small crew that works for many products.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MINUTE = 60_000


@dataclass(frozen=True)
class Market:
    """Rates and sizes of the made-up market."""

    reviews: int = 7
    campaign_percent: int = 15
    crew: int = 12
    public: int = 5000
    year: int = 2022
    campaign_hours: int = 30
    verified_percent: int = 80
    # How often ordinary reviews give one to five stars.
    stars: dict[int, int] = field(default_factory=lambda: {1: 2, 2: 1, 3: 3, 4: 6, 5: 8})


def draw(sides: int, seed: int, *parts: Column | str) -> Column:
    """A number below ``sides`` fixed by the seed and the parts, on any engine."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("long") % sides


def phrases_of(documents: DataFrame, n: int = 40, words: int = 6) -> list[str]:
    """The opening words of ``n`` documents, those first in the order of their ids' digests."""
    opening = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, words), " ")
    first = documents.orderBy(F.sha1(F.col("doc_id").cast("string")), "doc_id").limit(n)
    return [r.phrase for r in first.select(opening.alias("phrase")).collect()]


def synthetic_reviews(
    products: DataFrame, product_id: str, phrases: list[str], market: Market = Market(), seed: int = 42
) -> DataFrame:
    """Raw reviews in the newer edition's layout for every row of ``products``.

    Every value is a hash of product and position, so any part of the table can
    be made by any task.
    """

    def drawn(sides: int, what: str, *parts: str) -> Column:
        return draw(sides, seed, F.lit(what), "parent_asin", *parts)

    def phrase(index: Column) -> Column:
        return F.get(F.array(*[F.lit(p) for p in phrases]), index.cast("int"))

    rows = products.select(
        F.col(product_id).cast("string").alias("parent_asin"),
        F.explode(F.sequence(F.lit(1), F.lit(market.reviews))).alias("j"),
    ).withColumn("campaign", drawn(100, "campaign") < market.campaign_percent)
    wheel = [s for s, n in market.stars.items() for _ in range(n)]
    stars = F.get(F.array(*[F.lit(s) for s in wheel]), drawn(len(wheel), "stars", "j").cast("int"))
    # A campaign has one phrase and adds another to it; others say two things of their own.
    first = phrase(F.when(F.col("campaign"), drawn(len(phrases), "slogan")).otherwise(drawn(len(phrases), "first", "j")))
    second = phrase(drawn(len(phrases), "second", "j"))
    start = F.unix_millis(F.make_timestamp_ntz(F.lit(market.year), *[F.lit(1)] * 2, *[F.lit(0)] * 3).cast("timestamp"))
    day = F.when(F.col("campaign"), drawn(365, "day")).otherwise(drawn(365, "day", "j")) * (24 * 60)
    minute = drawn(24 * 60, "minute", "j") * F.when(F.col("campaign"), F.lit(market.campaign_hours / 24)).otherwise(1.0)
    return rows.select(
        F.concat_ws(":", F.lit("made"), "parent_asin", "j").alias("review_id"),
        "parent_asin",
        F.lit(None).cast("string").alias("asin"),
        F.when(F.col("campaign"), F.concat(F.lit("crew"), drawn(market.crew, "who", "j").cast("string")))
        .otherwise(F.concat(F.lit("buyer"), drawn(market.public, "who", "j").cast("string")))
        .alias("user_id"),
        F.when(F.col("campaign"), 4 + drawn(2, "stars", "j")).otherwise(stars).cast("double").alias("rating"),
        first.alias("title"),
        F.concat_ws(". ", first, second).alias("text"),
        (~F.col("campaign") & (drawn(100, "verified", "j") < market.verified_percent)).cast("string").alias("verified_purchase"),
        (start + (day + F.floor(minute)) * _MINUTE).cast("string").alias("timestamp"),
        drawn(18, "votes", "j").cast("string").alias("helpful_vote"),
        F.lit(None).cast("string").alias("helpful_votes"),
    )
