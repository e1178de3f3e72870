"""Labels: the purchase proxy and four readings of the real fake-review label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the label strategies.
STRATEGIES = ["primary", "primary_or_deleted", "deleted", "labeled"]


def proxy_group(flag: Column | str = "verified_purchase") -> Column:
    c = F.col(flag) if isinstance(flag, str) else flag
    return F.when(c, "verified").when(~c, "unverified").otherwise("unknown")


def proxy_label(
    df: DataFrame, flag: str = "verified_purchase", positive: str = "unverified", out: str = "y"
) -> DataFrame:
    """1 for the suspicious side; rows without the flag are left out, never guessed."""
    hit = F.col(flag) if positive == "verified" else ~F.col(flag)
    return df.where(F.col(flag).isNotNull()).withColumn(out, hit.cast("int"))


def real_label(strategy: str) -> Column:
    """``is_fake`` as a double: 1, 0, or null where the strategy does not apply."""
    yes = {
        name: F.coalesce(F.col(name).try_cast("boolean"), F.lit(False))
        for name in ("fake_review_product", "reviewer_classified_fake")
    }
    top_rating = F.coalesce(F.col("review_rating") == 5, F.lit(False))
    primary = top_rating & yes["fake_review_product"] & yes["reviewer_classified_fake"]
    removed = F.col("review_is_removed_by_amazon")
    rules = {
        "primary": primary,
        "primary_or_deleted": primary | F.coalesce(removed == 1, F.lit(False)),
        "deleted": removed == 1,
        "labeled": F.col("reviewer_labeled_fake") == 1,
    }
    if strategy not in rules:
        raise ValueError(f"unknown label strategy {strategy!r}, expected one of {STRATEGIES}")
    return rules[strategy].cast("double")


def strategy_sweep(df: DataFrame) -> DataFrame:
    """Rows and fake rate under every strategy, in one pass over the raw columns."""
    sums = []
    for name in STRATEGIES:
        label = real_label(name)
        sums += [F.count(label).alias(f"n_{name}"), F.avg(label).alias(f"r_{name}")]
    rows = ", ".join(f"'{name}', n_{name}, r_{name}" for name in STRATEGIES)
    return df.agg(*sums).selectExpr(
        f"stack({len(STRATEGIES)}, {rows}) AS (strategy, n_rows, fake_rate)"
    )
