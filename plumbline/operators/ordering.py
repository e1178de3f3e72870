"""Ranks, running totals and quantiles over whole columns without one big sort.

Ordered values fall into buckets by an order-keeping rule, for values of any range
by splitters from a quantile sketch. Totals per bucket are small and are
accumulated first; inside a bucket an ordinary window does the rest. No task sees
more than one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import written_table

# Buckets per factor e of a value's size, and a shift that keeps the buckets of
# every positive double above zero.
_PER_E = 1024
_SHIFT = 1 << 20
_HASH_DIGITS = 4
# Buckets between splitters, a power of two. The sketch places a splitter to within
# a tenth of a bucket, so a bucket holds at most 1.2 / BUCKETS of the rows it counted.
BUCKETS = 1024
_SKETCH_ACCURACY = 10 * BUCKETS


def value_bucket(value: Column) -> Column:
    """Non-decreasing bucket number of a double; the logarithm is monotone."""
    size = F.floor(F.log(F.abs(value)) * _PER_E) + _SHIFT
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")


def with_even_bucket(df: DataFrame, value: str, name: str = "__bucket") -> DataFrame:
    """Add a non-decreasing bucket number of a double column, with about equally many rows in each bucket.

    Splitters come from one pass of a mergeable quantile sketch over ``df``, inside
    the plan that uses them. Rows should hold distinct values: equal ones share a
    bucket. Nulls go to the first bucket and NaN, which sorts last, to the last.
    """
    shares = ", ".join(f"{k / BUCKETS!r}D" for k in range(1, BUCKETS))
    splitters = df.select(
        F.expr(f"percentile_approx(`{value}`, array({shares}), {_SKETCH_ACCURACY})").alias("splitters")
    ).scalar()
    halves = F.array(*[F.lit(BUCKETS >> k) for k in range(1, BUCKETS.bit_length())])

    def step(below: Column, half: Column) -> Column:
        passed = F.get("__splitters", below + half - 1) <= F.col(value)
        return F.when(passed, below + half).otherwise(below)

    placed = df.withColumn("__splitters", splitters)
    return placed.withColumn(name, F.aggregate(halves, F.lit(0), step).cast("long")).drop("__splitters")


def hash_key(id_col: Column | str, seed: int) -> Column:
    """Pseudo-random order of ids that any partitioning and any engine reproduces."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.sha1(F.concat_ws("|", c.cast("string"), F.lit(str(seed))))


def running_totals(
    df: DataFrame,
    strata: list[str],
    order: list[str],
    bucket: Column | str,
    sums: dict[str, Column],
) -> DataFrame:
    """Add, per stratum and in order, the running total of each column of ``sums``.

    ``<name>`` is the total up to and including the row, ``<name>_all`` the total
    of the stratum. ``order`` must agree with ``bucket``, a number or the name of a
    double column to cut evenly; rows that it does not tell apart come one after
    the other.
    """
    by = [*strata, "__bucket"]
    cut = with_even_bucket(df, bucket) if isinstance(bucket, str) else df.withColumn("__bucket", bucket)
    marked = cut.withColumns({f"__{k}": c for k, c in sums.items()})
    totals = marked.groupBy(*by).agg(*[F.sum(f"__{k}").alias(f"__t_{k}") for k in sums])
    whole = W.partitionBy(*strata) if strata else W.partitionBy(F.lit(0))
    before = whole.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in sums],
        *[F.sum(f"__t_{k}").over(whole).alias(f"{k}_all") for k in sums],
    )
    inside = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = marked.join(offsets, by)
    out = out.withColumns({k: F.sum(f"__{k}").over(inside) + F.col(f"__o_{k}") for k in sums})
    helpers = ["__bucket", *[f"__{k}" for k in sums], *[f"__o_{k}" for k in sums]]
    return out.drop(*helpers)


def hash_positions(df: DataFrame, id_col: str, seed: int, strata: list[str]) -> DataFrame:
    """``position`` (from 1) of each row in hash order and ``position_all``, per stratum."""
    keyed = df.withColumn("__hash", hash_key(id_col, seed))
    bucket = F.conv(F.substring("__hash", 1, _HASH_DIGITS), 16, 10).cast("long")
    ranked = running_totals(
        keyed, strata, ["__hash", id_col], bucket, {"position": F.lit(1).cast("long")}
    )
    return ranked.drop("__hash")


def quantiles(
    df: DataFrame, group: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group; nulls are skipped.

    Equal values are counted first, so the ordered part has one row per distinct
    value of a group.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("__n")
    )
    counted = written_table(counted, "values")
    number = F.col(value).cast("double")
    counted = counted.withColumn("__value", number)
    ranked = running_totals(counted, group, [value], "__value", {"__upto": F.col("__n")})

    def at(index: Column) -> Column:
        hit = (F.col("__upto") - F.col("__n") <= index) & (index < F.col("__upto"))
        return F.max(F.when(hit, number))

    parts = []
    for name, p in probs.items():
        place = (F.col("__upto_all") - 1) * F.lit(float(p))
        parts += [
            at(F.floor(place)).alias(f"__lo_{name}"),
            at(F.ceil(place)).alias(f"__hi_{name}"),
            F.max(place - F.floor(place)).alias(f"__f_{name}"),
        ]
    found = ranked.groupBy(*group).agg(F.max("__upto_all").alias("n"), *parts)
    return found.select(
        *group,
        "n",
        *[
            (F.col(f"__lo_{k}") + (F.col(f"__hi_{k}") - F.col(f"__lo_{k}")) * F.col(f"__f_{k}")).alias(k)
            for k in probs
        ],
    )
