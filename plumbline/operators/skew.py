"""Joins onto aggregates that hold up when one key owns a large share of the rows.

AQE splits a skewed join only where both sides come straight from a shuffle. The
usual shape here, rows joined to an aggregate of themselves, has an aggregation
in between, so hot keys are salted explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key above this many rows is spread over several tasks. The list of hot keys
# that gets broadcast has at most (total rows / HOT_ROWS) entries.
HOT_ROWS = 1_000_000
# Rows that a task sorts for a join where their number is known.
ROWS_PER_TASK = 1_000_000

_N = "__rows"
_SPLITS = "__splits"
_SALT = "__salt"


def dealt_evenly(df: DataFrame, by: list[str], tasks: int) -> DataFrame:
    """``df`` in so many tasks by its keys, where the session's shuffles have fewer; else as it is."""
    held = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *by) if tasks > held else df


def row_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(_N))


def join_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    spread_by: Column | str,
    how: str = "left",
    counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    tasks: int = 0,
) -> DataFrame:
    """Join ``rows`` to a table with one row, or a few, per key.

    Rows per key are counted on the key columns alone, or taken from ``counts``
    (the keys and one column of upper bounds; keys that cannot be hot may be
    missing). ``spread_by`` is a column that differs between the rows of one key.
    ``tasks`` is what the rows need, where their number is known.
    """
    if counts is None:
        counts, n = row_counts(rows, keys), F.col(_N)
    else:
        n = F.col(next(c for c in counts.columns if c not in keys))
    hot = F.broadcast(
        counts.where(n > hot_rows).select(*keys, F.ceil(n / hot_rows).cast("int").alias(_SPLITS))
    )
    splits = F.coalesce(F.col(_SPLITS), F.lit(1))
    spread = F.xxhash64(F.col(spread_by) if isinstance(spread_by, str) else spread_by)
    salted = (
        rows.join(hot, keys, "left")
        .withColumn(_SALT, F.pmod(spread, splits).cast("int"))
        .drop(_SPLITS)
    )
    copies = (
        per_key.join(hot, keys, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), splits - 1)))
        .drop(_SPLITS)
    )
    by = [*keys, _SALT]
    salted, copies = (dealt_evenly(side, by, tasks) for side in (salted, copies))
    return salted.join(copies, by, how).drop(_SALT)


def block_pairs(
    rows: DataFrame,
    group: list[str],
    n_col: str,
    id_col: str,
    block_rows: int,
) -> DataFrame:
    """Cut each group into blocks and send every block to each pair it belongs to.

    A task then sees one pair (``block_lo``, ``block_hi``) of at most about
    ``2 * block_rows`` rows, however large the group; ``block`` tells which of
    the two a row came from. ``n_col`` holds the number of rows of the group.
    """
    n_blocks = F.ceil(F.col(n_col) / block_rows).cast("int")
    return (
        rows.withColumn("block", F.pmod(F.xxhash64(id_col, *group), n_blocks).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        .withColumn("block_lo", F.least("block", "__other"))
        .withColumn("block_hi", F.greatest("block", "__other"))
        .drop("__other")
    )
