"""Seeded samples, splits and folds that any partitioning reproduces.

Rows are placed in the hash order of their ids. Rows with one id stand next to
each other and have a place each, so repeated ids are neither lost nor multiplied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordering import hash_positions


def sample_rows(
    df: DataFrame, id_col: str, n: int, seed: int = 42, strata: list[str] | None = None
) -> DataFrame:
    """``n`` rows (per stratum), the first in the hash order of their ids."""
    placed = hash_positions(df, id_col, seed, strata or [])
    return placed.where(F.col("position") <= n).select(*df.columns)


def stratified_split(
    df: DataFrame, id_col: str, label: str, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``part``: the same share of every label goes to ``test``."""
    placed = hash_positions(df, id_col, seed, [label])
    in_test = F.col("position") <= F.round(F.col("position_all") * test_size)
    return placed.select(*df.columns, F.when(in_test, "test").otherwise("train").alias("part"))


def stratified_folds(
    df: DataFrame, id_col: str, label: str, k: int, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Add a fold number from 0 to ``k - 1``, spread evenly over every label."""
    placed = hash_positions(df, id_col, seed, [label])
    fold = ((F.col("position") - 1) % k).cast("int")
    return placed.select(*[c for c in df.columns if c != out], fold.alias(out))


def fold_count(df: DataFrame, label: str, wanted: int) -> int:
    """At least 2, at most ``wanted``, at most the size of the smallest class."""
    smallest = df.groupBy(label).count().agg(F.min("count")).first()[0]
    return max(2, min(wanted, smallest))
