"""Cleaning of the unified review table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import coerce_bool, to_number
from plumbline.functions.text import clean_text
from plumbline.operators.skew import HOT_ROWS, join_per_key
from plumbline.schema import REVIEW_SCHEMA, TEXT_COLUMNS, validate_schema
from plumbline.session import written_table

_WHOLE = 2.0**62


def coerce_types(df: DataFrame) -> DataFrame:
    """Cast to the canonical types; what cannot be read becomes null, or 0 for votes."""

    def whole(name: str):
        number = F.coalesce(F.col(name).try_cast("double"), to_number(name))
        return F.when(F.abs(number) < _WHOLE, number).cast("long")

    columns = {}
    for field in REVIEW_SCHEMA.fields:
        name, kind = field.name, field.dataType
        if name not in df.columns:
            continue
        if name == "helpful_votes":
            columns[name] = F.coalesce(whole(name), F.lit(0)).cast("long")
        elif kind == T.LongType():
            columns[name] = whole(name)
        elif kind == T.DoubleType():
            number = F.col(name).try_cast("double")
            columns[name] = F.when(~F.isnan(number), number)
        elif kind == T.BooleanType():
            columns[name] = coerce_bool(name)
        elif kind == T.TimestampType():
            columns[name] = F.col(name).try_cast("timestamp")
        else:
            columns[name] = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return df.withColumns(columns)


def normalize_text(
    df: DataFrame, columns: list[str] = TEXT_COLUMNS, lowercase: bool = False
) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: clean_text(c, lowercase) for c in present})


def fill_missing(df: DataFrame) -> DataFrame:
    """Votes to 0, texts to empty; the label keeps its nulls."""
    fills = {"helpful_votes": 0, **{c: "" for c in TEXT_COLUMNS}}
    return df.na.fill({k: v for k, v in fills.items() if k in df.columns})


def _with_keys(df: DataFrame, subset: list[str]) -> tuple[DataFrame, list[str]]:
    """Digests stand in for long texts and nulls, so shuffle keys stay short and match."""
    keys = [f"__k_{c}" for c in subset if c in df.columns]
    return (
        df.withColumns(
            {f"__k_{c}": F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("")) for c in subset if c in df.columns}
        ),
        keys,
    )


def flag_exact_duplicates(
    df: DataFrame,
    subset: tuple[str, ...] = ("product_id", "review_text"),
    spread_by: str = "review_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Mark every member of a group of equal rows.

    Groups are counted with map-side partial sums and only groups of two or more
    are joined back, salted where copies are many.
    """
    keyed, keys = _with_keys(df, list(subset))
    if not keys:
        return df.withColumn("is_exact_duplicate", F.lit(False))
    repeated = (
        keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__copies")).where(F.col("__copies") > 1)
    )
    joined = join_per_key(
        keyed, repeated, keys, spread_by, counts=repeated, hot_rows=hot_rows
    )
    flag = F.col("__copies").isNotNull()
    return joined.withColumn("is_exact_duplicate", flag).drop(*keys, "__copies")


def drop_exact_duplicates(
    df: DataFrame, subset: tuple[str, ...] = ("product_id", "reviewer_id", "review_text")
) -> DataFrame:
    """Keep the earliest row (then the smallest id) of each group of equal rows.

    Whole rows are aggregated, so rows with one id are told apart, each task
    hands on one row per group it saw, and the input is read once.
    """
    keyed, keys = _with_keys(df, list(subset))
    when = F.coalesce(F.unix_micros("review_date"), F.lit(2**62).cast("long"))
    order = F.struct(when, "review_id", F.xxhash64(*df.columns))
    first = F.min_by(F.struct(*df.columns), order).alias("__first")
    return keyed.groupBy(*keys).agg(first).select("__first.*")


def filter_paid(df: DataFrame) -> DataFrame:
    return df.where(F.col("price") > 0)


def clean_reviews(df: DataFrame) -> DataFrame:
    """Check, cast, clean texts, fill gaps, flag exact duplicates; rows are never dropped.

    The cleaned rows are stored before they are flagged, since counting copies and
    flagging rows both read them and texts should be cleaned once.
    """
    clean = validate_schema(df).transform(coerce_types).transform(normalize_text).transform(fill_missing)
    return flag_exact_duplicates(written_table(clean, "clean"))
