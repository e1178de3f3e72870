"""Scalar parsers as Column expressions: bad input becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts read as true, and the shape of a decimal number.
TRUE_WORDS = ["true", "1", "yes", "y"]
PAGE_TRUE_WORDS = ["true", "1", "yes"]
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Above this size an epoch counts milliseconds; last second of year 9999.
MILLIS_FROM = 1e12
LAST_SECOND = 253402300799


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Double, or null where the text is no plain decimal number."""
    text = F.trim(_col(c).cast("string"))
    return F.when(text.rlike(NUMBER), text).try_cast("double")


def parse_price(c: Column | str) -> Column:
    """``"$1,234.50"`` to 1234.5."""
    return to_number(F.regexp_replace(_col(c).cast("string"), "[$,]", ""))


def parse_epoch(c: Column | str, unit: str = "ms") -> Column:
    """Epoch in ``ms``, ``s`` or ``auto`` (by size) to a UTC timestamp."""
    value = _col(c).try_cast("double")
    if unit == "auto":
        seconds = F.when(F.abs(value) > MILLIS_FROM, value / 1000).otherwise(value)
    elif unit == "ms":
        seconds = value / 1000
    elif unit == "s":
        seconds = value
    else:
        raise ValueError(f"unknown epoch unit {unit!r}")
    inside = F.abs(seconds) <= LAST_SECOND
    return F.timestamp_micros(F.when(inside, F.rint(seconds * 1_000_000)).cast("bigint"))


def coerce_bool(c: Column | str, true_words: list[str] = TRUE_WORDS) -> Column:
    """Three-valued: null stays null, known true words are true, all else is false."""
    return F.lower(F.trim(_col(c).cast("string"))).isin(true_words)


def non_empty(c: Column | str) -> Column:
    """Null in place of an empty string, so that ``coalesce`` skips both."""
    return F.nullif(_col(c), F.lit(""))


def first_filled(*cs: Column | str) -> Column:
    """First value that is neither null nor empty, else an empty string."""
    return F.coalesce(*[non_empty(c) for c in cs], F.lit(""))


def stable_id(*parts: Column | str, length: int = 16) -> Column:
    """Leading hex digits of SHA-1 over the parts joined by ``||``, null as empty."""
    filled = [F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha1(F.concat_ws("||", *filled)), 1, length)


def epoch_micros(c: Column | str) -> Column:
    return F.unix_micros(_col(c).cast("timestamp"))
