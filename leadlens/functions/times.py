"""Timestamp text in and out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted layouts, tried in order.
LAYOUTS = (
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
)
STORAGE = LAYOUTS[0]


def parse_utc(text: Column) -> Column:
    """Instant of a stored or ISO timestamp, read as UTC unless it carries an offset; NULL when unreadable."""
    tries = [F.try_to_timestamp(text, F.lit(p)) for p in LAYOUTS]
    return F.coalesce(*tries, text.try_cast("timestamp"))


def parse_naive(text: Column) -> Column:
    """Wall-clock reading of the same forms: an offset, if any, is dropped rather than applied."""
    bare = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    return parse_utc(bare).cast("timestamp_ntz")


def to_storage(ts: Column) -> Column:
    return F.date_format(ts, STORAGE)


def to_iso(text: Column) -> Column:
    """ISO form of a stored timestamp as written; the fraction only when it is not zero."""
    ts = parse_naive(text)
    whole = F.date_format(ts, LAYOUTS[3])
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(F.date_format(ts, LAYOUTS[2]))
