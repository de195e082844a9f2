"""Values of JSON columns: text stays as it is, anything else is JSON, and what is no JSON reads back as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encoded_text(value: Column) -> Column:
    """Text is stored unencoded."""
    return value.cast("string")


def encoded(value: Column) -> Column:
    """A struct, array or map as JSON; NULL stays NULL."""
    return F.to_json(value)


def is_json(raw: Column) -> Column:
    return F.coalesce(F.try_parse_json(raw).isNotNull(), F.lit(False))


def decoded(raw: Column, schema: str) -> Column:
    """struct(value, text): the document read with ``schema``, or the text that is no JSON; both NULL for NULL."""
    readable = is_json(raw)
    return F.struct(
        F.when(readable, F.from_json(raw, schema)).alias("value"), F.when(~readable, raw).alias("text")
    )
