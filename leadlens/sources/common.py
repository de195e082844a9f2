"""Shared shape of the payload parsers.

A parser maps landed payloads (``payload_id bigint, body string`` and, where it matters, a source or page URL
column) to rows of the signals input.  Arrival order is ``ingest_seq`` (landing time in microseconds where known, else
the payload id) and then ``place``, the array of payload id and positions from the outermost list inwards.  Nothing is
packed into one number, so any number of payloads, entries and nested entries keep their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions.words import bind
from leadlens.schemas import META_TYPE, with_schema

_FLAGS = ("force_classify", "service_candidate", "model_release")
_NAMES = ("org", "model_id", "channel", "forward_from")


def text(value: str | Column) -> Column:
    """A Column for a parameter given as constant or Column."""
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def meta(extra: dict[str, Column] | None = None, **known: Column | bool | None) -> Column:
    """The meta struct: control flags and identities by name, everything else in the ``extra`` map."""
    fields = []
    for name in (*_FLAGS, *_NAMES):
        value = known.get(name)
        kind = "boolean" if name in _FLAGS else "string"
        fields.append((value if isinstance(value, Column) else F.lit(value)).cast(kind).alias(name))
    pairs = [p for k, v in (extra or {}).items() for p in (F.lit(k), v.cast("string"))]
    more = F.create_map(*pairs) if pairs else F.lit(None)
    return F.struct(*fields, more.cast("map<string,string>").alias("extra")).cast(META_TYPE)


def no_meta() -> Column:
    return F.lit(None).cast(META_TYPE)


def signals(
    items: DataFrame,
    source: str | Column,
    raw_text: Column,
    url: Column | None = None,
    source_url: Column | None = None,
    observed_at: Column | None = None,
    meta_value: Column | None = None,
    row_key: Column | None = None,
) -> DataFrame:
    """Rows of the signals input from items that carry ``payload_id`` and ``pos`` (array of positions).

    ``row_key`` tells rows apart that share a ``source_url``, as the links of one listing page do.
    """
    none = F.lit(None).cast("string")
    landed = F.col("landed_at") if "landed_at" in items.columns else F.lit(None).cast("timestamp")
    rows = items.select(
        text(source).alias("source"),
        raw_text.alias("raw_text"),
        (none if url is None else url).alias("url"),
        (none if source_url is None else source_url).alias("source_url"),
        (landed if observed_at is None else observed_at).alias("observed_at"),
        F.coalesce(F.unix_micros(landed.cast("timestamp")), F.col("payload_id").cast("bigint")).alias("ingest_seq"),
        F.concat(F.array(F.col("payload_id").cast("bigint")), F.col("pos").cast("array<bigint>")).alias("place"),
        (none if row_key is None else row_key).alias("row_key"),
        (no_meta() if meta_value is None else meta_value).alias("meta"),
    )
    return with_schema(rows, "signals_in")


def exploded(payloads: DataFrame, array: Column, keep: list[str] | None = None) -> DataFrame:
    """One row per array element: ``payload_id, pos, item`` plus the kept payload columns; ``pos`` is an array, which
    :func:`deeper` extends."""
    kept = [c for c in (keep or []) + ["landed_at"] if c in payloads.columns and c not in ("payload_id",)]
    rows = payloads.select("payload_id", *kept, F.posexplode(array).alias("pos", "item"))
    return rows.withColumn("pos", positions(F.col("pos")))


def first_of_each(items: Column, key: Callable[[Column], Column]) -> Column:
    """Entries (key, n, entry) of an array whose key was not met before in it: duplicates within a payload go before
    the array is exploded, without a shuffle.  Sorted by key; ``n`` is the place of the entry."""
    keyed = F.transform(items, lambda x, n: F.struct(key(x).alias("key"), n.alias("n"), x.alias("entry")))
    fresh = lambda s: F.filter(s, lambda x, n: (n == 0) | ~x["key"].eqNullSafe(F.get(s, n - 1)["key"]))
    return bind(F.array_sort(keyed), fresh)


def exploded_first(payloads: DataFrame, array: Column, key: Callable[[Column], Column], keep: list[str] | None = None) -> DataFrame:
    """Like :func:`exploded`, with the first entry of each ``key`` in a payload only, and its ``key``."""
    rows = exploded(payloads, first_of_each(array, key), keep)
    return rows.withColumns({"pos": positions(F.col("item.n")), "key": F.col("item.key"), "item": F.col("item.entry")})


def positions(*parts: Column) -> Column:
    return F.array(*[p.cast("bigint") for p in parts])


def deeper(part: Column) -> Column:
    """Position of a nested entry: that of its list, then its own."""
    return F.concat("pos", positions(part))


def first_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order, decided by an aggregation with map-side partial results."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*rows.columns)


def empty_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def first_chars(value: Column | str, cap: int | None) -> Column:
    """The whole text, or its first ``cap`` characters where a caller asks for a cap."""
    value = F.col(value) if isinstance(value, str) else value
    return value if cap is None else F.substring(value, 1, cap)


def trim_chars(value: Column, chars: str) -> Column:
    return F.btrim(value, F.lit(chars))
