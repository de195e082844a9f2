"""Declared table schemas.  Readers use them instead of inference; ``with_schema`` adds missing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.functions.text import CONDITIONS_TYPE, LABEL_TYPE

META_TYPE = (
    "struct<force_classify:boolean,service_candidate:boolean,model_release:boolean,org:string,model_id:string,"
    "channel:string,forward_from:string,extra:map<string,string>>"
)

TABLES: dict[str, str] = {
    "signals_in": (
        "source string, raw_text string, url string, source_url string, lang string, observed_at timestamp, "
        f"ingest_seq bigint, place array<bigint>, row_key string, meta {META_TYPE}"
    ),
    "services": (
        "id bigint, canonical_domain string, name string, type string, engine string, models array<string>, "
        "status string, reliability double, domain_first_seen timestamp, first_seen timestamp, "
        "last_checked timestamp"
    ),
    "service_aliases": "service_id bigint, canonical_domain string, host string, first_seq bigint",
    "offers": (
        "id bigint, service_id bigint, canonical_domain string, type string, amount double, currency string, "
        f"models array<string>, claim_steps string, requirements string, conditions {CONDITIONS_TYPE}, "
        "referral_required boolean, effort string, unit string, topic string, description string, url string, "
        "status string, score double, notified_at timestamp, first_seen_at timestamp, last_verified_at timestamp"
    ),
    "signals": (
        "id bigint, offer_id bigint, service_id bigint, source string, source_url string, row_key string, url string, "
        f"raw_text string, lang string, classification {LABEL_TYPE}, confidence double, observed_at timestamp"
    ),
    "sources": "id bigint, name string, type string, enabled boolean, last_run timestamp, config string",
    "lead_metrics": (
        "offer_id bigint, first_seen_by_us timestamp, first_seen_in_aggregator timestamp, lead_hours double"
    ),
    "candidates": (
        "id bigint, domain string, first_source string, first_seen timestamp, probed_at timestamp, status string, "
        "probe_result string, attempts int, priority string"
    ),
    "votes": "offer_id bigint, fingerprint string, vote int, created_at timestamp",
    "settings": "key string, value string, updated_at timestamp",
    "page_bodies": (
        "domain string, path string, status int, content_type string, headers map<string,string>, body string"
    ),
    "page_facts": (
        "domain string, alive boolean, status int, title string, engine string, has_pricing boolean, "
        "pricing_triggers boolean, description string, models array<string>, amount double, is_relay boolean, "
        "notice string"
    ),
}

# Column defaults of the stored tables.
DEFAULTS: dict[str, dict[str, object]] = {
    "services": {"type": "other", "status": "new", "reliability": 0.0},
    "offers": {"type": "other", "referral_required": False, "status": "new", "score": 0.0},
    "sources": {"enabled": True},
    "candidates": {"status": "pending", "attempts": 0, "priority": "normal"},
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def empty(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def with_schema(df: DataFrame, table: str) -> DataFrame:
    """Additive migration: project to the declared schema, adding absent columns with their defaults."""
    defaults = DEFAULTS.get(table, {})
    have = set(df.columns)
    columns = []
    for f in schema(table).fields:
        value = F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))
        columns.append(value.cast(f.dataType).alias(f.name))
    return df.select(*columns)


def new_rows(df: DataFrame, table: str) -> DataFrame:
    """Like :func:`with_schema`, and NULLs of defaulted columns filled too."""
    return with_schema(df, table).fillna(DEFAULTS.get(table, {}))
