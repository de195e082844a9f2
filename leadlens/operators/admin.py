"""Upkeep: purge, source configuration, settings, topic map, snapshot export."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens import lexicon as lx
from leadlens.functions.display import sql_literal
from leadlens.functions.domains import is_blocked
from leadlens.functions.words import truthy_number, truthy_text
from leadlens.schemas import new_rows, schema, with_schema


# ------------------------------------------------------------------ purge
@dataclass(frozen=True)
class Purged:
    services: DataFrame
    offers: DataFrame
    signals: DataFrame
    lead_metrics: DataFrame
    counters: DataFrame


def purge_blocked(
    services: DataFrame, offers: DataFrame, signals: DataFrame, lead_metrics: DataFrame, blocked=lx.BLOCKED_DOMAINS
) -> Purged:
    """Remove services on the block list with their offers, signals and lead metrics.  Votes and candidates stay."""
    bad = services.where(is_blocked(F.col("canonical_domain"), blocked)).select(F.col("id").alias("service_id"))
    bad_offers = offers.join(bad, "service_id", "left_semi").select(F.col("id").alias("offer_id"))
    counters = bad.agg(F.count("*").alias("services"))
    for name, frame in (("offers", bad_offers), ("signals", signals.join(bad, "service_id", "left_semi"))):
        counters = counters.unionByName(frame.agg(F.count("*").alias(name)), allowMissingColumns=True)
    counters = counters.agg(*[F.max(c).alias(c) for c in ("services", "offers", "signals")])
    return Purged(
        services=services.where(~is_blocked(F.col("canonical_domain"), blocked)),
        offers=offers.join(bad, "service_id", "left_anti"),
        signals=signals.join(bad, "service_id", "left_anti"),
        lead_metrics=lead_metrics.join(bad_offers, "offer_id", "left_anti"),
        counters=counters,
    )


# ------------------------------------------------------------------ sources table
def source_id(name: Column) -> Column:
    return F.xxhash64(F.lit("source"), name)


def upsert_sources(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert by name: type, config and enabled follow the change; id and last run stay."""
    new = changes.select("name", *[F.col(c).alias(f"_{c}") for c in ("type", "config", "enabled")], F.lit(True).alias("_new"))
    out = sources.join(new, "name", "full_outer").withColumns(
        {
            "id": F.coalesce("id", source_id(F.col("name"))),
            "type": F.when(F.col("_new"), F.col("_type")).otherwise(F.col("type")),
            "config": F.when(F.col("_new"), F.col("_config")).otherwise(F.col("config")),
            "enabled": F.when(F.col("_new"), F.coalesce("_enabled", F.lit(True))).otherwise(F.col("enabled")),
        }
    )
    return with_schema(out, "sources")


def update_sources(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """Partial update by id: NULL in a change keeps the stored value."""
    new = changes.select("id", *[F.col(c).alias(f"_{c}") for c in ("enabled", "config", "name")])
    out = sources.join(new, "id", "left")
    out = out.withColumns({c: F.coalesce(f"_{c}", c) for c in ("enabled", "config", "name")})
    return with_schema(out, "sources")


def delete_sources(sources: DataFrame, ids: DataFrame) -> DataFrame:
    return sources.join(ids.select("id"), "id", "left_anti")


def sync_sources(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Insert-or-ignore one enabled row per registered source; existing rows keep their edits."""
    fresh = registry.join(sources.select("name"), "name", "left_anti").select(
        source_id(F.col("name")).alias("id"), "name", F.col("kind").alias("type"), F.lit("{}").alias("config")
    )
    return with_schema(sources, "sources").unionByName(new_rows(fresh, "sources"))


def mark_run(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Set the last run of the named sources."""
    at = runs.groupBy("name").agg(F.max("ran_at").alias("_at"))
    out = sources.join(at, "name", "left").withColumn("last_run", F.coalesce("_at", "last_run"))
    return with_schema(out, "sources")


def list_sources(sources: DataFrame, source_type: str | None = None) -> DataFrame:
    if source_type is None:
        return sources.orderBy("type", "id")
    return sources.where(F.col("type") == source_type).orderBy("id")


def config_interval(config: Column) -> Column:
    """Interval override inside a config document; NULL when absent or not an integer."""
    return F.get_json_object(config, "$.interval").try_cast("int")


def registry_view(registry: DataFrame, sources: DataFrame) -> DataFrame:
    """Registered sources with their stored switch and effective interval (override, own, 900)."""
    stored = sources.select("name", F.col("enabled").alias("_enabled"), config_interval(F.col("config")).alias("_interval"))
    return registry.join(stored, "name", "left").select(
        "name",
        F.coalesce("label", "name").alias("label"),
        F.coalesce("kind", F.lit("generic")).alias("kind"),
        F.coalesce("mode", F.lit("poll")).alias("mode"),
        F.coalesce(truthy_number(F.col("_interval")), F.col("interval"), F.lit(lx.DEFAULT_INTERVAL)).alias("interval"),
        F.coalesce("_enabled", F.lit(True)).alias("enabled"),
        "requires",
    )


def enabled_sources(registry: DataFrame, sources: DataFrame) -> DataFrame:
    """Registered sources that are not switched off; a missing row counts as on."""
    return registry.join(sources.where(~F.col("enabled")).select("name"), "name", "left_anti")


def pollable(registry: DataFrame) -> DataFrame:
    return registry.where(F.coalesce("mode", F.lit("poll")) == "poll")


def keys_needed(registry: DataFrame) -> DataFrame:
    """Inverted index key to sources, one row per pair with the number of sources the key unlocks."""
    pairs = registry.where(truthy_text(F.col("requires")).isNotNull()).select(
        F.col("requires").alias("key"), F.col("name").alias("unlocks")
    )
    counts = pairs.groupBy("key").agg(F.count("*").alias("n_unlocks"))
    return pairs.join(counts, "key").orderBy("key", "unlocks")


def with_interval(config: Column, interval: Column) -> Column:
    """Config document with its interval set; an unreadable document is replaced."""
    entries = F.coalesce(F.from_json(config, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    kept = F.map_filter(entries, lambda k, _v: k != "interval")
    added = F.when(interval.isNotNull(), F.create_map(F.lit("interval"), interval.cast("string")))
    return F.to_json(F.coalesce(F.map_concat(kept, added), kept))


def enabled_channels(sources: DataFrame) -> DataFrame:
    """Channels to listen to, with the topic each is restricted to."""
    channel = truthy_text(F.get_json_object("config", "$.channel"))
    return (
        sources.where((F.col("type") == "telegram") & F.col("enabled"))
        .select(channel.alias("channel"), F.get_json_object("config", "$.topic_id").try_cast("bigint").alias("topic_id"))
        .where(F.col("channel").isNotNull())
    )


def channel_source_name(channel: Column, topic_id: Column) -> Column:
    """Unique name of a channel source: ``@name`` or ``@name#topic``."""
    name = F.trim(F.ltrim(channel, F.lit("@")))
    topic = F.when(truthy_number(topic_id).isNotNull(), F.concat(F.lit("#"), topic_id.cast("string"))).otherwise("")
    return F.concat(F.lit("@"), name, topic)


# ------------------------------------------------------------------ settings and topics
def settings_defaults(spark) -> DataFrame:
    rows = [(k, json.dumps(v, ensure_ascii=False)) for k, v in lx.SETTINGS_DEFAULTS.items()]
    return spark.createDataFrame(rows, "key string, value string")


def overlay_settings(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """Every default and stored key; the stored value wins."""
    s = stored.select("key", F.col("value").alias("_value"))
    return defaults.join(s, "key", "full_outer").select("key", F.coalesce("_value", "value").alias("value"))


def upsert_settings(stored: DataFrame, changes: DataFrame, defaults: DataFrame, as_of: Column) -> DataFrame:
    """Upsert changes of known keys; others are ignored."""
    known = changes.join(defaults.select("key"), "key", "left_semi").select("key", "value")
    kept = with_schema(stored, "settings").join(known.select("key"), "key", "left_anti")
    return kept.unionByName(with_schema(known.withColumn("updated_at", as_of.cast("timestamp")), "settings"))


def topic_map(overrides: DataFrame, stored: DataFrame) -> DataFrame:
    """Thread id per topic: a non-zero override, else the stored one; ``missing`` topics have neither."""
    o = overrides.select("topic", truthy_number(F.col("thread_id")).alias("_override"))
    s = stored.select("topic", truthy_number(F.col("thread_id")).alias("_stored"))
    both = o.join(s, "topic", "full_outer")
    thread = F.coalesce("_override", "_stored")
    return both.select("topic", thread.alias("thread_id"), thread.isNull().alias("missing"))


# ------------------------------------------------------------------ snapshot export
EXPORT_ORDER = ("services", "offers", "signals", "sources", "lead_metrics")


def _sql_row(df: DataFrame, table: str) -> Column:
    values = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        nested = kind.startswith(("array", "struct", "map"))
        column = F.to_json(F.col(f.name)) if nested else F.col(f.name)
        values.append(sql_literal(column, "string" if nested else kind))
    names = ",".join(df.columns)
    return F.concat(F.lit(f"INSERT INTO {table} ({names}) VALUES ("), F.concat_ws(",", *values), F.lit(");"))


def sql_dump(spark, tables: dict[str, DataFrame]) -> DataFrame:
    """Lines of a full reseed: deletes in reverse key order, then one insert per row (columns block, line)."""
    names = [t for t in EXPORT_ORDER if t in tables]
    deletes = [(0, f"DELETE FROM {t};") for t in reversed(names)]
    out = spark.createDataFrame(deletes, "block int, line string")
    for block, table in enumerate(names, start=1):
        out = out.unionByName(tables[table].select(F.lit(block).alias("block"), _sql_row(tables[table], table).alias("line")))
    return out


def write_sql_dump(dump: DataFrame, path: str) -> None:
    """Text files, one folder per block, so the blocks can be replayed in order."""
    dump.write.mode("overwrite").partitionBy("block").text(path)


def append_signals(signals: DataFrame, path: str) -> None:
    """Append to the signals table, partitioned by observation day.

    The rebalance hint gathers a day into few files and splits a day that holds much more than the others.
    """
    out = with_schema(signals, "signals").withColumn("dt", F.to_date("observed_at"))
    out.hint("rebalance", F.col("dt")).write.mode("append").partitionBy("dt").parquet(path)


def read_signals(spark, path: str) -> DataFrame:
    return with_schema(spark.read.schema(schema("signals").add("dt", "date")).parquet(path), "signals")
