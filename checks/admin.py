"""Source configuration, settings, topic map and snapshot export."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import kit as K
from checks import views as V
from leadlens import schemas
from leadlens.operators import admin as A

_AS_OF = "2001-08-02 00:00:00"
# parts as a registry of sources, suppliers and customers as stored rows; portable expressions
_REGISTRY = {
    "name": "'src' || CAST(p_partkey AS STRING)",
    "label": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END",
    "kind": "p_type",
    "mode": "CASE WHEN p_size % 10 = 0 THEN 'stream' WHEN p_size % 10 = 1 THEN NULL ELSE 'poll' END",
    "interval": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size * 60 AS INT) END",
    "requires": "CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE NULL END",
}
_STORED = {
    "id": "c_custkey",
    "name": "'src' || CAST(c_custkey * 2 AS STRING)",
    "type": "CASE WHEN c_nationkey % 2 = 0 THEN 'telegram' ELSE c_mktsegment END",
    "enabled": "c_acctbal > 2000",
    "config": """CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '{"interval": 120}' WHEN 2 THEN '{"interval": "abc"}'
        WHEN 3 THEN 'broken' WHEN 4 THEN '{"channel": "chan' || CAST(c_custkey AS STRING) || '", "topic_id": ' || CAST(c_nationkey AS STRING) || '}'
        ELSE '{"channel": ""}' END""",
}


def _registry(spark, sf):
    return V.table(spark, sf, "part").select(*[F.expr(e).alias(n) for n, e in _REGISTRY.items()])


def _stored(spark, sf):
    c = V.table(spark, sf, "customer")
    return schemas.with_schema(c.select(*[F.expr(e).alias(n) for n, e in _STORED.items()]), "sources")


def source_registry(spark, sf):
    return A.registry_view(_registry(spark, sf), _stored(spark, sf))


def sources_enabled(spark, sf):
    return A.pollable(A.enabled_sources(_registry(spark, sf), _stored(spark, sf))).select("name", "kind")


def sources_synced(spark, sf):
    return A.sync_sources(_stored(spark, sf), _registry(spark, sf)).select("name", "type", "enabled", "config")


def sources_upserted(spark, sf):
    changes = _registry(spark, sf).select(
        "name", F.col("kind").alias("type"), F.lit("{}").alias("config"), (F.col("mode") == "poll").alias("enabled")
    )
    return A.upsert_sources(_stored(spark, sf), changes).select("name", "type", "enabled", "config")


def sources_updated(spark, sf):
    """Partial updates by id (from suppliers), then deletion of the ids of one nation."""
    s = V.table(spark, sf, "supplier")
    changes = s.select(
        F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 5000, F.lit(False)).alias("enabled"),
        F.when(F.col("s_nationkey") > 10, F.col("s_name")).alias("name"), F.lit(None).cast("string").alias("config"),
    )
    gone = s.where("s_nationkey = 3").select(F.col("s_suppkey").alias("id"))
    return A.delete_sources(A.update_sources(_stored(spark, sf), changes), gone).select("id", "name", "enabled")


def sources_run(spark, sf):
    runs = V.table(spark, sf, "orders").select(
        F.concat(F.lit("src"), (F.col("o_custkey") * 2).cast("string")).alias("name"), F.col("o_orderdate").cast("timestamp").alias("ran_at")
    )
    return A.mark_run(_stored(spark, sf), runs).select("id", F.date_format("last_run", "yyyy-MM-dd").alias("last_run"))


def source_config_edited(spark, sf):
    interval = F.when(F.col("id") % 2 == 0, F.col("id"))
    edited = A.with_interval(F.col("config"), interval)
    return _stored(spark, sf).select(
        "id", A.config_interval(edited).alias("interval"), F.get_json_object(edited, "$.channel").alias("channel")
    )


def keys_needed(spark, sf):
    return A.keys_needed(_registry(spark, sf))


def channels_enabled(spark, sf):
    rows = A.enabled_channels(_stored(spark, sf))
    return rows.withColumn("source_name", A.channel_source_name(F.concat(F.lit("@"), "channel"), F.col("topic_id")))


def settings_overlaid(spark, sf):
    """Stored values (customers of each segment) over default values (nations' customers), then an upsert."""
    c = V.table(spark, sf, "customer")
    defaults = c.select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("value"))
    stored = V.table(spark, sf, "supplier").select(
        F.concat(F.lit("k"), (F.col("s_suppkey") * 20).cast("string")).alias("key"), F.col("s_name").alias("value")
    )
    changes = V.table(spark, sf, "part").select(
        F.concat(F.lit("k"), (F.col("p_partkey") * 3).cast("string")).alias("key"), F.col("p_brand").alias("value")
    )
    after = A.upsert_settings(stored, changes, defaults, V.instant(_AS_OF))
    return A.overlay_settings(defaults, after)


def topic_threads(spark, sf):
    s = V.table(spark, sf, "supplier")
    overrides = s.select(F.col("s_name").alias("topic"), (F.col("s_suppkey") % 3).alias("thread_id"))
    stored = s.where("s_acctbal > 1000").select(F.col("s_name").alias("topic"), (F.col("s_suppkey") % 2 * 100).alias("thread_id"))
    return A.topic_map(overrides, stored)


def sql_dump(spark, sf):
    """Reseed script of suppliers as services and customers as sources (names with quotes)."""
    services = V.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("o'"), F.col("s_name")).alias("name"),
        F.when(F.col("s_nationkey") > 12, F.col("s_nationkey")).alias("nation"), (F.col("s_acctbal") > 0).alias("ok"),
    )
    sources = _stored(spark, sf).select("id", "name", "enabled", "config")
    return A.sql_dump(spark, {"sources": sources, "services": services})


QUERIES = {
    f.__name__: f
    for f in (
        source_registry, sources_enabled, sources_synced, sources_upserted, sources_updated, sources_run,
        source_config_edited, keys_needed, channels_enabled, settings_overlaid, topic_threads, sql_dump,
    )
}

# ------------------------------------------------------------------ SQL
_BASE = f"""WITH registry AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _REGISTRY.items())} FROM part),
stored AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _STORED.items())} FROM customer)"""
_BOOL = "CASE WHEN {c} THEN '1' ELSE '0' END"

ORACLE = {
    "source_registry": f"""{_BASE}
SELECT r.name, coalesce(r.label, r.name) AS label, r.kind, coalesce(r.mode, 'poll') AS mode,
  coalesce(CASE WHEN s.id % 6 = 1 THEN 120 END, r.interval, 900) AS interval, coalesce(s.enabled, true) AS enabled, r.requires
FROM registry r LEFT JOIN stored s USING (name)""",
    "sources_enabled": f"""{_BASE}
SELECT name, kind FROM registry WHERE coalesce(mode, 'poll') = 'poll' AND name NOT IN (SELECT name FROM stored WHERE NOT enabled)""",
    "sources_synced": f"""{_BASE}
SELECT name, type, enabled, config FROM stored
UNION ALL SELECT name, kind, true, '{{}}' FROM registry WHERE name NOT IN (SELECT name FROM stored)""",
    "sources_upserted": f"""{_BASE}
SELECT name, kind AS type, coalesce(mode = 'poll', true) AS enabled, '{{}}' AS config FROM registry
UNION ALL SELECT name, type, enabled, config FROM stored WHERE name NOT IN (SELECT name FROM registry)""",
    "sources_updated": f"""{_BASE}
SELECT id, CASE WHEN s_nationkey > 10 THEN s_name ELSE name END AS name, CASE WHEN s_acctbal > 5000 THEN false ELSE enabled END AS enabled
FROM stored LEFT JOIN supplier ON s_suppkey = id WHERE coalesce(s_nationkey, 0) <> 3""",
    "sources_run": """SELECT c_custkey AS id, strftime(max(o_orderdate), '%Y-%m-%d') AS last_run
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "source_config_edited": """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS INTEGER) END AS interval,
  CASE c_custkey % 6 WHEN 4 THEN 'chan' || CAST(c_custkey AS VARCHAR) WHEN 5 THEN '' END AS channel FROM customer""",
    "keys_needed": f"""{_BASE}
SELECT requires AS key, name AS unlocks, count(*) OVER (PARTITION BY requires) AS n_unlocks FROM registry WHERE requires IS NOT NULL""",
    "channels_enabled": f"""{_BASE}
SELECT 'chan' || CAST(c_custkey AS VARCHAR) AS channel, CAST(c_nationkey AS BIGINT) AS topic_id,
  '@chan' || CAST(c_custkey AS VARCHAR) || CASE WHEN c_nationkey <> 0 THEN '#' || CAST(c_nationkey AS VARCHAR) ELSE '' END AS source_name
FROM customer JOIN stored ON id = c_custkey WHERE type = 'telegram' AND enabled AND c_custkey % 6 = 4""",
    "settings_overlaid": """
WITH d AS (SELECT 'k' || CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS value FROM customer),
s AS (SELECT 'k' || CAST(s_suppkey * 20 AS VARCHAR) AS key, s_name AS value FROM supplier),
c AS (SELECT 'k' || CAST(p_partkey * 3 AS VARCHAR) AS key, p_brand AS value FROM part),
a AS (SELECT * FROM c WHERE key IN (SELECT key FROM d) UNION ALL
      SELECT * FROM s WHERE key NOT IN (SELECT key FROM c WHERE key IN (SELECT key FROM d)))
SELECT coalesce(a.key, d.key) AS key, coalesce(a.value, d.value) AS value FROM d FULL JOIN a ON a.key = d.key""",
    "topic_threads": """
WITH t AS (SELECT s_name AS topic, coalesce(nullif(s_suppkey % 3, 0), CASE WHEN s_acctbal > 1000 THEN nullif(s_suppkey % 2 * 100, 0) END) AS thread_id FROM supplier)
SELECT topic, thread_id, thread_id IS NULL AS missing FROM t""",
    "sql_dump": f"""{_BASE}
SELECT 0 AS block, unnest(['DELETE FROM sources;', 'DELETE FROM services;']) AS line
UNION ALL SELECT 1, 'INSERT INTO services (id,name,nation,ok) VALUES (' || CAST(s_suppkey AS VARCHAR) || ',''o''''' || s_name || ''','
  || CASE WHEN s_nationkey > 12 THEN CAST(s_nationkey AS VARCHAR) ELSE 'NULL' END || ',' || {_BOOL.format(c='s_acctbal > 0')} || ');' FROM supplier
UNION ALL SELECT 2, 'INSERT INTO sources (id,name,enabled,config) VALUES (' || CAST(id AS VARCHAR) || ',''' || name || ''','
  || {_BOOL.format(c='enabled')} || ',' || coalesce('''' || config || '''', 'NULL') || ');' FROM stored""",
}
