"""The test tables as this library's tables.

Every view reads a whole table.  Where the tables have no counterpart (offer posts, payload documents) the view
derives one row per order or customer, so the work grows with the data.  Derived texts are written once as
portable SQL expressions that Spark and the checking engine both run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.schemas import with_schema
from leadlens.sources.common import meta

EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-02 00:00:00"
AGGREGATORS = ("purchase",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for text work, read as any other."""
    return table(spark, sf_dir, name)


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp")


# ------------------------------------------------------------------ events
def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as stored signals; ``purchase`` is the aggregator source."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("signal_id"),
        F.col("user_id").alias("offer_id"),
        F.col("user_id").alias("service_id"),
        F.col("event_type").alias("source"),
        F.concat(F.lit("ev://"), F.col("event_id").cast("string")).alias("source_url"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.col("value").alias("confidence"),
        F.col("props").alias("raw_text"),
        F.lit(None).cast("string").alias("lang"),
    )


EVENT_SIGNALS_SQL = """
event_signals AS (
  SELECT event_id AS signal_id, user_id AS offer_id, user_id AS service_id, event_type AS source,
         'ev://' || CAST(event_id AS VARCHAR) AS source_url, ts AS observed_at, value AS confidence, props AS raw_text
  FROM events
)"""


def vote_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as votes: click +1, error -1, view takes the vote back; the visitor is ``props.k``."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "error", "view"))
    return e.select(
        F.col("user_id").alias("offer_id"),
        F.get_json_object("props", "$.k").alias("fingerprint"),
        F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", -1).otherwise(0).alias("vote"),
        F.col("ts").cast("timestamp").alias("created_at"),
        "event_id",
    )


VOTES_SQL = """
vote_events AS (
  SELECT user_id AS offer_id, json_extract_string(props, '$.k') AS fingerprint, event_id, ts,
         CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS vote
  FROM events WHERE event_type IN ('click', 'error', 'view')
),
votes AS (
  SELECT offer_id, fingerprint, vote FROM (
    SELECT *, row_number() OVER (PARTITION BY offer_id, fingerprint ORDER BY ts DESC, event_id DESC) AS n
    FROM vote_events) WHERE n = 1 AND vote <> 0
)"""

# ------------------------------------------------------------------ customers as services, orders as offers
# One portable expression each; used by both engines.
DOMAIN_EXPR = """CASE c_custkey % 7
  WHEN 0 THEN 'svc' || CAST(c_custkey AS STRING) || '.ai'
  WHEN 1 THEN 'app.svc' || CAST(c_custkey AS STRING) || '.dev'
  WHEN 2 THEN 'www.svc' || CAST(c_custkey AS STRING) || '.io'
  WHEN 3 THEN 'api.svc' || CAST(c_custkey AS STRING) || '.co.uk'
  WHEN 4 THEN 'u' || CAST(c_custkey AS STRING) || '.reddit.com'
  WHEN 5 THEN 'svc' || CAST(c_custkey AS STRING) || '.com.cn'
  ELSE 'svc' || CAST(c_custkey AS STRING) || '.github.io' END"""
SERVICE_COLUMNS = {
    "id": "c_custkey",
    "canonical_domain": DOMAIN_EXPR,
    "name": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END",
    "type": "c_mktsegment",
    "engine": "CASE c_custkey % 3 WHEN 0 THEN 'new-api' WHEN 1 THEN 'one-api' ELSE NULL END",
    "status": "CASE WHEN c_acctbal < 0 THEN 'dead' WHEN c_custkey % 4 = 0 THEN 'new' ELSE 'active' END",
    "reliability": "CASE WHEN c_acctbal < 0 THEN 0.0 WHEN c_acctbal > 10000 THEN 1.0 ELSE c_acctbal / 10000 END",
}
OFFER_COLUMNS = {
    "id": "o_orderkey",
    "service_id": "o_custkey",
    "type": """CASE o_orderpriority WHEN '1-URGENT' THEN 'relay' WHEN '2-HIGH' THEN 'saas_trial'
        WHEN '3-MEDIUM' THEN 'saas_promo' WHEN '4-NOT SPECIFIED' THEN 'model_release' ELSE 'grant' END""",
    "amount": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END",
    "currency": "CASE WHEN o_orderkey % 3 = 0 THEN 'USD' ELSE NULL END",
    "effort": "CASE o_orderstatus WHEN 'F' THEN 'hard' WHEN 'O' THEN 'easy' ELSE 'medium' END",
    "unit": "CASE o_orderkey % 4 WHEN 0 THEN 'usd' WHEN 1 THEN 'credits' WHEN 2 THEN 'days' ELSE 'months' END",
    "url": "'https://offers.example/' || CAST(o_orderkey AS STRING)",
    "claim_steps": """CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE '1. sign up at shop ' || CAST(o_custkey AS STRING)
        || ' 2) enter code ' || CAST(o_orderkey AS STRING) || ' ● ok ● wait for mail' END""",
    "description": "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'offer of ' || o_orderpriority END",
    "referral_required": "o_orderkey % 8 = 0",
    "status": "'new'",
    "score": "CAST((o_orderkey * 7919) % 10000 AS DOUBLE) / 10000",
    "topic": "CASE o_orderkey % 3 WHEN 0 THEN 'ai_service' WHEN 1 THEN 'freebie' ELSE NULL END",
}
_MODEL_WORDS = ("Claude", "GPT", "gemini", "Qwen", "llama")


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return with_schema(c.select(*[F.expr(e).alias(n) for n, e in SERVICE_COLUMNS.items()]), "services")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    models = F.array_compact(
        F.array(*[F.when(F.col("o_orderkey") % (i + 2) == 0, F.lit(w)) for i, w in enumerate(_MODEL_WORDS)])
    )
    rows = o.select(
        *[F.expr(e).alias(n) for n, e in OFFER_COLUMNS.items()],
        models.alias("models"),
        F.col("o_orderdate").cast("timestamp").alias("first_seen_at"),
    )
    return with_schema(rows, "offers").drop("canonical_domain")


def _select_sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


SERVICES_SQL = f"services AS (SELECT {_select_sql(SERVICE_COLUMNS)} FROM customer)"
_MODELS_SQL = ", ".join(f"CASE WHEN o_orderkey % {i + 2} = 0 THEN '{w}' END" for i, w in enumerate(_MODEL_WORDS))
OFFERS_SQL = (
    f"offers AS (SELECT {_select_sql(OFFER_COLUMNS)}, o_orderdate AS first_seen_at, "
    f"list_filter([{_MODELS_SQL}], lambda m: m IS NOT NULL) AS models FROM orders)"
)


def order_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as signals of their customer's service and of their own offer."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(*[F.expr(e).alias(n) for n, e in ORDER_SIGNAL_COLUMNS.items()], F.col("o_orderdate").cast("timestamp").alias("observed_at"))
    return rows


ORDER_SIGNAL_COLUMNS = {
    "signal_id": "o_orderkey",
    "offer_id": "o_orderkey - o_orderkey % 3",
    "service_id": "o_custkey",
    "source": """CASE o_orderkey % 6 WHEN 0 THEN 'nodeseek' WHEN 1 THEN 'telegram' WHEN 2 THEN 'reddit'
        WHEN 3 THEN 'certstream' WHEN 4 THEN 'hackernews' ELSE 'csdn' END""",
    "source_url": """CASE WHEN o_orderkey % 6 = 1 THEN 'https://t.me/chan' || CAST(o_custkey % 50 AS STRING) || '/' || CAST(o_orderkey AS STRING)
        WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'cert://' || CAST(o_custkey AS STRING)
        ELSE 'https://src.example/' || CAST(o_orderkey % 40 AS STRING) END""",
    "raw_text": "'signal of ' || o_orderpriority || repeat(' x', CAST(o_orderkey % 17 AS INT)) || ' ' || o_orderstatus",
    "lang": "CASE o_orderkey % 10 WHEN 0 THEN 'zh-CN' WHEN 1 THEN 'de' WHEN 2 THEN ' RU ' ELSE NULL END",
    "confidence": "CAST(o_orderkey % 100 AS DOUBLE) / 100",
}
ORDER_SIGNALS_SQL = (
    f"order_signals AS (SELECT {_select_sql(ORDER_SIGNAL_COLUMNS)}, o_orderdate AS observed_at FROM orders)"
)

# ------------------------------------------------------------------ orders as offer posts
_HOST = """CASE o_custkey % 7
  WHEN 0 THEN 'svc' || CAST(o_custkey AS STRING) || '.ai'
  WHEN 1 THEN 'app.svc' || CAST(o_custkey AS STRING) || '.dev'
  WHEN 2 THEN 'www.svc' || CAST(o_custkey AS STRING) || '.io'
  WHEN 3 THEN 'api.svc' || CAST(o_custkey AS STRING) || '.co.uk'
  WHEN 4 THEN 'old.reddit.com'
  WHEN 5 THEN 'svc' || CAST(o_custkey AS STRING) || '.com.cn'
  ELSE 'gist.github.com' END"""
_N = "CAST(o_orderkey % 3000 AS STRING)"
POST_COLUMNS = {
    "ingest_seq": "o_orderkey",
    "source": """CASE ((o_orderkey - o_orderkey % 2) % 12) WHEN 0 THEN 'nodeseek' WHEN 2 THEN 'telegram'
        WHEN 4 THEN 'reddit' WHEN 6 THEN 'certstream' WHEN 8 THEN 'hackernews' ELSE 'forum_rss' END""",
    "source_url": """CASE WHEN o_orderkey % 11 = 0 THEN NULL
        ELSE 'post://' || CAST(o_orderkey - o_orderkey % 2 AS STRING) END""",
    "url": f"""CASE o_orderkey % 13 WHEN 8 THEN 'https://huggingface.co/Org' || CAST(o_custkey % 20 AS STRING) || '/m-' || {_N}
        WHEN 9 THEN 'https://' || {_HOST} ELSE NULL END""",
    "raw_text": f"""CASE o_orderkey % 13
        WHEN 0 THEN 'Get $' || {_N} || ' free credits, sign up at https://' || {_HOST} || '/pricing. Models: Opus, GPT and Gemini.'
        WHEN 1 THEN '注册送 ' || {_N} || ' 额度 公益站 https://' || {_HOST} || ' 支持 claude 新用户'
        WHEN 2 THEN 'дают бесплатные кредиты: ' || {_N} || ' кредитов при регистрации https://' || {_HOST} || ' нужна карта и телефон'
        WHEN 3 THEN 'just a normal sentence about cats and a dog number ' || {_N}
        WHEN 4 THEN 'now $' || {_N} || '/mo for new users at ' || {_HOST} || ' with a free tier'
        WHEN 5 THEN 'free trial ' || {_N} || ' days, no credit card required https://' || {_HOST} || '/?ref=abc US only'
        WHEN 6 THEN 'star our github page, claim free ' || {_N} || ' credits https://' || {_HOST}
        WHEN 7 THEN 'btw ' || {_HOST} || ' has a free trial, invite your friends for ' || {_N} || ' points'
        WHEN 8 THEN 'New model release: Org' || CAST(o_custkey % 20 AS STRING) || '/m-' || {_N}
        WHEN 9 THEN {_HOST}
        WHEN 10 THEN 'use code SAVE for ' || {_N} || ' months, vpn needed, cancel subscription or chargeback https://' || {_HOST}
        WHEN 11 THEN 'register and redeem ' || {_N} || ' tokens https://' || {_HOST} || ' sms phone number EU only'
        ELSE '送刀 ' || {_N} || '刀 中转站 https://' || {_HOST} || ' region locked (' || o_orderstatus || ')' END""",
    "force_classify": "o_orderkey % 13 IN (8, 9) AND o_orderkey % 2 = 0",
    "service_candidate": "o_orderkey % 13 = 9",
    "model_release": "o_orderkey % 13 = 8",
    "org": "CASE WHEN o_orderkey % 13 = 8 THEN 'Org' || CAST(o_custkey % 20 AS STRING) END",
    "model_id": f"CASE WHEN o_orderkey % 13 = 8 THEN 'Org' || CAST(o_custkey % 20 AS STRING) || '/m-' || {_N} END",
}
POSTS_SQL = f"posts AS (SELECT {_select_sql(POST_COLUMNS)}, o_orderdate AS observed_at FROM orders)"
_META_FIELDS = ("force_classify", "service_candidate", "model_release", "org", "model_id")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as raw signals: offers in three languages, bare mentions, model releases and certificate hosts."""
    o = text_table(spark, sf_dir, "orders")
    rows = o.select(
        *[F.expr(e).alias(n) for n, e in POST_COLUMNS.items()], F.col("o_orderdate").cast("timestamp").alias("observed_at")
    )
    flags = meta(**{name: F.col(name) for name in _META_FIELDS})
    return with_schema(rows.withColumn("meta", flags).drop(*_META_FIELDS), "signals_in")


# ------------------------------------------------------------------ documents and pages
def document_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = text_table(spark, sf_dir, "documents")
    rows = d.select(
        "source",
        F.col("text").alias("raw_text"),
        F.concat(F.lit("doc://"), F.md5("text")).alias("source_url"),
        F.col("doc_id").alias("ingest_seq"),
    )
    return with_schema(rows, "signals_in")


# What a document says about services, behind its own text; portable.
MENTIONED_EXPR = """text || CASE doc_id % 7
  WHEN 0 THEN ' see https://docs.svc' || CAST(doc_id % 400 AS STRING) || '.co.uk/x?y=1, for a free trial.'
  WHEN 1 THEN ' (try app.lab' || CAST(doc_id % 300 AS STRING) || '.ai today)'
  WHEN 2 THEN ' https://www.GitHub.com/a/b and https://Api.Node' || CAST(doc_id % 250 AS STRING) || '.dev:8080/v1, '
  WHEN 3 THEN ' bonus ' || repeat('x ', 60) || 'getx' || CAST(doc_id % 90 AS STRING) || '.io' || repeat(' y', 60) || ' gift'
  WHEN 4 THEN ''
  WHEN 5 THEN ' voucher of old.reddit.com, from me@mail' || CAST(doc_id % 50 AS STRING) || '.com'
  ELSE ' at https://hub' || CAST(doc_id % 150 AS STRING) || '.xyz) or hub' || CAST(doc_id % 150 AS STRING) || '.xyz without' END"""
MENTIONS_SQL = f"""posts AS (
  SELECT source, CAST(NULL AS VARCHAR) AS url, doc_id AS ingest_seq, {MENTIONED_EXPR} AS raw_text FROM documents
)"""


def document_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as signals, most of them with a service behind the text."""
    d = text_table(spark, sf_dir, "documents")
    return with_schema(d.select("source", F.expr(MENTIONED_EXPR).alias("raw_text"), F.col("doc_id").alias("ingest_seq")), "signals_in")


def page_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = text_table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("payload_id"), F.col("html").alias("body"), F.col("url").alias("page_url"))
