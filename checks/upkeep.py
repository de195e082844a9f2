"""Stored tables, exports, listings, link expansion, pluggable labels and whole jobs."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from checks import kit as K
from checks import sources as SC
from checks import streams as SS
from checks import views as V
from checks.admin import _BASE as _ADMIN_BASE
from checks.admin import _stored
from checks.candidates import _PURGE
from checks.posts import _KEPT
from leadlens import lexicon as lx
from leadlens import schemas
from leadlens.functions import score as S
from leadlens.functions import text as X
from leadlens.operators import admin as A
from leadlens.operators import candidates as C
from leadlens.operators import ingest as I
from leadlens.plans import batch as B
from leadlens.session import checkpointed, shared_dir
from leadlens.sources import channel as CH
from leadlens.sources import registry as R
from leadlens.streaming import streams as ST


def _folder(spark, name):
    return f"{shared_dir(spark)}/upkeep/{name}-{uuid.uuid4().hex}"


def stored_services(spark, sf):
    """A services table written before most of its columns were declared."""
    path = _folder(spark, "services")
    old = V.services(spark, sf).select(F.col("id").cast("int").alias("id"), "canonical_domain", "name", F.lit("x").alias("dropped"))
    old.write.parquet(path)
    return R.read_table(spark, path, "services").select("id", "canonical_domain", "name", "type", "status", "reliability", "models", "last_checked")


def exported_messages(spark, sf):
    """Documents as a JSON-lines export with their links."""
    path = _folder(spark, "export")
    link = lambda n: F.concat(F.lit(f"https://l{n}.example/"), F.col("doc_id").cast("string"))
    links = F.when(F.col("doc_id") % 3 == 0, F.array(link(1), link(2))).when(F.col("doc_id") % 3 == 1, F.array().cast("array<string>"))
    V.table(spark, sf, "documents").select("text", links.alias("links")).write.json(path)
    return R.read_export(spark, path).select(F.md5("text").alias("digest"), "url")


def sources_listed(spark, sf):
    """The first of all sources, and of one type."""
    rows = _stored(spark, sf)
    one = rows.select("type").agg(F.min("type")).first()[0]
    return A.list_sources(rows).limit(70).select("id", "type").union(A.list_sources(rows, one).limit(9).select("id", "type"))


def link_seeds(spark, sf):
    promoted = V.services(spark, sf).where("status = 'active'").withColumn("first_seen", F.to_timestamp(F.lit(V.ORDERS_AS_OF)))
    few = C.link_seeds(promoted.withColumn("first_seen", F.timestamp_seconds(F.col("id") * 7919 % 101)), 10)
    return few.select("id", "canonical_domain")


def freshness_values(spark, sf):
    age = F.col("o_orderkey") % 700 - 50 + F.col("o_custkey") % 10 / 10
    return V.table(spark, sf, "orders").select("o_orderkey", S.round_steady(S.freshness(age), 9).alias("freshness"))


def channel_stream(spark, sf):
    """Channel messages as a stream, joined to the configured topics."""
    stream = SS._stream(spark, sf, "conversations")
    rows = ST.channel_signals(SC.as_messages(stream), SC._topic_config(spark, sf))
    path = _folder(spark, "channel")
    query = rows.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/_checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/table").select(
        "source", F.md5("raw_text").alias("digest"), "source_url", F.col("meta.forward_from").alias("forward_from"), "ingest_seq"
    )


def _outside(batches):
    """A model of another kind: knows one word, gives its own type and confidence."""
    for batch in batches:
        text = batch["raw_text"].fillna("")
        offer = text.str.contains("free", regex=False)
        yield pd.DataFrame({
            "ingest_seq": batch["ingest_seq"], "offer": offer, "kind": offer.map({True: "grant", False: "other"}),
            "sure": offer.map({True: 0.9, False: 0.1}),
        })


def outside_labels(spark, sf):
    """Posts through the whole pipeline with labels of another classifier, which sees the texts in Arrow batches."""
    def classifier(frame):
        found = frame.select("ingest_seq", "raw_text").mapInPandas(_outside, "ingest_seq bigint, offer boolean, kind string, sure double")
        label = X.not_offer().withField("is_offer", F.col("offer")).withField("offer_type", F.col("kind")).withField("confidence", F.col("sure"))
        return frame.join(found, "ingest_seq").withColumn("label", label.cast(X.LABEL_TYPE)).drop("offer", "kind", "sure")

    routed = checkpointed(I.label_signals(V.posts(spark, sf), classifier=classifier))
    rows = I.storable(routed)
    return rows.select("ingest_seq", "route", "offer_type", "service_key", F.col("label.confidence").alias("confidence"))


def _edges(spark, sf):
    """pages as sites that link to each other, to hubs, and to sites of which no page is known."""
    n = F.col("page_id")
    body = F.concat(
        F.col("html"), F.lit(" https://www.site"), ((n * 13 + 7) % 260).cast("string"), F.lit(".ai/x and https://hub"),
        (n % 17).cast("string"), F.lit(".dev http://x.com/y https://site"), ((n * n) % 31).cast("string"), F.lit(".ai"),
    )
    pages = V.text_table(spark, sf, "pages")
    return C.outbound_domains(pages.select(F.concat(F.lit("site"), (n % 200).cast("string"), F.lit(".ai")).alias("domain"), body.alias("body")))


def link_expansion(spark, sf):
    """All domains that three sites reach, over as many hops as there are."""
    seeds = spark.createDataFrame([("site0.ai",), ("site3.ai",), ("site7.ai",)], "domain string")
    return C.expand_links(checkpointed(_edges(spark, sf)), seeds)


def _snapshot(spark, sf, path):
    tables = {name: schemas.empty(spark, name) for name in B.STATE_TABLES}
    offers = V.offers(spark, sf).join(V.services(spark, sf).select(F.col("id").alias("service_id"), "canonical_domain"), "service_id", "left")
    metrics = V.order_signals(spark, sf).select("offer_id").distinct().withColumn("lead_hours", F.lit(1.0))
    B.write_snapshot({
        **tables, "services": V.services(spark, sf), "offers": schemas.with_schema(offers, "offers"),
        "lead_metrics": schemas.with_schema(metrics, "lead_metrics"),
    }, path)


def purge_job(spark, sf):
    """The purge from one snapshot to the next: what is left of each table, and the counters it wrote."""
    path = _folder(spark, "purge")
    _snapshot(spark, sf, f"{path}/0")
    signals = V.order_signals(spark, sf).withColumn("id", F.col("signal_id"))
    B.purge(spark, f"{path}/0", f"{path}/1", schemas.with_schema(signals, "signals"))
    left = [
        spark.read.parquet(f"{path}/1/{name}").agg(F.count(F.lit(1)).alias("left")).select(F.lit(name).alias("table"), "left")
        for name in ("services", "offers", "signals", "lead_metrics")
    ]
    counted = spark.read.parquet(f"{path}/1/counters").select(F.expr("stack(3, 'services', services, 'offers', offers, 'signals', signals) AS (table, removed)"))
    out = left[0].union(left[1]).union(left[2]).union(left[3])
    return out.join(counted, "table", "left")


QUERIES = {
    f.__name__: f
    for f in (
        stored_services, exported_messages, sources_listed, link_seeds, freshness_values, channel_stream, outside_labels,
        link_expansion, purge_job,
    )
}

# ------------------------------------------------------------------ SQL
ORACLE = {
    "stored_services": f"""WITH {V.SERVICES_SQL}
SELECT id, canonical_domain, name, 'other' AS type, 'new' AS status, CAST(0 AS DOUBLE) AS reliability, CAST(NULL AS VARCHAR[]) AS models,
  CAST(NULL AS TIMESTAMP) AS last_checked FROM services""",
    "exported_messages": """SELECT md5(text) AS digest, CASE WHEN doc_id % 3 = 0 THEN 'https://l1.example/' || CAST(doc_id AS VARCHAR) END AS url
FROM documents""",
    "link_seeds": f"""WITH {V.SERVICES_SQL} SELECT id, canonical_domain FROM services WHERE status = 'active' ORDER BY id * 7919 % 101, id LIMIT 10""",
    "freshness_values": f"""WITH a AS (SELECT o_orderkey, o_orderkey % 700 - 50 + (o_custkey % 10) / 10.0::DOUBLE AS age FROM orders)
SELECT o_orderkey, {K.steady('CASE WHEN age <= 0 THEN 1.0 ELSE 1.0 / (1.0 + age / 24.0) END', 9)} AS freshness FROM a""",
    "channel_stream": SC.ORACLE["channel_messages"],
    "link_expansion": """WITH RECURSIVE edges AS (
  SELECT DISTINCT * FROM (
    SELECT 'site' || CAST(page_id % 200 AS VARCHAR) || '.ai' AS domain,
      unnest(['site' || CAST((page_id * 13 + 7) % 260 AS VARCHAR) || '.ai', 'hub' || CAST(page_id % 17 AS VARCHAR) || '.dev',
              'site' || CAST((page_id * page_id) % 31 AS VARCHAR) || '.ai']) AS target FROM pages) WHERE domain <> target
),
walk AS (
  SELECT unnest(['site0.ai', 'site3.ai', 'site7.ai']) AS domain, 0 AS hop
  UNION SELECT e.target, w.hop + 1 FROM walk w JOIN edges e USING (domain) WHERE w.hop < 60
)
SELECT domain, min(hop) AS hop FROM walk GROUP BY domain""",
    "purge_job": f"""{_PURGE},
bad_offers AS (SELECT id FROM offers WHERE service_id IN (SELECT id FROM bad))
SELECT 'services' AS "table", (SELECT count(*) FROM services WHERE id NOT IN (SELECT id FROM bad)) AS "left", (SELECT count(*) FROM bad) AS removed
UNION ALL SELECT 'offers', (SELECT count(*) FROM offers WHERE id NOT IN (SELECT id FROM bad_offers)), (SELECT count(*) FROM bad_offers)
UNION ALL SELECT 'signals', count(*) FILTER (WHERE service_id NOT IN (SELECT id FROM bad)), count(*) FILTER (WHERE service_id IN (SELECT id FROM bad)) FROM order_signals
UNION ALL SELECT 'lead_metrics', (SELECT count(DISTINCT offer_id) FROM order_signals WHERE offer_id NOT IN (SELECT id FROM bad_offers)), NULL""",
    "sources_listed": f"""{_ADMIN_BASE}
(SELECT id, type FROM stored ORDER BY type, id LIMIT 70)
UNION ALL (SELECT id, type FROM stored WHERE type = (SELECT min(type) FROM stored) ORDER BY id LIMIT 9)""",
    "outside_labels": f"""{_KEPT},
r AS (
  SELECT *, {K.registrable('host')} AS reg, contains(raw_text, 'free') AS free FROM kept
),
routed AS (
  SELECT *, coalesce({K.in_list('reg', lx.BLOCKED_DOMAINS)}, false) AND NOT model_release AS blocked,
    CASE WHEN free AND host IS NOT NULL THEN 'offer' WHEN model_release AND url IS NOT NULL THEN 'model_release'
         WHEN service_candidate AND host IS NOT NULL THEN 'candidate' ELSE 'signal' END AS route FROM r
),
stored AS (
  SELECT *, row_number() OVER (PARTITION BY source, coalesce(nullif(source_url, ''), '#' || CAST(ingest_seq AS VARCHAR)) ORDER BY ingest_seq) AS k
  FROM routed WHERE NOT blocked
)
SELECT ingest_seq, route, CASE route WHEN 'offer' THEN 'grant' WHEN 'model_release' THEN 'model_release' END AS offer_type,
  CASE WHEN route IN ('offer', 'candidate') THEN coalesce(reg, host) WHEN route = 'model_release' THEN 'hf/' || lower(coalesce(org, 'hf')) END AS service_key,
  CAST(CASE WHEN free THEN 0.9 ELSE 0.1 END AS DOUBLE) AS confidence
FROM stored WHERE k = 1""",
}
