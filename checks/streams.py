"""Streaming forms run to completion over the tables, compared with the batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import views as V
from checks.leads import _EVENT_LEADS
from leadlens.schemas import with_schema
from leadlens.session import shared_dir
from leadlens.sources.common import meta
from leadlens.streaming import keyed as KY
from leadlens.streaming import newest as NW
from leadlens.streaming import state as KS
from leadlens.streaming import streams as ST

PARTITIONS = 8  # of the states kept here
GROUP_BYTES = 4 << 20  # of a row group of landed files, before compression


def _folder(spark, name):
    return f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf, name):
    """A table, one file or a folder of part files, as a streaming source.  The source takes a single file only by a pattern."""
    return spark.readStream.schema(V.table(spark, sf, name).schema).parquet(f"{sf}/{{{name}}}.parquet")


def running_leads(spark, sf):
    """Lead metrics kept by a streaming aggregation."""
    e = _stream(spark, sf, "events")
    s = e.select(F.col("user_id").alias("offer_id"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("observed_at"))
    path, leads = _folder(spark, "leads"), ST.running_leads(s, V.AGGREGATORS)
    KS.latest_to_table(leads, path, f"{path}/_checkpoint", partitions=PARTITIONS).awaitTermination()
    return KS.read_latest(spark, path, ["offer_id"], leads.schema).select("offer_id", "lead_hours")


def _landed(spark, sf, path, parts=3):
    """orders as a stream in several loads, in arrival order.  Files hold many row groups, so that a micro-batch of few or uneven
    files is read by as many tasks of like size as there are cores."""
    table = V.table(spark, sf, "orders")
    step = table.select(F.max("o_orderkey")).first()[0] // parts + 1
    for part in range(parts):
        load = table.where(F.floor(F.col("o_orderkey") / step) == part).write.mode("append")
        load.option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/landed")
    files = 1 if parts == 1 else table.rdd.getNumPartitions()
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/landed")


def stream_latest_signals(spark, sf):
    """The newest signals per service, kept as state over several micro-batches and compacted."""
    path = _folder(spark, "newest")
    o = _landed(spark, sf, path)
    rows = o.select(*[F.expr(e).alias(n) for n, e in V.ORDER_SIGNAL_COLUMNS.items()], F.col("o_orderdate").cast("timestamp").alias("observed_at"))
    newest = NW.newest_signals(rows)
    KS.latest_to_table(newest, path, f"{path}/_checkpoint", "append", PARTITIONS).awaitTermination()
    KS.compact_latest(spark, path, ["service_id"], newest.schema)
    out = NW.as_rows(KS.read_latest(spark, path, ["service_id"], newest.schema))
    return out.select("service_id", "position", "signal_id", "source", "raw_text")


def _messages(orders, received_at):
    """orders as certificate messages: three names each."""
    u = (F.col("o_custkey") % 4000).cast("string")
    names = F.array(
        F.concat(F.lit("*.llm-"), u, F.lit(".com")), F.concat(F.lit("API.Shop"), u, F.lit(".net")),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("brand"), u, F.lit(".ai"))).otherwise(F.lit("googleapis.llm.org")),
    )
    kind = F.when(F.col("o_orderstatus") == "P", "heartbeat").otherwise("certificate_update")
    body = F.to_json(F.struct(kind.alias("message_type"), F.struct(F.struct(names.alias("all_domains")).alias("leaf_cert")).alias("data")))
    return orders.select(body.alias("body"), received_at.alias("received_at"))


def certificate_stream(spark, sf):
    """Distinct hosts over the whole stream."""
    messages = _messages(_stream(spark, sf, "orders"), F.col("o_orderdate").cast("timestamp"))
    path = _folder(spark, "certs")
    with KS.rocksdb_state(spark, PARTITIONS):
        query = (
            ST.certificate_signals(messages, horizon=None).writeStream.format("parquet").option("path", f"{path}/table")
            .option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()
        )
    query.awaitTermination()
    out = spark.read.parquet(f"{path}/table")
    return out.select("raw_text", "url", "source_url", F.coalesce("meta.force_classify", F.lit(False)).alias("forced"))


def certificate_ingest(spark, sf):
    """The form with a horizon: repeats come again after more than a day, in later micro-batches, and meet the stored keys."""
    path = _folder(spark, "certs")
    messages = _messages(_landed(spark, sf, path, 4), F.timestamp_seconds(F.col("o_orderkey") * 600))
    KY.start_ingest(ST.certificate_signals(messages), path, V.instant(V.ORDERS_AS_OF), partitions=PARTITIONS).awaitTermination()
    return KY.read_state(spark, path, "signals").select("raw_text", "url", "source_url")


def stream_ingest(spark, sf):
    """Ingest by several micro-batches: services and offers after the last, counted per type."""
    path = _folder(spark, "ingest")
    o = _landed(spark, sf, path)
    fields = ("force_classify", "service_candidate", "model_release", "org", "model_id")
    rows = o.select(*[F.expr(e).alias(n) for n, e in V.POST_COLUMNS.items()], F.col("o_orderdate").cast("timestamp").alias("observed_at"))
    signals = with_schema(rows.withColumn("meta", meta(**{n: F.col(n) for n in fields})).drop(*fields), "signals_in")
    KY.start_ingest(signals, path, V.instant(V.ORDERS_AS_OF), partitions=PARTITIONS).awaitTermination()
    offers = KY.read_state(spark, path, "offers")
    return offers.groupBy("type").agg(
        F.count("*").alias("offers"), F.count("amount").alias("with_amount"), F.countDistinct("service_id").alias("services")
    )


QUERIES = {f.__name__: f for f in (running_leads, certificate_stream, certificate_ingest, stream_ingest, stream_latest_signals)}

from checks.posts import _OBS, _ROUTED, _offers_sql  # noqa: E402

_U = "CAST(o_custkey % 4000 AS VARCHAR)"
_CERTIFICATES = f"""WITH m AS (SELECT {_U} AS u, o_orderkey FROM orders WHERE o_orderstatus <> 'P'),
t AS (SELECT 'llm-' || u || '.com' AS h, true AS forced FROM m
  UNION SELECT 'shop' || u || '.net', false FROM m
  UNION SELECT 'brand' || u || '.ai', false FROM m WHERE o_orderkey % 2 = 0)"""
ORACLE = {
    "running_leads": f"{_EVENT_LEADS} SELECT offer_id, lead_hours FROM leads",
    "certificate_ingest": f"""{_CERTIFICATES}
SELECT h AS raw_text, 'https://' || h AS url, 'certstream://' || h AS source_url FROM t WHERE forced""",
    "certificate_stream": f"""{_CERTIFICATES}
SELECT h AS raw_text, 'https://' || h AS url, 'certstream://' || h AS source_url, forced FROM t""",
    "stream_ingest": f"""WITH o AS ({_ROUTED}, {_offers_sql(_OBS)})
SELECT type, count(*) AS offers, count(amount) AS with_amount, count(DISTINCT canonical_domain) AS services FROM o GROUP BY type""",
    "stream_latest_signals": f"""WITH {V.ORDER_SIGNALS_SQL}
SELECT service_id, CAST(n AS INTEGER) AS position, signal_id, source, raw_text[1:1200] AS raw_text
FROM (SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY observed_at DESC, signal_id DESC) AS n FROM order_signals)
WHERE n <= 20""",
}
