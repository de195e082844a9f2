"""Streaming forms of the sources; every step is the batch function on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.operators.leads import lead_metrics
from leadlens.schemas import with_schema
from leadlens.sources import certificates as CT
from leadlens.sources import channel as CH
from leadlens.sources.common import meta


def certificate_hosts(messages: DataFrame, horizon: str | None = "1 day") -> DataFrame:
    """Distinct hosts of a certificate message stream (columns body, received_at).

    With a ``horizon`` a repeat within it is dropped and the state stays bounded; rows that come later than that count as
    late and are dropped, as Spark does.  An older repeat passes here and meets the stored keys of ``keyed.start_ingest``,
    which are exact over all history: they lie in RocksDB, whose own Bloom filters answer for keys that were never stored.
    ``None`` keeps every host for the life of the query; start it inside ``state.rocksdb_state``, so that hosts are not kept
    in memory.
    """
    hosts = CT.message_hosts(messages)
    if horizon is None:
        return hosts.dropDuplicates(["target"])
    return hosts.withWatermark("received_at", horizon).dropDuplicatesWithinWatermark(["target"])


def certificate_signals(messages: DataFrame, horizon: str | None = "1 day") -> DataFrame:
    hosts = certificate_hosts(messages, horizon)
    target = F.col("target")
    rows = hosts.select(
        F.lit("certstream").alias("source"),
        target.alias("raw_text"),
        F.concat(F.lit("https://"), target).alias("url"),
        F.concat(F.lit("certstream://"), target).alias("source_url"),
        F.col("received_at").cast("timestamp").alias("observed_at"),
        F.unix_micros(F.col("received_at").cast("timestamp")).alias("ingest_seq"),
        F.col("pos").alias("place"),
        meta(service_candidate=True, force_classify=F.when(F.col("kind") == "force", True)).alias("meta"),
    )
    return with_schema(rows, "signals_in")


def channel_signals(messages: DataFrame, config: DataFrame) -> DataFrame:
    """Channel message stream joined to the static topic configuration."""
    return CH.message_signals(CH.on_topic(messages, config))


def running_leads(signals: DataFrame, aggregators) -> DataFrame:
    """Lead metrics kept up to date over a signal stream; minima need no watermark for late rows."""
    return lead_metrics(signals, aggregators)
