"""From landed payloads to ingest: every enabled source's parser over its own payloads, and the union of their signals.

A landed payload has ``collector`` (a name of the registry), ``payload_id``, ``body`` and, as far as its parser reads
them, the columns of ``ATTRIBUTES``; absent ones are NULL.  Kept in folders ``collector=<name>``, each parser's branch
reads its own folder only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.operators.admin import enabled_sources
from leadlens.plans.batch import IngestJob
from leadlens.sources.registry import registry, registry_frame, union_signals

ATTRIBUTES = {
    "source": "string", "page_url": "string", "aggregator": "string", "repo": "string", "feed": "string",
    "instance": "string", "path": "string", "pattern_no": "int", "landed_at": "timestamp",
}


def enabled_names(payloads: DataFrame, sources: DataFrame | None) -> list[str]:
    """Registered names that the ``sources`` table does not switch off.  The registry is a fixed short list."""
    if sources is None:
        return sorted(registry())
    return sorted(r["name"] for r in enabled_sources(registry_frame(payloads.sparkSession), sources).select("name").collect())


def landed_signals(payloads: DataFrame, sources: DataFrame | None = None, names: Iterable[str] | None = None) -> DataFrame:
    """Signals of all payloads whose collector is registered and enabled (or among ``names``)."""
    known, parsers = {c.lower() for c in payloads.columns}, registry()
    missing = {c: F.lit(None).cast(kind) for c, kind in ATTRIBUTES.items() if c not in known}
    whole = payloads.withColumns(missing) if missing else payloads
    names = enabled_names(payloads, sources) if names is None else list(names)
    frames = []
    for name in names:
        own = whole.where(F.col("collector") == name).withColumn("source", F.coalesce("source", F.lit(name)))
        frames.append(parsers[name].parse(own.drop("collector")))
    return union_signals(*frames)


def ingest_landed(
    payloads: DataFrame,
    previous: str | None,
    target: str,
    as_of: Column,
    sources: DataFrame | None = None,
    stored_signals: DataFrame | None = None,
    job: IngestJob = IngestJob(),
    names: Iterable[str] | None = None,
) -> None:
    """One ingest run over landed payloads; see :class:`leadlens.plans.batch.IngestJob`."""
    job.run(landed_signals(payloads, sources, names), previous, target, as_of, stored_signals)
