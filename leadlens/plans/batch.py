"""Batch drivers: read table snapshots, run the operators, write the next snapshot.

A snapshot is a folder with one Parquet table per name.  Steps that several tables hang on are written first
and read back, so a lost executor costs one task and not the whole lineage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leadlens import lexicon as lx
from leadlens import schemas
from leadlens.operators import candidates as C
from leadlens.operators import enrich as E
from leadlens.operators import ingest as I
from leadlens.operators import notify as N
from leadlens.operators import relabel as R
from leadlens.operators.admin import purge_blocked
from leadlens.operators.leads import one_row
from leadlens.operators.scoring import rescore
from leadlens.session import checkpointed

STATE_TABLES = ("services", "service_aliases", "offers", "lead_metrics", "candidates")


def read_snapshot(spark: SparkSession, path: str | None, names=STATE_TABLES) -> dict[str, DataFrame]:
    """Tables of a snapshot; without one, empty tables."""
    if path is None:
        return {name: schemas.empty(spark, name) for name in names}
    return {name: schemas.with_schema(spark.read.parquet(f"{path}/{name}"), name) for name in names}


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def staged(df: DataFrame, path: str) -> DataFrame:
    """Write a frame and read it back with its schema."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class IngestJob:
    """One ingest run: signals in, next snapshot and the run's stored signals out."""

    lex: lx.Lexicon = lx.Lexicon()
    classifier: I.Classifier | None = None
    min_confidence: float = lx.MIN_CONFIDENCE

    def run(
        self,
        signals: DataFrame,
        previous: str | None,
        target: str,
        as_of: Column,
        stored_signals: DataFrame | None = None,
    ) -> None:
        """``previous`` and ``target`` are snapshot folders and must differ; ``target`` may be rewritten, which
        makes a repeated run harmless.  The new signals go to ``target/signals``, the run's counters to
        ``target/counters``; what the run wrote for itself is removed."""
        spark = signals.sparkSession
        tables = read_snapshot(spark, previous)
        passed, rows, observed = self.stage(signals, target, stored_signals)
        found = I.candidates_of(I.mentions_of(passed))
        counters = I.counters_in_passing(passed, rows, observed, stored_signals, tables["offers"])
        write_snapshot({**self.merge(tables, rows, found, as_of), "counters": counters}, target)
        remove(spark, [f"{target}/_passed", f"{target}/_rows"])

    def stage(
        self, signals: DataFrame, target: str, stored_signals: DataFrame | None = None
    ) -> tuple[DataFrame, DataFrame, dict[str, int]]:
        """Rows that a later step needs, and labelled rows that reach storage, both written below ``target`` and read
        back, with what was counted while they were written.  The texts are read once; of what was kept, labels are
        made once."""
        seen, labelled, stored = Observation(), Observation(), Observation()
        passed = staged(I.read_once(schemas.with_schema(signals, "signals_in"), self.lex, seen), f"{target}/_passed")
        kept = passed.where("kept").drop("kept", "mentions", "at", "_key", "blocked_host")
        classify = self.classifier or (lambda df: I.rule_classifier(df, self.lex))
        routed = I.route(classify(kept), self.min_confidence)
        routed = routed.observe(labelled, F.count_if("label.is_offer").alias("offers"))
        rows = I.storable(routed, stored_signals).observe(
            stored,
            F.count(F.lit(1)).alias("signals"),
            F.count_if("implausible").alias("implausible"),
            F.count_if(F.col("route") == "offer").alias("offer_observations"),
            F.count_if(F.col("route") == "candidate").alias("candidates"),
        )
        rows = staged(rows, f"{target}/_rows")
        return passed, rows, {**seen.get, **labelled.get, **stored.get}

    @staticmethod
    def merge(tables: dict[str, DataFrame], rows: DataFrame, found: DataFrame, as_of: Column) -> dict[str, DataFrame]:
        """Tables after the rows.  ``tables`` may hold a part only, if it holds all keys that the rows touch."""
        return {
            "services": I.merge_services(tables["services"], rows, as_of),
            "service_aliases": I.merge_aliases(tables["service_aliases"], rows),
            "offers": I.merge_offers(tables["offers"], rows, as_of),
            "lead_metrics": I.merge_lead_metrics(tables["lead_metrics"], rows),
            "candidates": C.merge_candidates(tables["candidates"], found, as_of),
            "signals": I.stored_signals(rows),
        }


def discovery_step(
    tables: dict[str, DataFrame], page_bodies: DataFrame, as_of: Column, limit: int | None = None, max_attempts: int = 3
) -> dict[str, DataFrame]:
    """Dequeue, decide on landed pages, promote, expand links, retire.  Returns the changed tables and counters."""
    batch = checkpointed(C.dequeue(tables["candidates"], limit, max_attempts))
    mine = page_bodies.join(batch.select("domain"), "domain", "left_semi")
    outcomes = checkpointed(C.probe_outcomes(batch, tables["services"], E.page_facts(mine), as_of))
    seeds = C.link_seeds(outcomes.where("outcome = 'promoted'")).select("domain")
    link_pages = page_bodies.where(F.col("path").isin(*lx.LINKGRAPH_PATHS) & (F.col("status") == 200)).join(
        seeds, "domain", "left_semi"
    )
    services = C.promote(tables["services"], outcomes, as_of)
    closed = C.apply_outcomes(tables["candidates"], outcomes, as_of)
    novel = C.linkgraph_candidates(link_pages, services, tables["candidates"])
    queue = C.merge_candidates(closed, novel, as_of)
    spent = (F.col("status") == "pending") & (F.col("attempts") >= max_attempts)
    counters = one_row(
        C.discovery_counters(outcomes),
        novel.agg(F.count("*").alias("linkgraph_added")),
        queue.agg(F.count_if(spent).alias("retired")),
    )
    return {"services": services, "candidates": C.retire_exhausted(queue, max_attempts), "counters": counters}


def watchdog_step(
    tables: dict[str, DataFrame],
    page_bodies: DataFrame,
    signals: DataFrame,
    as_of: Column,
    limit: int | None = None,
    certificates: DataFrame | None = None,
    weights: lx.ScoreWeights = lx.ScoreWeights(),
) -> dict[str, DataFrame]:
    """Re-check stale services on landed pages, backfill their offers, rescore all offers."""
    stale = E.stale_services(tables["services"], tables["offers"], as_of, limit=limit)
    mine = page_bodies.join(stale.select(F.col("canonical_domain").alias("domain")), "domain", "left_semi")
    facts = E.page_facts(mine)
    services = E.enrich_services(tables["services"], facts, as_of, certificates)
    offers = rescore(E.enrich_offers(tables["offers"], facts), services, signals, as_of, weights)
    return {"services": services, "offers": offers}


def maintenance(
    spark: SparkSession,
    previous: str,
    target: str,
    page_bodies: DataFrame,
    signals: DataFrame,
    as_of: Column,
    outbox: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = N.group_batch,
    recheck_limit: int | None = None,
    decide_limit: int | None = None,
) -> None:
    """Watchdog, discovery and notification over a snapshot, in that order; the outbox is written with it.  All stale
    services and pending candidates are treated unless a limit is given."""
    tables = read_snapshot(spark, previous)
    checked = watchdog_step(tables, page_bodies, signals, as_of, recheck_limit)
    services = staged(checked["services"], f"{target}/_checked_services")
    offers = staged(checked["offers"], f"{target}/_checked_offers")
    found = discovery_step({**tables, "services": services}, page_bodies, as_of, decide_limit)
    numbered = signals.withColumn("signal_id", F.col("id"))
    box = staged(outbox(offers, services, numbered), f"{target}/outbox")
    write_snapshot(
        {
            "services": found["services"],
            "candidates": found["candidates"],
            "offers": N.mark_notified(offers, box, as_of),
            "service_aliases": tables["service_aliases"],
            "lead_metrics": tables["lead_metrics"],
            "counters": found["counters"],
        },
        target,
    )


def relabel(
    spark: SparkSession,
    previous: str,
    target: str,
    signals: DataFrame,
    as_of: Column,
    external: DataFrame | None = None,
    lex: lx.Lexicon = lx.Lexicon(),
    classifier: I.Classifier | None = None,
    weights: lx.ScoreWeights = lx.ScoreWeights(),
) -> None:
    """Label all offers anew, by ``external(id, raw)`` where it has a label and by rules elsewhere, and rescore them.

    ``signals`` are the stored signals; offers whose service has no text keep their columns.
    """
    tables = read_snapshot(spark, previous)
    offers, services = tables["offers"], tables["services"]
    inputs = R.relabel_inputs(offers, services, signals.withColumn("signal_id", F.col("id")))
    labels = R.labels_or_fallback(inputs, external, lex, classifier)
    labelled = staged(R.apply_labels(offers, labels), f"{target}/_labelled")
    write_snapshot({**tables, "offers": rescore(labelled, services, signals, as_of, weights)}, target)


def purge(spark: SparkSession, previous: str, target: str, signals: DataFrame, blocked=lx.BLOCKED_DOMAINS) -> None:
    """Next snapshot without the blocked services, their aliases, offers, lead metrics and stored signals; the number
    of removed rows is written with it."""
    tables = read_snapshot(spark, previous)
    kept = purge_blocked(tables["services"], tables["offers"], signals, tables["lead_metrics"], blocked)
    ids = kept.services.select(F.col("id").alias("service_id"))
    write_snapshot(
        {
            "services": kept.services,
            "service_aliases": tables["service_aliases"].join(ids, "service_id", "left_semi"),
            "offers": kept.offers,
            "lead_metrics": kept.lead_metrics,
            "candidates": tables["candidates"],
            "signals": kept.signals,
            "counters": kept.counters,
        },
        target,
    )
