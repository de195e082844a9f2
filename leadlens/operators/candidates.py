"""Candidate domains: queue, back-off, probe outcomes, promotion and link expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens import lexicon as lx
from leadlens.functions import domains as D
from leadlens.functions.score import hours_between
from leadlens.functions.words import truthy_array, truthy_text
from leadlens.operators.ingest import service_id
from leadlens.schemas import new_rows, with_schema
from leadlens.session import checkpointed


def candidate_id(domain: Column) -> Column:
    return F.xxhash64(F.lit("candidate"), domain)


def merge_candidates(existing: DataFrame, harvested: DataFrame, as_of: Column) -> DataFrame:
    """Insert-or-ignore by domain; a later high-priority mention raises the priority, never lowers it."""
    known = with_schema(existing, "candidates")
    seen = harvested.select("domain", "first_source", F.col("priority").alias("_priority"))
    raised = (
        known.join(seen.select("domain", "_priority"), "domain", "left")
        .withColumn("priority", F.when(F.col("_priority") == "high", "high").otherwise(F.col("priority")))
        .drop("_priority")
    )
    added = seen.join(known.select("domain"), "domain", "left_anti").select(
        candidate_id(F.col("domain")).alias("id"),
        "domain",
        "first_source",
        as_of.cast("timestamp").alias("first_seen"),
        F.col("_priority").alias("priority"),
    )
    return raised.unionByName(new_rows(added, "candidates"))


def dequeue(candidates: DataFrame, limit: int | None = None, max_attempts: int = 3, max_probes: int | None = None) -> DataFrame:
    """Next batch: all pending with attempts left, or under a limit those of high priority first, then the oldest."""
    size = min((n for n in (limit, max_probes) if n is not None), default=None)
    order = [F.when(F.col("priority") == "high", 0).otherwise(1), F.col("first_seen"), F.col("id")]
    due = candidates.where((F.col("status") == "pending") & (F.col("attempts") < max_attempts))
    return due if size is None else due.orderBy(*order).limit(size)


def waits_for_retry(attempts: Column, probed_at: Column, as_of: Column) -> Column:
    """True while the back-off of 1, 6, then 24 hours since the last probe has not passed."""
    steps = F.array(*[F.lit(h) for h in lx.RETRY_HOURS])
    wait = F.try_element_at(steps, F.least(F.greatest(attempts, F.lit(1)), F.lit(len(lx.RETRY_HOURS))))
    return F.coalesce((attempts > 0) & (hours_between(as_of, probed_at) < wait), F.lit(False))


def should_promote(
    alive: Column, models: Column, engine: Column, is_relay: Column, triggers: Column, amount: Column, pricing: Column
) -> Column:
    """Alive, looks like an AI product, and has an offer signal (a confirmed gateway needs none)."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    ai = (F.coalesce(F.size(models), F.lit(0)) > 0) | truthy_text(engine).isNotNull() | yes(is_relay)
    offer = yes(is_relay) | yes(triggers) | amount.isNotNull() | yes(pricing)
    return yes(alive) & ai & offer


def probe_outcomes(batch: DataFrame, services: DataFrame, page_facts: DataFrame, as_of: Column) -> DataFrame:
    """Outcome of each dequeued candidate: waiting, rejected, known, failed, promoted.

    ``page_facts`` stands for the probe; a domain without facts counts as a failed probe and stays pending.
    """
    reg = F.coalesce(D.registrable_domain(F.col("domain")), F.col("domain"))
    facts = page_facts.select(F.col("domain").alias("reg"), F.struct(*page_facts.columns).alias("facts"))
    known = services.select(F.col("canonical_domain").alias("reg"), F.lit(True).alias("is_service"))
    f = F.col("facts")
    promote = should_promote(
        f["alive"], f["models"], f["engine"], f["is_relay"], f["pricing_triggers"], f["amount"], f["has_pricing"]
    )
    return (
        batch.withColumn("reg", reg)
        .join(known, "reg", "left")
        .join(facts, "reg", "left")
        .withColumn(
            "outcome",
            F.when(waits_for_retry(F.col("attempts"), F.col("probed_at"), as_of), "waiting")
            .when(D.is_blocked(F.col("reg")) | ~D.safe_to_probe(F.col("reg")), "unsafe")
            .when(F.coalesce("is_service", F.lit(False)), "known")
            .when(f.isNull(), "failed")
            .when(promote, "promoted")
            .otherwise("rejected"),
        )
        .drop("is_service")
    )


_SUMMARY = ("alive", "status", "title", "engine", "has_pricing", "pricing_triggers", "models", "amount")
_STATUS_AFTER = {"unsafe": "rejected", "known": "known", "promoted": "promoted", "rejected": "rejected"}


def apply_outcomes(candidates: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Close or retry: status, probe time, result and attempts; a waiting candidate is untouched and a failed
    one stays pending with one attempt more."""
    after = F.col("status")
    for outcome, status in _STATUS_AFTER.items():
        after = F.when(F.col("outcome") == outcome, status).otherwise(after)
    touched = F.col("outcome").isNotNull() & (F.col("outcome") != "waiting")
    summary = F.when(
        F.col("outcome").isin("promoted", "rejected"), F.to_json(F.struct(*[F.col(f"facts.{c}") for c in _SUMMARY]))
    )
    joined = candidates.join(outcomes.select("id", "outcome", summary.alias("_summary")), "id", "left")
    out = joined.withColumns(
        {
            "status": after,
            "probed_at": F.when(touched, as_of.cast("timestamp")).otherwise(F.col("probed_at")),
            "probe_result": F.coalesce("_summary", "probe_result"),
            "attempts": F.when(touched, F.col("attempts") + 1).otherwise(F.col("attempts")),
        }
    )
    return with_schema(out, "candidates")


def retire_exhausted(candidates: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Pending candidates without attempts left become rejected."""
    spent = (F.col("status") == "pending") & (F.col("attempts") >= max_attempts)
    return candidates.withColumn("status", F.when(spent, "rejected").otherwise(F.col("status")))


def discovery_counters(outcomes: DataFrame) -> DataFrame:
    """Counts per outcome; ``skipped`` are the candidates decided without a probe."""
    o = F.col("outcome")
    return outcomes.agg(
        F.count_if(o.isin("promoted", "rejected")).alias("probed"),
        F.count_distinct(F.when(o == "promoted", F.col("reg"))).alias("promoted"),  # services, not hosts
        F.count_if(o == "rejected").alias("rejected"),
        F.count_if(o.isin("waiting", "unsafe", "known")).alias("skipped"),
    )


def promote(services: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Append promoted domains as new services named by their title; existing services are not overwritten."""
    fresh = (
        outcomes.where("outcome = 'promoted'")
        .groupBy("reg")
        .agg(F.min_by("facts", "id").alias("facts"))
        .select(
            service_id(F.col("reg")).alias("id"),
            F.col("reg").alias("canonical_domain"),
            F.coalesce(truthy_text(F.col("facts.title")), F.col("reg")).alias("name"),
            truthy_array(F.col("facts.models")).alias("models"),
            as_of.cast("timestamp").alias("first_seen"),
        )
        .join(services.select("canonical_domain"), "canonical_domain", "left_anti")
    )
    return with_schema(services, "services").unionByName(new_rows(fresh, "services"))


def link_seeds(promoted: DataFrame, max_probes: int | None = None) -> DataFrame:
    """The promoted domains whose pages are expanded: all, or the first ``max_probes``."""
    return promoted if max_probes is None else promoted.orderBy("first_seen", "id").limit(max_probes)


def outbound_domains(pages: DataFrame) -> DataFrame:
    """Edges (domain, target): registrable domains of the URLs in a page, other than the page's own."""
    source = F.coalesce(D.registrable_domain(F.col("domain")), F.col("domain"))
    return (
        pages.select(F.col("domain"), source.alias("_own"), F.explode(D.extract_urls(F.col("body"))).alias("url"))
        .select("domain", "_own", D.registrable_domain(F.col("url")).alias("target"))
        .where("target IS NOT NULL AND target <> _own")
        .select("domain", "target")
        .distinct()
    )


def expand_links(edges: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """Domains that ``seeds(domain)`` reach over ``edges(domain, target)``, with the least number of ``hop``s; seeds have 0.

    A hop joins the edges to the domains that the last one was first to reach, so an edge is followed once.  It ends where
    nothing new is reached, or after ``hops``.  Every hop is checkpointed; edges should be written, as each hop reads them.
    Blocked domains are neither reached nor followed.
    """
    open_ = ~F.coalesce(F.col("domain").isin(*lx.BLOCKED_DOMAINS), F.lit(False))
    reached = newest = checkpointed(seeds.where(open_).select("domain").distinct().withColumn("hop", F.lit(0)))
    hop = 0
    while hops is None or hop < hops:
        hop += 1
        targets = edges.join(newest.select("domain"), "domain").select(F.col("target").alias("domain")).distinct()
        newest = checkpointed(targets.where(open_).join(reached, "domain", "left_anti").withColumn("hop", F.lit(hop)))
        if newest.isEmpty():
            break
        reached = reached.unionByName(newest)
    return reached


def linkgraph_candidates(pages: DataFrame, services: DataFrame, candidates: DataFrame) -> DataFrame:
    """Novel outbound domains as harvested candidates of source ``linkgraph``."""
    targets = outbound_domains(pages).select(F.col("target").alias("domain")).distinct()
    novel = (
        targets.where(~F.coalesce(F.col("domain").isin(*lx.BLOCKED_DOMAINS), F.lit(False)))
        .join(services.select(F.col("canonical_domain").alias("domain")), "domain", "left_anti")
        .join(candidates.select("domain"), "domain", "left_anti")
    )
    return novel.select("domain", F.lit("linkgraph").alias("first_source"), F.lit("normal").alias("priority"))
