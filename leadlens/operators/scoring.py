"""Offer scores: recency decay, quality, cross-source evidence and the early-language bonus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens import lexicon as lx
from leadlens.functions import score as S


def service_evidence(signals: DataFrame, weights: lx.ScoreWeights = lx.ScoreWeights()) -> DataFrame:
    """Per service: number of distinct sources, and whether it is early (zh or ru seen, en not).

    Signals are first reduced to their distinct (service, source, language), so a service with most of the
    signals shuffles a few rows per map task.
    """
    lang = S.signal_lang(F.col("source"), F.col("lang"), weights.source_lang)
    distinct = (
        signals.where(F.col("service_id").isNotNull()).select("service_id", "source", lang.alias("_lang")).distinct()
    )
    per_source = distinct.groupBy("service_id", "source").agg(
        F.max(F.coalesce(F.col("_lang") == "en", F.lit(False))).alias("en"),
        F.max(F.coalesce(F.col("_lang").isin("zh", "ru"), F.lit(False))).alias("cascade"),
    )
    return per_source.groupBy("service_id").agg(
        F.count("source").alias("source_count"), (F.max("cascade") & ~F.max("en")).alias("is_early")
    )


def _joined(offers: DataFrame, services: DataFrame, signals: DataFrame, weights: lx.ScoreWeights) -> DataFrame:
    """Offers with ``_quality``, ``_sources`` and ``_early``; without a service they count with reliability 0."""
    trust = services.select(F.col("id").alias("service_id"), F.col("reliability").alias("_reliability"))
    evidence = service_evidence(signals, weights).select(
        "service_id", F.col("source_count").alias("_sources"), F.col("is_early").alias("_early")
    )
    value = S.quality(
        F.col("amount"), F.col("type"), F.coalesce("referral_required", F.lit(False)), F.col("_reliability"), weights
    )
    joined = offers.join(trust, "service_id", "left").join(evidence, "service_id", "left")
    return joined.withColumns(
        {"_quality": value, "_sources": F.coalesce("_sources", F.lit(0)), "_early": F.coalesce("_early", F.lit(False))}
    ).drop("_reliability")


def _score(as_of: Column, weights: lx.ScoreWeights, prefix: str = "_") -> Column:
    age = F.greatest(S.hours_between(as_of, F.coalesce("first_seen_at", as_of.cast("timestamp"))), F.lit(0.0))
    base = S.compose(age, F.col(f"{prefix}quality"), weights.half_life_hours)
    return S.with_boosts(base, F.col(f"{prefix}sources"), F.col(f"{prefix}early"), weights.early_boost)


def rescore(
    offers: DataFrame,
    services: DataFrame,
    signals: DataFrame,
    as_of: Column,
    weights: lx.ScoreWeights = lx.ScoreWeights(),
) -> DataFrame:
    """Offers with a fresh ``score``; offers without a service count with reliability 0."""
    out = _joined(offers, services, signals, weights).withColumn("score", _score(as_of, weights))
    return out.select(*offers.columns) if "score" in offers.columns else out.select(*offers.columns, "score")


# ------------------------------------------------------------------ rank without a time
# What two roundings to four digits, before and after the source factor, can add at most, and some room for sums.
_ROUNDED = 2e-4


def _micros(value: Column) -> Column:
    return F.unix_micros(value.cast("timestamp"))


def _decay(micros: Column, weights: lx.ScoreWeights) -> Column:
    """Natural logarithm of the decay over a time."""
    return micros * (math.log(2) / (weights.half_life_hours * 3.6e9))


def ranked(
    offers: DataFrame, services: DataFrame, signals: DataFrame, weights: lx.ScoreWeights = lx.ScoreWeights()
) -> DataFrame:
    """Offers with ``quality``, ``sources``, ``early`` and ``rank``, which hold whatever the time is.

    All scores fade by one factor, so the logarithm of quality and source factor plus the first time over the half-life
    orders them once and for all, among early offers and among the others (the bonus of early ones does not fade).  Write
    the result sorted by ``rank``; :func:`top_by_score` then reads few of its rows.
    """
    rows = _joined(offers, services, signals, weights)
    band = lx.QUALITY_FLOOR + (1.0 - lx.QUALITY_FLOOR) * F.col("_quality")
    strength = F.ln(band * S.source_factor(F.col("_sources")))
    rank = F.coalesce(strength, F.lit(float("-inf"))) + F.coalesce(_decay(_micros(F.col("first_seen_at")), weights), F.lit(float("inf")))
    return rows.withColumn("rank", rank).withColumnsRenamed({"_quality": "quality", "_sources": "sources", "_early": "early"})


def top_by_score(
    rows: DataFrame, as_of: Column, limit: int, offset: int = 0, weights: lx.ScoreWeights = lx.ScoreWeights()
) -> DataFrame:
    """A page of ``ranked`` offers in the order of their score at ``as_of``, with the score: as if all had been rescored.

    The highest ranks of both kinds give a score that the page's last offer reaches at least.  An offer with that score has
    at least the rank that follows from it, so only offers from that rank on are scored: those that share the last score
    after rounding, or were not seen yet at ``as_of``, among them.
    """
    size = limit + offset
    scored = lambda frame: frame.withColumn("score", _score(as_of, weights, ""))
    highest = [rows.where(test).orderBy(F.desc("rank"), "id").limit(size) for test in (F.col("early"), ~F.col("early"))]
    some = scored(highest[0].unionByName(highest[1])).orderBy(F.desc("score")).limit(size)
    # fewer offers than the page holds: all of them are wanted
    reached = some.agg(F.when(F.count("*") == size, F.min("score")).alias("_reached"))
    least = F.col("_reached") - _ROUNDED - F.when(F.col("early"), weights.early_boost).otherwise(0.0)
    bound = F.when(least > 0, F.ln(least) + _decay(_micros(as_of), weights) - 1e-6)
    wanted = rows.join(F.broadcast(reached), bound.isNull() | (F.col("rank") >= bound)).drop("_reached")
    page = scored(wanted).orderBy(F.desc("score"), F.desc("first_seen_at"), F.asc("id"))
    return (page.offset(offset) if offset else page).limit(limit)
