"""Counts and shares for the statistics pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens.functions.words import truthy_text
from leadlens.operators.leads import one_row


def totals(services: DataFrame, offers: DataFrame) -> DataFrame:
    """Services, active and dead services, and offers: one pass over each table."""
    s = services.agg(
        F.count("*").alias("services"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "dead").alias("dead"),
    )
    return one_row(s, offers.agg(F.count("*").alias("offers")))


def status_share(services: DataFrame, offers: DataFrame) -> DataFrame:
    """Totals with the rounded percentage of active and dead services."""
    percent = lambda c: F.when(F.col("services") > 0, F.round(100 * F.col(c) / F.col("services"))).otherwise(0)
    return totals(services, offers).withColumns(
        {"active_pct": percent("active").cast("int"), "dead_pct": percent("dead").cast("int")}
    )


def count_by(rows: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    if not keep_null:
        rows = rows.where(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count("*").alias("count"))


def with_bar_percent(counts: DataFrame) -> DataFrame:
    """Count as a rounded percentage of the largest one (the input has one row per label)."""
    top = F.greatest(F.max("count").over(Window.partitionBy()), F.lit(1))
    return counts.withColumn("bar_pct", F.round(100 * F.col("count") / top).cast("int"))


def signals_by_source(signals: DataFrame, limit: int | None = None) -> DataFrame:
    """Signals per source, most first; ``limit`` 10 is the edge form."""
    out = count_by(signals, "source").orderBy(F.desc("count"), "source")
    return out if limit is None else out.limit(limit)


def description_coverage(offers: DataFrame, drop_empty: bool = True) -> DataFrame:
    """Offers with a description and all offers; the edge form counts empty strings too."""
    described = F.col("description").isNotNull()
    if drop_empty:
        described = truthy_text(F.col("description")).isNotNull()
    return offers.agg(F.count_if(described).alias("with_description"), F.count("*").alias("offers_total"))


def model_ranking(offers: DataFrame, services: DataFrame, include_dead: bool = False) -> DataFrame:
    """Offers per model label, lower case; offers of dead services are left out unless asked for."""
    alive = services if include_dead else services.where(F.coalesce(F.col("status") != "dead", F.lit(True)))
    live = offers.select("service_id", "models").join(
        alive.select(F.col("id").alias("service_id")), "service_id", "left_semi"
    )
    labels = live.select(F.explode("models").alias("model"))
    ranked = labels.groupBy(F.lower("model").alias("model")).agg(F.count("*").alias("count"))
    return ranked.orderBy(F.desc("count"), "model")


def top_models(offers: DataFrame, services: DataFrame, limit: int = 12) -> DataFrame:
    return model_ranking(offers, services).limit(limit)
