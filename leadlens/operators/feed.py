"""Feed queries: filters, sorts, earliest source, votes, best offer per domain, service detail."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlens import lexicon as lx
from leadlens.functions.display import channel_label
from leadlens.functions.words import truthy_text
from leadlens.operators.leads import first_source
from leadlens.operators.votes import vote_totals
from leadlens.session import checkpointed


@dataclass(frozen=True)
class FeedFilter:
    """Feed request.  ``variant`` picks between the two published forms of the feed:

    ``api``   inner join to services, free text also over claim steps, effort filter, model filter before paging;
    ``edge``  left join to services, no effort filter, window clamped to [1, 8760] hours, model filter after paging.
    """

    type: str | None = None
    effort: str | None = None
    min_amount: float | None = None
    model: str | None = None
    status: str | None = None
    q: str | None = None
    sort: str | None = None
    since_hours: float | None = None
    limit: int | None = 100
    offset: int = 0
    variant: str = "api"


def joined_offers(offers: DataFrame, services: DataFrame, how: str = "inner") -> DataFrame:
    """Offers with their service's columns (prefixed ``service_`` where the names meet)."""
    s = services.select(
        F.col("id").alias("service_id"),
        F.col("canonical_domain").alias("service_domain"),
        F.col("name").alias("service_name"),
        F.col("status").alias("service_status"),
        "reliability",
        "engine",
        "domain_first_seen",
    )
    return offers.drop("canonical_domain").join(s, "service_id", how)


def has_model(models: Column, needle: str) -> Column:
    wanted = F.lit(needle.lower())
    return F.coalesce(F.exists(models, lambda m: F.contains(F.lower(m), wanted)), F.lit(False))


def _filtered(rows: DataFrame, f: FeedFilter, as_of: Column) -> DataFrame:
    tests = []
    if f.type:
        tests.append(F.col("type") == f.type)
    if f.effort and f.variant == "api":
        tests.append(F.col("effort") == f.effort)
    if f.min_amount is not None:
        tests.append(F.col("amount") >= f.min_amount)
    if f.status:
        tests.append(F.col("service_status") == f.status)
    if f.since_hours:
        hours = f.since_hours if f.variant == "api" else max(1.0, min(float(f.since_hours), 8760.0))
        micros = F.unix_micros(as_of.cast("timestamp")) - int(hours * 3.6e9)
        tests.append(F.col("first_seen_at") >= F.timestamp_micros(micros))
    if f.q:
        needle = F.lit(f.q.lower())
        fields = ["service_domain", "service_name"] + (["claim_steps"] if f.variant == "api" else [])
        hit = F.lit(False)
        for name in fields:
            hit = hit | F.contains(F.lower(F.coalesce(name, F.lit(""))), needle)
        tests.append(hit)
    if f.model and f.variant == "api":
        tests.append(has_model(F.col("models"), f.model))
    for test in tests:
        rows = rows.where(test)
    return rows


def sort_order(sort: str | None) -> list[Column]:
    """``new``, ``amount`` or the default by score; the id makes the order total."""
    if sort == "new":
        return [F.desc("first_seen_at"), F.desc("score"), F.asc("id")]
    if sort == "amount":
        return [F.desc_nulls_last("amount"), F.desc("score"), F.asc("id")]
    return [F.desc("score"), F.desc("first_seen_at"), F.asc("id")]


def public_offer(rows: DataFrame, variant: str = "api") -> DataFrame:
    """Public shape of joined rows."""
    models = F.coalesce("models", F.array().cast("array<string>"))
    name = F.col("service_name") if variant == "api" else F.col("service_domain")
    status = (
        F.coalesce("service_status", "status")
        if variant == "api"
        else F.coalesce(truthy_text(F.col("service_status")), F.col("status"))
    )
    columns = [
        F.col("id"),
        F.col("service_id"),
        F.col("service_domain").alias("domain"),
        F.coalesce(truthy_text(name), F.col("url")).alias("name"),
        "type", "amount", "currency", models.alias("models"), "claim_steps", "requirements",
        F.coalesce("referral_required", F.lit(False)).alias("referral_required"),
        "effort", "unit", "description", "url",
        F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"),
        status.alias("status"),
        "reliability", "engine", "domain_first_seen", "first_seen_at",
    ]
    extra = [c for c in ("conditions", "likes", "dislikes", "source", "source_url") if c in rows.columns]
    return rows.select(*columns, *extra)


def feed(
    offers: DataFrame,
    services: DataFrame,
    signals: DataFrame,
    f: FeedFilter = FeedFilter(),
    as_of: Column | None = None,
    votes: DataFrame | None = None,
) -> DataFrame:
    """Filtered, sorted and paged offers with their earliest source (and votes in the edge form).

    The page is cut before the signals are touched: only the signals of the paged offers are aggregated.
    """
    as_of = as_of if as_of is not None else F.current_timestamp()
    how = "inner" if f.variant == "api" else "left"
    rows = _filtered(joined_offers(offers, services, how), f, as_of).orderBy(*sort_order(f.sort))
    if f.offset:
        rows = rows.offset(f.offset)
    if f.limit is not None:
        rows = rows.limit(f.limit)
    rows = checkpointed(rows)  # read by three branches below
    if f.model and f.variant == "edge":
        rows = rows.where(has_model(F.col("models"), f.model))
    paged = rows.select(F.col("id").alias("offer_id"))
    mine = signals.join(paged, "offer_id", "left_semi")
    out = rows.join(first_source(mine).withColumnRenamed("offer_id", "id"), "id", "left")
    if f.variant == "edge" and votes is not None:
        totals = vote_totals(votes.join(paged, "offer_id", "left_semi")).withColumnRenamed("offer_id", "id")
        out = out.join(totals, "id", "left").fillna(0, ["likes", "dislikes"])
    return public_offer(out, f.variant).orderBy(*sort_order(f.sort))


@dataclass(frozen=True)
class ViewFilter:
    """Reader-side view of a feed: tab, chips and sort."""

    tab: str = "all"
    live_only: bool = False
    source_category: str | None = None
    engine: str | None = None
    no_referral: bool = False
    sort: str = "score"
    categories: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(lx.SOURCE_CATEGORIES))


def best_per_domain(items: DataFrame) -> DataFrame:
    """Best-scored offer per domain, lowest id on ties; offers without a domain all stay.

    Offers without a domain get a key of their own so that they do not meet in one group.
    """
    key = F.coalesce(F.concat(F.lit("d:"), truthy_text(F.col("domain"))), F.concat(F.lit("o:"), F.col("id").cast("string")))
    order = Window.partitionBy("_key").orderBy(F.desc("score"), F.asc("id"))
    ranked = items.withColumn("_key", key).withColumn("_n", F.row_number().over(order))
    return ranked.where("_n = 1").drop("_key", "_n")


def feed_view(items: DataFrame, v: ViewFilter = ViewFilter(), saved: DataFrame | None = None) -> DataFrame:
    """Reader-side filters, best offer per domain and re-sort over feed items."""
    tab = lx.TAB_FILTERS[v.tab]
    if "effort" in tab:
        items = items.where(F.col("effort") == tab["effort"])
    if "status" in tab:
        items = items.where(F.col("status") == tab["status"])
    if v.tab == "saved" and saved is not None:
        items = items.join(saved.select("id"), "id", "left_semi")
    if v.live_only:
        items = items.where(truthy_text(F.col("source")).isNotNull() & (F.col("source") != "export"))
    if v.source_category:
        items = items.where(F.col("source").isin(*v.categories[v.source_category]))
    if v.engine:
        items = items.where(F.col("engine") == v.engine)
    if v.no_referral:
        items = items.where(~F.col("referral_required"))
    if v.tab != "dead":
        items = best_per_domain(items.where(F.col("type") != "model_release"))
    if v.sort == "newest":
        order = [F.desc_nulls_last("first_seen_at"), F.asc("id")]
    elif v.sort == "amount":
        order = [F.coalesce("amount", F.lit(0.0)).desc(), F.asc("id")]
    else:
        order = [F.desc("score"), F.asc("id")]
    return items.orderBy(*order)


# ------------------------------------------------------------------ service detail, as rows
def latest_signals(signals: DataFrame, n: int = 20) -> DataFrame:
    """The newest signals per service.  The row-number filter also runs before the shuffle."""
    order = Window.partitionBy("service_id").orderBy(F.desc("observed_at"), F.desc("signal_id"))
    ranked = signals.where(F.col("service_id").isNotNull()).withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= n)


def public_signal(signals: DataFrame) -> DataFrame:
    return signals.select(
        "service_id", "signal_id", "source", "source_url", channel_label(F.col("source_url")).alias("channel"),
        F.substring(F.coalesce("raw_text", F.lit("")), 1, 1200).alias("raw_text"), "observed_at",
    )


def service_offers(offers: DataFrame, services: DataFrame) -> DataFrame:
    """Offer rows of each service, in the public shape."""
    return public_offer(joined_offers(offers, services))


def provenance(signals: DataFrame) -> DataFrame:
    """Signals of a service without repeats: real links first, then longer texts, one per locator."""
    http = F.when(F.startswith(F.coalesce("source_url", F.lit("")), F.lit("http")), 1).otherwise(0)
    locator = F.coalesce("source_url", F.concat(F.col("source"), F.lit(":"), F.coalesce("raw_text", F.lit(""))))
    length = F.length(F.coalesce("raw_text", F.lit("")))
    order = Window.partitionBy("service_id", "_key").orderBy(F.desc("_http"), F.desc("_len"), F.asc("signal_id"))
    ranked = signals.withColumns({"_key": F.xxhash64(locator), "_http": http, "_len": length}).withColumn(
        "_n", F.row_number().over(order)
    )
    return ranked.where("_n = 1").drop("_key", "_http", "_len", "_n")


def richest_signal(signals: DataFrame, key: str = "service_id") -> DataFrame:
    """Longest text per key, first one on ties."""
    return (
        signals.where(truthy_text(F.col("raw_text")).isNotNull())
        .groupBy(key)
        .agg(F.max_by("raw_text", F.struct(F.length("raw_text").alias("n"), (-F.col("signal_id")).alias("s"))).alias("raw_text"))
    )
