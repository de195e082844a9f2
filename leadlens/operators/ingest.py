"""Signals to services, offers and stored signals: normalise, label, route, deduplicate, merge.

Arrival order decides every first-wins merge: ``ingest_seq``, then ``place``, then source and content (``arrival``), so
that it is total and independent of the partitions.  Ids are hashes of natural keys, so rows refer to each other without
a join and two runs over the same input give the same tables; merges group by the natural keys themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from leadlens import lexicon as lx
from leadlens.functions import domains as D
from leadlens.functions import text as X
from leadlens.functions.score import lead_hours
from leadlens.functions.words import bind, truthy_array, truthy_number, truthy_text
from leadlens.schemas import new_rows, with_schema
from leadlens.session import checkpointed

Classifier = Callable[[DataFrame], DataFrame]


# ------------------------------------------------------------------ ids
def service_id(domain: Column) -> Column:
    return F.xxhash64(F.lit("service"), domain)


def offer_id(domain: Column, offer_type: Column, url: Column | None = None) -> Column:
    extra = [] if url is None else [url]
    return F.xxhash64(F.lit("offer"), domain, offer_type, *extra)


def early_key(source: Column, source_url: Column, url: Column, raw_text: Column) -> Column:
    """Key of an observation before it is stored: source, then the best locator it has, else a digest of the whole text."""
    locator = F.coalesce(truthy_text(source_url), truthy_text(url), F.sha2(truthy_text(raw_text), 256), F.lit(""))
    return F.concat(source, F.lit("|"), locator)


# ------------------------------------------------------------------ narrow steps
def normalize(signals: DataFrame) -> DataFrame:
    """Adds ``domains``; fills a missing ``lang`` from the text and a missing ``url`` from the first domain."""
    body = F.coalesce(truthy_text(F.col("raw_text")), truthy_text(F.col("url")), F.lit(""))
    return signals.withColumns(
        {
            "lang": F.coalesce(truthy_text(F.col("lang")), X.detect_lang(body)),
            "domains": D.service_domains(F.col("url"), F.col("raw_text")),
        }
    ).withColumn(
        "url",
        F.coalesce(truthy_text(F.col("url")), F.concat(F.lit("https://"), F.get("domains", F.lit(0)))),
    )


def meta_flag(name: str) -> Column:
    return F.coalesce(F.col(f"meta.{name}"), F.lit(False))


def blocked_host() -> Column:
    """True for rows whose first domain is blocked, model releases excepted."""
    host = D.registrable_of_canonical(F.get("domains", F.lit(0)))
    return F.coalesce(host.isin(*lx.BLOCKED_DOMAINS), F.lit(False)) & ~meta_flag("model_release")


def prefiltered(normalized: DataFrame, lex: lx.Lexicon = lx.Lexicon()) -> DataFrame:
    """All rows with ``match`` (decision and words), ``matched`` and ``kept`` (matched, or forced)."""
    return normalized.withColumn("match", X.prefilter(F.col("raw_text"), lex)).withColumns(
        {"matched": F.col("match.ok"), "kept": F.col("match.ok") | meta_flag("force_classify")}
    )


@lru_cache(maxsize=64)
def _passes(lex: lx.Lexicon, _jvm: int) -> Column:
    return X.passes_prefilter(F.col("raw_text"), lex)


def keep_matched(normalized: DataFrame, lex: lx.Lexicon = lx.Lexicon()) -> DataFrame:
    """Rows that pass the pre-filter or are forced, with ``matched``.

    A row that was not forced is here because it matched, so the text is tested twice only for forced rows.
    """
    force = meta_flag("force_classify")
    passes = _passes(lex, id(SparkContext._jvm))
    return normalized.where(force | passes).withColumn("matched", F.when(force, passes).otherwise(True))


@lru_cache(maxsize=64)
def _rule_columns(lex: lx.Lexicon, _jvm: int) -> tuple[dict[str, Column], dict[str, Column], Column]:
    """Columns of the rule classifier in three stages; shared pieces are staged so that each pattern runs once
    per row.  Columns are immutable and depend on the word lists only, so every micro-batch reuses them."""
    body = F.coalesce(F.col("raw_text"), F.lit(""))
    first = {"_text": body, "_low": F.lower(body)}
    text, low, lang, url = F.col("_text"), F.col("_low"), F.col("lang"), F.col("url")
    second = {
        "_money": X.parse_amount(text),
        "_models": X.find_models(text, lex.models),
        "_referral": X.is_referral(text, url),
        "_type": X.guess_type(text, low, lang),
    }
    amount, currency, referral, kind = F.col("_money.amount"), F.col("_money.currency"), F.col("_referral"), F.col("_type")
    none = F.lit(None).cast("string")
    confidence = (
        F.lit(0.45)
        + F.when(F.coalesce(amount, F.lit(0.0)) != 0, 0.25).otherwise(0.0)
        + F.when(F.size("_models") > 0, 0.15).otherwise(0.0)
    )
    label = F.struct(
        F.lit(True).alias("is_offer"),
        F.get("domains", F.lit(0)).alias("service_name"),
        kind.alias("offer_type"),
        amount.alias("amount"),
        currency.alias("currency"),
        F.col("_models").alias("models"),
        none.alias("claim_steps"),
        none.alias("requirements"),
        referral.alias("referral_required"),
        X.detect_effort(low, referral).alias("effort"),
        X.detect_unit(low, amount, currency).alias("unit"),
        X.guess_topic(low, kind).alias("topic"),
        X.detect_conditions(low, url, referral).alias("conditions"),
        F.least(confidence, F.lit(0.95)).alias("confidence"),
    ).cast(X.LABEL_TYPE)
    return first, second, F.when(F.col("matched"), label).otherwise(X.not_offer())


def rule_classifier(frame: DataFrame, lex: lx.Lexicon = lx.Lexicon()) -> DataFrame:
    """Adds ``label`` from the word rules.  Needs raw_text, url, lang, domains and matched."""
    first, second, label = _rule_columns(lex, id(SparkContext._jvm))
    out = frame.withColumns(first).withColumns(second).withColumn("label", label)
    return out.drop(*first, *second)


def route(classified: DataFrame, min_confidence: float = lx.MIN_CONFIDENCE) -> DataFrame:
    """Adds ``blocked``, ``implausible``, ``route`` (offer, model_release, candidate, signal) and the keys
    ``service_key`` and ``offer_type`` the row attaches to."""
    label = F.col("label")
    first, reg = F.col("_host"), F.col("_reg")
    has_domain = first.isNotNull()
    release = meta_flag("model_release")
    plausible = X.is_plausible(label)
    kind = (
        F.when(label["is_offer"] & plausible & (label["confidence"] >= min_confidence) & has_domain, "offer")
        .when(release & truthy_text(F.col("url")).isNotNull(), "model_release")
        .when(meta_flag("service_candidate") & has_domain, "candidate")
        .otherwise("signal")
    )
    org = F.lower(F.coalesce(truthy_text(F.col("meta.org")), F.lit("hf")))
    keyed = classified.withColumn("_host", F.get("domains", F.lit(0))).withColumn("_reg", D.registrable_of_canonical(first))
    return (
        keyed.withColumns(
            {
                "blocked": F.coalesce(reg.isin(*lx.BLOCKED_DOMAINS), F.lit(False)) & ~release,
                "implausible": label["is_offer"] & ~plausible,
                "route": kind,
            }
        )
        .withColumn(
            "service_key",
            F.when(F.col("route").isin("offer", "candidate"), F.coalesce(reg, first)).when(
                F.col("route") == "model_release", F.concat(F.lit("hf/"), org)
            ),
        )
        .withColumn(
            "offer_type",
            F.when(F.col("route") == "offer", label["offer_type"]).when(
                F.col("route") == "model_release", "model_release"
            ),
        )
        .drop("_host", "_reg")
    )


def label_signals(
    signals: DataFrame,
    lex: lx.Lexicon = lx.Lexicon(),
    classifier: Classifier | None = None,
    min_confidence: float = lx.MIN_CONFIDENCE,
) -> DataFrame:
    """All narrow steps: one stage without a shuffle, rows that fail the pre-filter dropped."""
    classify = classifier or (lambda df: rule_classifier(df, lex))
    return route(classify(keep_matched(normalize(signals), lex)), min_confidence)


# ------------------------------------------------------------------ duplicates
def arrival() -> Column:
    """Total order of rows; the last field only settles rows that arrive at one place with one source."""
    return F.struct("ingest_seq", "place", "source", F.xxhash64("source_url", "url", "raw_text").alias("tie"))


def _locator() -> Column:
    """What a row with a ``source_url`` is stored under; rows of a listing add their own key.  NULL without one."""
    of_list = F.coalesce(F.concat(F.lit("\n"), truthy_text(F.col("row_key"))), F.lit(""))
    return F.concat(F.lit("="), truthy_text(F.col("source_url")), of_list)


def locator_key() -> Column:
    """Stored key of a row; rows without a source_url get a key of their own and are never duplicates."""
    own = F.to_json(F.struct("ingest_seq", "place", F.sha2(F.to_json(F.struct("url", "raw_text")), 256).alias("content")))
    return F.coalesce(_locator(), F.concat(F.lit("#"), own))


def stored_keys(stored: DataFrame) -> DataFrame:
    """Source and key of the stored rows that have a ``source_url``."""
    if "_key" in stored.columns:  # kept as keys already
        return stored.select("source", "_key")
    if "row_key" not in stored.columns:
        stored = stored.withColumn("row_key", F.lit(None).cast("string"))
    return stored.select("source", _locator().alias("_key")).where(F.col("_key").isNotNull())


def first_per_key(rows: DataFrame) -> DataFrame:
    """First row per (source, source_url, row_key).  The ``row_number <= 1`` filter is also applied before the shuffle,
    so a key that holds most rows sends one row per map task."""
    order = Window.partitionBy("source", "_key").orderBy(arrival())
    return rows.withColumn("_key", locator_key()).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop(
        "_key", "_n"
    )


def storable(routed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Rows that reach storage: not blocked, first of their key, and not stored before."""
    fresh = first_per_key(routed.where(~F.col("blocked")))
    if stored is None:
        return fresh
    keyed = fresh.withColumn("_key", locator_key())
    return keyed.join(stored_keys(stored), ["source", "_key"], "left_anti").drop("_key").select(*fresh.columns)


def outcome_counts(routed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Per-row outcome (dup, blocked or stored) reduced to counts, on key columns only.

    A row is a duplicate when a row of its key was stored earlier; blocked rows are not stored and so do not
    make later rows duplicates.  Rows without a ``source_url`` are counted where they are.  Others are aggregated per
    key, with partial results before the shuffle; only blocked rows of keys that also have a stored row are looked at
    again, those before it being blocked and those after it duplicates.
    """
    flags = F.struct("route", "implausible")
    narrow = routed.select(
        "source", _locator().alias("_key"), arrival().alias("_at"), "blocked", flags.alias("flags"),
        F.col("label.is_offer").alias("is_offer"),
    )
    alone, keyed = narrow.where(F.col("_key").isNull()), narrow.where(F.col("_key").isNotNull())
    free = F.when(~F.col("blocked"), F.col("_at"))
    keys = keyed.groupBy("source", "_key").agg(
        F.count("*").alias("rows"), F.count_if("blocked").alias("blocked_rows"), F.count_if("is_offer").alias("offers"),
        F.min(free).alias("first"), F.min_by("flags", free).alias("flags"),
    )
    keys = keys.withColumn("known", F.lit(False))
    if stored is not None:
        known = stored_keys(stored).distinct().withColumn("_known", F.lit(True))
        keys = keys.join(known, ["source", "_key"], "left").withColumn("known", F.coalesce("_known", F.lit(False)))
    new, none_free = ~F.col("known") & F.col("first").isNotNull(), ~F.col("known") & F.col("first").isNull()
    mixed = keys.where(new & (F.col("blocked_rows") > 0)).select("source", "_key", "first")
    before = keyed.where("blocked").join(mixed, ["source", "_key"]).agg(F.count_if(F.col("_at") < F.col("first")).alias("blocked"))

    def kept(condition: Column) -> list[Column]:
        offer, candidate = (F.col("flags.route") == kind for kind in ("offer", "candidate"))
        tests = {"signals": F.lit(True), "implausible": F.col("flags.implausible"), "offer_observations": offer, "candidates": candidate}
        return [F.count_if(condition & test).alias(name) for name, test in tests.items()]

    parts = [
        alone.agg(
            F.count("*").alias("classified"), F.count_if("is_offer").alias("offers"), F.count_if("blocked").alias("blocked"),
            *kept(~F.col("blocked")),
        ),
        keys.agg(
            F.sum("rows").alias("classified"), F.sum("offers").alias("offers"),
            F.sum(F.when(none_free, F.col("blocked_rows"))).alias("blocked"), *kept(new),
        ),
        before,
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part, allowMissingColumns=True)
    names = ("classified", "offers", "blocked", "signals", "implausible", "offer_observations", "candidates")
    summed = total.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    dup = F.col("classified") - F.col("blocked") - F.col("signals")
    return summed.withColumn("dup", dup).select(
        "classified", "offers", "dup", "blocked", "signals", "implausible", "offer_observations", "candidates"
    )


def pipeline_counters(
    signals: DataFrame, lex: lx.Lexicon = lx.Lexicon(), stored: DataFrame | None = None, offers: DataFrame | None = None
) -> DataFrame:
    """The run's counters in one row.

    The labelled rows are reduced to their key columns and checkpointed, so the texts are labelled once.
    """
    normalized = normalize(signals)
    labelled = route(rule_classifier(keep_matched(normalized, lex), lex))
    routed = checkpointed(
        labelled.select(
            "source", "source_url", "row_key", "url", "ingest_seq", "place", "blocked", "implausible", "route", "service_key", "offer_type",
            F.struct(F.col("label.is_offer").alias("is_offer")).alias("label"),
            F.sha2(F.coalesce("raw_text", F.lit("")), 256).alias("raw_text"),  # stands for the text in keys
        )
    )
    rows = storable(routed, stored)
    keys = offer_keys(rows)
    new_keys = keys if offers is None else keys.join(offers.select(F.col("id").alias("offer_id")), "offer_id", "left_anti")
    parts = [
        signals.agg(F.count("*").alias("seen")),
        outcome_counts(routed, stored),
        new_keys.agg(
            F.count_if(F.col("route") == "offer").alias("offers_created"),
            F.count_if(F.col("route") == "model_release").alias("model_releases"),
        ),
        harvest_mentions(normalized, lex).agg(F.count("*").alias("harvested")),
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part, allowMissingColumns=True)
    merged = total.agg(*[F.max(c).alias(c) for c in total.columns])
    return merged.withColumns(
        {
            "prefiltered_out": F.col("seen") - F.col("classified"),
            "offers_updated": F.col("offer_observations") - F.col("offers_created"),
        }
    ).drop("offer_observations")


def offer_keys(rows: DataFrame) -> DataFrame:
    """Distinct offers the rows attach to."""
    return (
        rows.where(F.col("route").isin("offer", "model_release"))
        .select("route", row_offer_id().alias("offer_id"))
        .distinct()
    )


# ------------------------------------------------------------------ merges
def row_offer_id() -> Column:
    return F.when(F.col("route") == "offer", offer_id(F.col("service_key"), F.col("offer_type"))).when(
        F.col("route") == "model_release", offer_id(F.col("service_key"), F.col("offer_type"), F.col("url"))
    )


def signal_columns() -> list[Column]:
    """Columns of a stored signal, of a labelled row."""
    return [
        F.xxhash64(F.lit("signal"), "source", locator_key(), "ingest_seq", "place").alias("id"),
        row_offer_id().alias("offer_id"),
        F.when(F.col("service_key").isNotNull(), service_id(F.col("service_key"))).alias("service_id"),
        F.col("source"),
        F.col("source_url"),
        F.col("row_key"),
        F.col("url"),
        F.coalesce("raw_text", F.lit("")).alias("raw_text"),
        F.col("lang"),
        F.col("label").alias("classification"),
        F.col("label.confidence").alias("confidence"),
        F.col("observed_at"),
    ]


def stored_signals(rows: DataFrame) -> DataFrame:
    """Rows in the shape of the signals table (whole texts)."""
    return with_schema(rows.select(*signal_columns()), "signals")


def sanitized_name(name: Column) -> Column:
    """NULL for empty names, path-like names and names under three characters."""
    bad = F.contains(name, F.lit("/")) | (F.length(F.trim(name)) < 3)
    return F.when(~bad, name)


def merge_services(existing: DataFrame, rows: DataFrame, as_of: Column) -> DataFrame:
    """Services after the rows: known domains keep their row, a new domain takes type and models of its first."""
    release = F.col("route") == "model_release"
    seen = rows.where(F.col("service_key").isNotNull()).select(
        F.col("service_key").alias("canonical_domain"),
        arrival().alias("_at"),
        F.struct(
            F.when(release, F.substring(F.col("service_key"), 4, 1 << 20)).otherwise(F.col("service_key")).alias("name"),
            F.when(release, "model_release").otherwise(F.col("label.offer_type")).alias("type"),
            F.when(~release, truthy_array(F.col("label.models"))).alias("models"),
            F.when(release, "active").otherwise("new").alias("status"),
        ).alias("first"),
    )
    fresh = seen.groupBy("canonical_domain").agg(F.min_by("first", "_at").alias("first")).select(
        service_id(F.col("canonical_domain")).alias("id"),
        "canonical_domain",
        F.coalesce(sanitized_name(F.col("first.name")), F.col("first.name")).alias("name"),
        F.col("first.type").alias("type"),
        F.col("first.models").alias("models"),
        F.col("first.status").alias("status"),
        as_of.alias("first_seen"),
    )
    known = with_schema(existing, "services")
    added = fresh.join(known.select("canonical_domain"), "canonical_domain", "left_anti")
    return known.unionByName(new_rows(added, "services"))


def merge_aliases(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Hosts seen per service, one row each in order of ``first_seq``.

    Kept as rows rather than as an array on the service: a domain may own any number of hosts.
    """
    host = F.get("domains", F.lit(0))
    seen = rows.where(F.col("route").isin("offer", "candidate") & (host != F.col("service_key"))).select(
        service_id(F.col("service_key")).alias("service_id"),
        F.col("service_key").alias("canonical_domain"),
        host.alias("host"),
        F.col("ingest_seq").alias("first_seq"),
    )
    return (
        with_schema(existing, "service_aliases")
        .unionByName(seen)
        .groupBy("service_id", "canonical_domain", "host")
        .agg(F.min("first_seq").alias("first_seq"))
    )


def _first(column: str, usable: Column) -> Column:
    """Value of the earliest observation that has one."""
    return F.min_by(column, F.when(usable, F.col("_seq"))).alias(column)


def _observed_at_place(observed: bool) -> Column:
    """Order of observations, the stored offer first."""
    if observed:
        return F.struct(F.lit(True).alias("observed"), arrival().alias("at"))
    none = F.lit(None).cast("struct<ingest_seq:bigint,place:array<bigint>,source:string,tie:bigint>")
    return F.struct(F.lit(False).alias("observed"), none.alias("at"))


def merge_offers(existing: DataFrame, rows: DataFrame, as_of: Column) -> DataFrame:
    """Offers after the rows: one per (service, type), one per (service, url) for model releases.

    Each column takes the first usable value in arrival order, an existing offer counting as the earliest
    observation.  All columns come from one aggregation with partial results on the map side.
    """
    label = F.col("label")
    release = F.col("route") == "model_release"
    fields = ("claim_steps", "requirements", "currency", "amount", "models", "effort", "unit", "topic")
    observed = rows.where(F.col("route").isin("offer", "model_release")).select(
        row_offer_id().alias("id"),
        F.when(release, F.col("url")).alias("_release_url"),
        _observed_at_place(True).alias("_seq"),
        release.alias("_release"),
        F.struct(
            service_id(F.col("service_key")).alias("service_id"),
            F.col("service_key").alias("canonical_domain"),
            F.col("offer_type").alias("type"),
            F.when(release, F.lit(False)).otherwise(label["referral_required"]).alias("referral_required"),
            F.lit(None).cast(X.CONDITIONS_TYPE).alias("conditions"),
            F.lit(None).cast("string").alias("description"),
            F.lit("new").alias("status"),
            F.lit(0.0).alias("score"),
            F.lit(None).cast("timestamp").alias("notified_at"),
            as_of.cast("timestamp").alias("first_seen_at"),
            F.lit(None).cast("timestamp").alias("last_verified_at"),
        ).alias("_row"),
        F.col("url"),
        *[
            F.when(release, F.col("meta.model_id") if c == "claim_steps" else F.lit(None)).otherwise(label[c]).alias(c)
            for c in fields
        ],
    )
    known = with_schema(existing, "offers")
    row_fields = observed.schema["_row"].dataType.names
    old = known.select(
        "id",
        F.when(F.col("id") != offer_id(F.col("canonical_domain"), F.col("type")), F.col("url")).alias("_release_url"),
        _observed_at_place(False).alias("_seq"),
        F.lit(False).alias("_release"),
        F.struct(*row_fields).alias("_row"),
        "url",
        *fields,
    )
    merged = (
        old.unionByName(observed)
        .groupBy("id", "_row.canonical_domain", "_row.type", "_release_url")  # the id alone is a 64-bit hash
        .agg(
            F.min_by("_row", "_seq").alias("_row"),
            F.count_if(F.col("_seq.observed") & ~F.col("_release")).alias("_seen"),
            F.min("_seq").alias("_first_seq"),
            _first("amount", truthy_number(F.col("amount")).isNotNull()),
            _first("models", truthy_array(F.col("models")).isNotNull()),
            *[_first(c, truthy_text(F.col(c)).isNotNull()) for c in ("currency", "claim_steps", "requirements", "url")],
            *[_first(c, F.col(c).isNotNull()) for c in ("effort", "unit", "topic")],
        )
    )
    again = F.col("_seen") > F.when(F.col("_first_seq.observed"), 1).otherwise(0)
    out = merged.select(
        "id",
        *[F.col(f"_row.{c}").alias(c) for c in row_fields if c != "last_verified_at"],
        F.when(again, as_of.cast("timestamp")).otherwise(F.col("_row.last_verified_at")).alias("last_verified_at"),
        "amount", "models", "currency", "claim_steps", "requirements", "url", "effort", "unit", "topic",
    )
    return with_schema(out, "offers")


def merge_lead_metrics(existing: DataFrame, rows: DataFrame, aggregators=lx.AGGREGATOR_SOURCES) -> DataFrame:
    """Lead metrics after the rows; minima make late and repeated rows harmless."""
    is_agg = F.col("source").isin(*aggregators)
    seen = rows.where(F.col("route") == "offer").select(
        row_offer_id().alias("offer_id"),
        F.when(~is_agg, F.col("observed_at")).alias("first_seen_by_us"),
        F.when(is_agg, F.col("observed_at")).alias("first_seen_in_aggregator"),
    )
    both = with_schema(existing, "lead_metrics").drop("lead_hours").unionByName(seen)
    firsts = both.groupBy("offer_id").agg(
        F.min("first_seen_by_us").alias("first_seen_by_us"),
        F.min("first_seen_in_aggregator").alias("first_seen_in_aggregator"),
    )
    return firsts.withColumn("lead_hours", lead_hours(F.col("first_seen_by_us"), F.col("first_seen_in_aggregator")))


# ------------------------------------------------------------------ candidate harvest
def harvest_mentions(normalized: DataFrame, lex: lx.Lexicon = lx.Lexicon()) -> DataFrame:
    """One row per domain mention in text that has an offer context: domain, source, seq, pos, is_high."""
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    mentions = (
        normalized.where(text.rlike(lex.harvest_hint))
        .select(
            "source",
            "ingest_seq",
            "place",
            text.alias("_text"),
            F.posexplode(D.mentioned_domains(F.col("domains"), text)).alias("pos", "host"),
        )
        .withColumn("domain", D.registrable_of_canonical(F.col("host")))
        .where(F.col("domain").isNotNull() & ~F.coalesce(F.col("domain").isin(*lx.BLOCKED_DOMAINS), F.lit(False)))
    )
    return mentions.select(
        "domain", "source", "ingest_seq", "place", "pos", D.offer_word_near(F.col("_text"), F.col("host")).alias("is_high")
    )


def mention_array(lex: lx.Lexicon = lx.Lexicon()) -> Column:
    """The mentions of one normalised row as an array of (pos, domain, is_high); NULL without an offer context."""
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    each = F.transform(
        D.mentioned_domains(F.col("domains"), text),
        lambda host, pos: F.struct(pos.alias("pos"), D.registrable_of_canonical(host).alias("domain"), host.alias("host")),
    )
    open_ = F.filter(each, lambda m: m["domain"].isNotNull() & ~F.coalesce(m["domain"].isin(*lx.BLOCKED_DOMAINS), F.lit(False)))

    def told(low: Column) -> Column:
        high = lambda m: D.offer_word_near(text, m["host"], low=low)
        return F.transform(open_, lambda m: F.struct(m["pos"].alias("pos"), m["domain"].alias("domain"), high(m).alias("is_high")))

    return F.when(text.rlike(lex.harvest_hint), bind(F.lower(text), told))


def candidates_of(mentions: DataFrame) -> DataFrame:
    """Mentions reduced to one row per domain: first source in arrival order, high priority if ever high."""
    return (
        mentions.groupBy("domain")
        .agg(
            F.min_by("source", F.struct("ingest_seq", "place", "pos", "source")).alias("first_source"),
            F.max("is_high").alias("is_high"),
            F.count("*").alias("mentions"),
        )
        .withColumn("priority", F.when(F.col("is_high"), "high").otherwise("normal"))
        .drop("is_high")
    )


def harvest_candidates(normalized: DataFrame, lex: lx.Lexicon = lx.Lexicon()) -> DataFrame:
    """Candidate domains of normalised rows."""
    return candidates_of(harvest_mentions(normalized, lex))


# ------------------------------------------------------------------ one pass over the texts
def read_texts(normalized: DataFrame, lex: lx.Lexicon = lx.Lexicon()) -> DataFrame:
    """Adds what has to be read off the texts: ``matched`` (pre-filter), ``kept`` (matched, or forced) and ``mentions``."""
    rows = normalized.withColumns({"matched": _passes(lex, id(SparkContext._jvm)), "mentions": mention_array(lex)})
    return rows.withColumn("kept", meta_flag("force_classify") | F.col("matched"))


def read_once(signals: DataFrame, lex: lx.Lexicon, seen: Observation) -> DataFrame:
    """Normalised rows that a later step needs, with what has to be read off their texts: ``kept`` and ``matched`` (pre-filter),
    ``mentions``, ``blocked_host``, and the arrival ``at`` and locator ``_key`` that tell repeats apart.

    The text itself stays with kept rows only.  ``seen`` counts in passing: seen, classified, harvested.
    """
    rows = read_texts(normalize(signals), lex).observe(
        seen,
        F.count(F.lit(1)).alias("seen"),
        F.count_if("kept").alias("classified"),
        F.coalesce(F.sum(F.coalesce(F.size("mentions"), F.lit(0))), F.lit(0)).alias("harvested"),
    )
    return rows.where("kept OR size(mentions) > 0").withColumns({"at": arrival(), "_key": _locator(), "blocked_host": blocked_host()}).withColumn("raw_text", F.when(F.col("kept"), F.col("raw_text")))


def mentions_of(passed: DataFrame) -> DataFrame:
    return passed.where("size(mentions) > 0").select("source", "ingest_seq", "place", F.inline("mentions"))


def blocked_first(passed: DataFrame, rows: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Number of blocked rows that come before any stored row of their key; those after it are duplicates."""
    blocked = passed.where("kept AND blocked_host").select("source", "_key", "at")
    first = rows.select("source", _locator().alias("_key"), arrival().alias("_first")).where(F.col("_key").isNotNull())
    left = blocked.join(first, ["source", "_key"], "left").where(F.col("_first").isNull() | (F.col("at") < F.col("_first")))
    if stored is not None:
        left = left.join(stored_keys(stored), ["source", "_key"], "left_anti")
    return left.agg(F.count(F.lit(1)).alias("blocked"))


def counters_in_passing(
    passed: DataFrame, rows: DataFrame, observed: dict[str, int], stored: DataFrame | None, offers: DataFrame
) -> DataFrame:
    """The run's counters in one row: what was counted while rows were written, and two counts over key columns."""
    made = offer_keys(rows).join(offers.select(F.col("id").alias("offer_id")), "offer_id", "left_anti").agg(
        F.count_if(F.col("route") == "offer").alias("offers_created"),
        F.count_if(F.col("route") == "model_release").alias("model_releases"),
    )
    blocked = blocked_first(passed, rows, stored)
    parts = made.unionByName(blocked, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in (*made.columns, *blocked.columns)])
    known = parts.select("*", *[F.lit(v).cast("bigint").alias(k) for k, v in observed.items()])
    return known.withColumns(
        {
            "dup": F.col("classified") - F.col("blocked") - F.col("signals"),
            "prefiltered_out": F.col("seen") - F.col("classified"),
            "offers_updated": F.col("offer_observations") - F.col("offers_created"),
        }
    ).drop("offer_observations")


@dataclass(frozen=True)
class IngestResult:
    """Tables after one ingest run; each is a lazy DataFrame over the same routed rows."""

    signals: DataFrame
    services: DataFrame
    aliases: DataFrame
    offers: DataFrame
    lead_metrics: DataFrame


def ingest(routed: DataFrame, tables: dict[str, DataFrame], as_of: Column) -> IngestResult:
    """Merge routed rows into the tables.  ``routed`` has five consumers: pass a written or checkpointed frame
    (the batch driver does)."""
    rows = storable(routed, tables["signals"])
    return IngestResult(
        signals=stored_signals(rows),
        services=merge_services(tables["services"], rows, as_of),
        aliases=merge_aliases(tables["service_aliases"], rows),
        offers=merge_offers(tables["offers"], rows, as_of),
        lead_metrics=merge_lead_metrics(tables["lead_metrics"], rows),
    )
