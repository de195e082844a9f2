"""Notification outbox: which offers to announce, where, and with what text.  Delivery is not done here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens import lexicon as lx
from leadlens.functions.display import channel_raw
from leadlens.functions.words import has_any, truthy_array, truthy_number, truthy_text
from leadlens.schemas import with_schema
from leadlens.session import checkpointed

# Message pieces.
_HEAD, _MONEY, _MODELS, _REFERRAL = "\U0001F7E2 ", "\U0001F4B0 ", "\U0001F916 ", "⚠ referral required"
_FROM_CHANNEL, _FROM_OTHER, _CHANNEL = "\U0001F4E1 из @", "\U0001F4E1 из другого канала", "канал"
_DOT = " · "


def offer_card() -> Column:
    """Message for one joined offer row."""
    amount = F.when(
        truthy_number(F.col("amount")).isNotNull(),
        F.concat(F.coalesce(truthy_text(F.col("currency")), F.lit("$")), F.col("amount").cast("bigint").cast("string")),
    ).otherwise("?")
    effort = F.when(truthy_text(F.col("effort")).isNotNull(), F.concat(F.lit(_DOT), F.col("effort"))).otherwise("")
    money = F.concat(
        F.lit(_MONEY), amount, F.lit(_DOT), F.col("type"), effort, F.lit(_DOT + "score "),
        F.format_string("%.2f", F.coalesce("score", F.lit(0.0))),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit(_HEAD), F.coalesce("canonical_domain", truthy_text(F.col("url")), F.lit("offer"))),
        money,
        F.concat(F.lit(_MODELS), F.array_join(truthy_array(F.col("models")), ", ")),
        F.when(F.col("referral_required"), _REFERRAL),
        F.substring(truthy_text(F.col("claim_steps")), 1, 300),
        truthy_text(F.col("url")),
    )


def forwarded_card() -> Column:
    """Repost of a channel message: attribution, up to 3500 characters, link."""
    head = F.when(truthy_text(F.col("channel")).isNotNull(), F.concat(F.lit(_FROM_CHANNEL), F.col("channel"))).otherwise(
        _FROM_OTHER
    )
    body = F.coalesce(
        truthy_text(F.col("best_text")), truthy_text(F.col("description")), truthy_text(F.col("claim_steps")), F.lit("")
    )
    link = truthy_text(F.col("first_link"))
    text = F.substring(F.btrim(body, F.lit(" \t\r\n")), 1, 3500)
    return F.concat_ws("\n", head, F.lit(""), text, F.when(link.isNotNull(), F.concat(F.lit("\n"), link)))


def topic_route(from_channel: Column) -> Column:
    """Topic: forwarded first, then the label's topic, then word rules over the offer's texts."""
    blob = F.lower(
        F.concat_ws(
            " ",
            *[truthy_text(F.col(c)) for c in ("canonical_domain", "description", "claim_steps", "requirements")],
            F.array_join(truthy_array(F.col("models")), " "),
        )
    )
    label = F.trim(F.coalesce("topic", F.lit("")))
    promo = F.col("type").isin(*lx.FREEBIE_TYPES) | has_any(blob, lx.FREEBIE_WORDS)
    return (
        F.when(from_channel, lx.TOPIC_FORWARDED)
        .when(label == "ai_service", lx.TOPIC_AI)
        .when(label == "freebie", lx.TOPIC_FREEBIE)
        .when(promo, lx.TOPIC_FREEBIE)
        .otherwise(lx.TOPIC_AI)
    )


def signal_facts(signals: DataFrame) -> DataFrame:
    """What a notification needs from an offer's signals, as aggregates: channel, best text, first link, confidence."""
    channel_row = F.startswith(F.coalesce("source", F.lit("")), F.lit("telegram"))
    has_link = truthy_text(F.col("source_url")).isNotNull()
    length = F.when(truthy_text(F.col("raw_text")).isNotNull(), F.length("raw_text"))
    first_channel = F.coalesce(channel_raw(F.col("source_url")), F.lit(_CHANNEL))
    return (
        signals.withColumns({"_channel": first_channel, "_len": length})
        .groupBy("offer_id")
        .agg(
            F.min_by("_channel", F.when(channel_row, F.col("signal_id"))).alias("channel"),
            F.min_by("source_url", F.when(has_link, F.col("signal_id"))).alias("first_link"),
            F.max_by(
                "raw_text",
                F.when(F.col("_len").isNotNull(), F.struct(F.col("_len"), (-F.col("signal_id")).alias("s"))),
            ).alias("best_text"),
            F.coalesce(F.max("confidence"), F.lit(0.0)).alias("confidence"),
        )
    )


def _unsent(offers: DataFrame, services: DataFrame) -> DataFrame:
    domain = services.select(F.col("id").alias("service_id"), "canonical_domain")
    return offers.drop("canonical_domain").where(F.col("notified_at").isNull()).join(domain, "service_id")


def single_batch(offers: DataFrame, services: DataFrame, limit: int = 20, min_score: float = lx.NOTIFY_MIN_SCORE) -> DataFrame:
    """Outbox of the single-chat mode: best unsent offers above the score threshold."""
    rows = _unsent(offers.where(F.col("score") >= min_score), services)
    picked = rows.orderBy(F.desc("score"), "id").limit(limit)
    return picked.select(F.col("id").alias("offer_id"), F.lit(None).cast("string").alias("topic"), offer_card().alias("text"))


def group_batch(
    offers: DataFrame,
    services: DataFrame,
    signals: DataFrame,
    limit: int = 20,
    min_score: float = lx.NOTIFY_MIN_SCORE,
    min_confidence: float = lx.NOTIFY_MIN_CONFIDENCE,
) -> DataFrame:
    """Outbox of the group mode: a window of the best unsent offers, gated, then the first ``limit``.

    Offers seen in a channel pass the gate; others need score and confidence.
    """
    window = checkpointed(_unsent(offers, services).orderBy(F.desc("score"), "id").limit(max(limit * 5, 25)))
    mine = signals.join(window.select(F.col("id").alias("offer_id")), "offer_id", "left_semi")
    facts = signal_facts(mine).withColumnRenamed("offer_id", "id")
    rows = window.join(facts, "id", "left")
    from_channel = F.col("channel").isNotNull()
    good = (F.col("score") >= min_score) & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    picked = rows.where(from_channel | good).orderBy(F.desc("score"), "id").limit(limit)
    text = F.when(from_channel, forwarded_card()).otherwise(offer_card())
    return picked.select(F.col("id").alias("offer_id"), topic_route(from_channel).alias("topic"), text.alias("text"))


def mark_notified(offers: DataFrame, outbox: DataFrame, as_of: Column) -> DataFrame:
    sent = outbox.select(F.col("offer_id").alias("id"), F.lit(True).alias("_sent"))
    out = offers.join(sent, "id", "left").withColumn(
        "notified_at", F.when(F.col("_sent"), as_of.cast("timestamp")).otherwise(F.col("notified_at"))
    )
    return with_schema(out, "offers")
