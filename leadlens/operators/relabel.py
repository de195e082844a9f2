"""Relabelling of stored offers with external labels (a table of model output) and the rule fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens import lexicon as lx
from leadlens.functions import text as X
from leadlens.functions.words import literals, truthy_array, truthy_text
from leadlens.operators.feed import richest_signal
from leadlens.operators.ingest import Classifier, rule_classifier
from leadlens.schemas import with_schema


def coerce_conditions(raw: Column) -> Column:
    """Strict conditions: absent flags are false, blank regions NULL, unknown risk flags dropped."""
    flag = lambda name: F.coalesce(raw[name], F.lit(False)).alias(name)
    risks = F.filter(F.coalesce(raw["risk_flags"], literals([])), lambda r: r.isin(*lx.RISK_FLAGS))
    return F.struct(
        flag("requires_card"),
        flag("requires_phone"),
        flag("new_users_only"),
        F.when(F.btrim(raw["region"]) != "", raw["region"]).alias("region"),
        risks.alias("risk_flags"),
    )


def coerce_label(raw: Column) -> Column:
    """Bring an external label to the label type; values outside a vocabulary become ``other`` or NULL."""
    known = lambda name, words: F.when(raw[name].isin(*words), raw[name])
    return F.struct(
        F.coalesce(raw["is_offer"], F.lit(False)).alias("is_offer"),
        raw["service_name"].alias("service_name"),
        F.coalesce(known("offer_type", lx.OFFER_TYPES), F.lit("other")).alias("offer_type"),
        raw["amount"].alias("amount"),
        raw["currency"].alias("currency"),
        F.coalesce(raw["models"], literals([])).alias("models"),
        raw["claim_steps"].alias("claim_steps"),
        raw["requirements"].alias("requirements"),
        F.coalesce(raw["referral_required"], F.lit(False)).alias("referral_required"),
        known("effort", lx.EFFORTS).alias("effort"),
        known("unit", lx.UNITS).alias("unit"),
        known("topic", lx.TOPICS).alias("topic"),
        coerce_conditions(raw["conditions"]).alias("conditions"),
        F.coalesce(raw["confidence"], F.lit(0.0)).alias("confidence"),
    ).cast(X.LABEL_TYPE)


def relabel_inputs(offers: DataFrame, services: DataFrame, signals: DataFrame) -> DataFrame:
    """One classifier input per offer whose service has text: the longest text of the service."""
    text = richest_signal(signals)
    domain = services.select(F.col("id").alias("service_id"), F.col("canonical_domain").alias("_domain"))
    return (
        offers.select("id", "service_id")
        .join(domain, "service_id")
        .join(text, "service_id")
        .select(
            "id",
            "raw_text",
            F.concat(F.lit("https://"), F.col("_domain")).alias("url"),
            X.detect_lang(F.col("raw_text")).alias("lang"),
            F.array("_domain").alias("domains"),
        )
    )


def labels_or_fallback(
    inputs: DataFrame, external: DataFrame | None, lex: lx.Lexicon = lx.Lexicon(), classifier: Classifier | None = None
) -> DataFrame:
    """``(id, label)`` per input: not an offer when the pre-filter rejects it, else the external label of its id
    (column ``raw``), else the rule classifier."""
    pre = inputs.withColumn("matched", X.passes_prefilter(F.col("raw_text"), lex))
    ruled = (classifier or (lambda df: rule_classifier(df, lex)))(pre)
    if external is None:
        return ruled.select("id", "label")
    joined = ruled.join(external.select("id", "raw"), "id", "left")
    use = F.col("matched") & F.col("raw").isNotNull()
    return joined.select("id", F.when(use, coerce_label(F.col("raw"))).otherwise(F.col("label")).alias("label"))


def apply_labels(offers: DataFrame, labels: DataFrame) -> DataFrame:
    """Overwrite an offer's columns with the stated values of its new label.

    Labels that are not offers change nothing.  Amounts above 5000 are dropped; ``referral_required`` and
    ``conditions`` always follow the label.  Scores are to be recomputed afterwards.
    """
    offered = labels.where("label.is_offer").select("id", F.col("label").alias("_l"))
    lab = F.col("_l")
    amount = F.when(lab["amount"] <= lx.RELABEL_AMOUNT_CAP, lab["amount"])
    new = {
        "amount": amount,
        "currency": truthy_text(lab["currency"]),
        "unit": truthy_text(lab["unit"]),
        "effort": truthy_text(lab["effort"]),
        "topic": truthy_text(lab["topic"]),
        "type": truthy_text(lab["offer_type"]),
        "claim_steps": truthy_text(lab["claim_steps"]),
        "requirements": truthy_text(lab["requirements"]),
        "models": truthy_array(lab["models"]),
        "conditions": lab["conditions"],
        "referral_required": lab["referral_required"],
    }
    out = with_schema(offers, "offers").join(offered, "id", "left")
    out = out.withColumns({name: F.coalesce(value, F.col(name)) for name, value in new.items()})
    return with_schema(out, "offers")
