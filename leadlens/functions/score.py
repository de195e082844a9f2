"""Score arithmetic as Column expressions.  Rounding is half-up, at the same steps the ranking is defined with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlens import lexicon as lx


def hours_between(later: Column, earlier: Column) -> Column:
    """Fractional hours from ``earlier`` to ``later`` (microsecond exact)."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(3.6e9)


def round_steady(value: Column, digits: int) -> Column:
    """Half-up rounding of the value taken to 12 decimals, so that last-bit noise of sums and ``pow`` cannot flip a digit."""
    return F.round(value.cast("decimal(22,12)"), digits).cast("double")


def freshness(age_hours: Column) -> Column:
    return F.when(age_hours <= 0, 1.0).otherwise(1.0 / (1.0 + age_hours / 24.0))


def recency_decay(age_hours: Column, half_life: float = lx.HALF_LIFE_HOURS) -> Column:
    return F.when(age_hours <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age_hours / half_life))


def amount_score(amount: Column, cap: float = lx.AMOUNT_CAP) -> Column:
    return F.when(F.coalesce(amount, F.lit(0.0)) <= 0, 0.0).otherwise(F.least(amount / cap, F.lit(1.0)))


def ease_score(offer_type: Column, referral: Column) -> Column:
    base = F.lit(lx.EASE_DEFAULT)
    for name, value in lx.EASE_BY_TYPE.items():
        base = F.when(offer_type == name, value).otherwise(base)
    return base * F.when(referral, lx.REFERRAL_EASE_FACTOR).otherwise(1.0)


def quality(amount: Column, offer_type: Column, referral: Column, reliability: Column, w: lx.ScoreWeights) -> Column:
    """Weighted mean of amount, ease and reliability."""
    total = (w.amount + w.ease + w.reliability) or 1.0
    blend = (
        w.amount * amount_score(amount, w.amount_cap)
        + w.ease * ease_score(offer_type, referral)
        + w.reliability * F.coalesce(reliability, F.lit(0.0))
    )
    return blend / total


def compose(age_hours: Column, quality_value: Column, half_life: float = lx.HALF_LIFE_HOURS) -> Column:
    band = lx.QUALITY_FLOOR + (1.0 - lx.QUALITY_FLOOR) * quality_value
    return round_steady(recency_decay(age_hours, half_life) * band, 4)


def source_factor(source_count: Column) -> Column:
    n = F.coalesce(F.when(source_count != 0, source_count), F.lit(1))
    return 1.0 + lx.CROSS_SOURCE_STEP * F.least(F.greatest(n - 1, F.lit(0)), F.lit(lx.CROSS_SOURCE_MAX))


def with_boosts(base: Column, source_count: Column, early: Column, early_boost: float) -> Column:
    """Cross-source factor, then the early-language bonus; both rounded and capped at 1."""
    boosted = F.least(round_steady(base * source_factor(source_count), 4), F.lit(1.0))
    return F.when(early, F.least(round_steady(boosted + early_boost, 4), F.lit(1.0))).otherwise(boosted)


def signal_lang(source: Column, lang: Column, source_lang: dict[str, str]) -> Column:
    """zh, ru or en: the explicit code wins, else the language of the source, else NULL."""
    code = F.substring(F.lower(F.trim(lang)), 1, 2)
    out = F.lit(None).cast("string")
    name = F.lower(F.trim(source))
    for value in sorted(set(source_lang.values())):
        names = [s for s, code_ in source_lang.items() if code_ == value]
        out = F.when(name.isin(*names), value).otherwise(out)
    return F.when(code.isin("zh", "ru", "en"), code).otherwise(out)


def reliability(alive: Column, has_pricing: Column, engine_known: Column, age_days: Column) -> Column:
    """Trust in a service: alive, priced, known engine, and domain age up to 30 days."""
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    age = F.when(age_days.isNotNull(), F.least(age_days / 30.0, F.lit(1.0)) * 0.2).otherwise(0.0)
    total = flag(alive, 0.5) + flag(has_pricing, 0.2) + flag(engine_known, 0.1) + age
    return round_steady(F.least(total, F.lit(1.0)), 3)


def lead_hours(first_us: Column, first_aggregator: Column) -> Column:
    """Hours the aggregators came after us; positive means we were earlier, NULL when a side is missing."""
    return round_steady(hours_between(first_aggregator, first_us), 2)


def domain_age_lead(domain_first_seen: Column, first_seen_at: Column) -> Column:
    """Hours between the first certificate of a domain and its offer; NULL unless positive."""
    lead = hours_between(first_seen_at, domain_first_seen)
    return F.when(lead > 0, lead)
