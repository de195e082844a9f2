"""Language, pre-filter and the rule classifier as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlens import lexicon as lx
from leadlens.functions.words import bind, bind_unless, first_label, has_any, hits, literals, many, truthy_text

_NO_WORDS = "array<string>"
_CARD_STEMS = ("card", "cc", "payment", "карт", "卡")
CONDITIONS_TYPE = (
    "struct<requires_card:boolean,requires_phone:boolean,new_users_only:boolean,region:string,"
    "risk_flags:array<string>>"
)
LABEL_TYPE = (
    "struct<is_offer:boolean,service_name:string,offer_type:string,amount:double,currency:string,"
    "models:array<string>,claim_steps:string,requirements:string,referral_required:boolean,effort:string,"
    f"unit:string,topic:string,conditions:{CONDITIONS_TYPE},confidence:double>"
)


def detect_lang(text: Column) -> Column:
    """zh on any CJK character, ru when Cyrillic letters outnumber Latin ones, else en.

    Letters are only counted in texts that have a Cyrillic one.
    """
    cyrillic = F.regexp_count(text, F.lit("[Ѐ-ӿ]"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    return (
        F.when(truthy_text(text).isNull(), "en")
        .when(text.rlike("[一-鿿]"), "zh")
        .when(text.rlike("[Ѐ-ӿ]"), F.when(cyrillic > latin, "ru").otherwise("en"))
        .otherwise("en")
    )


def prefilter(text: Column, lex: lx.Lexicon = lx.Lexicon()) -> Column:
    """``struct(ok, hits)``: the first satisfied tier decides and names its words.

    Tiers: any strong Chinese word (only the first is named), two weak Chinese words, any Russian word, any
    strong English phrase, two weak English hits where a money pattern counts as one.
    """
    body = F.coalesce(text, F.lit(""))

    def decide(low: Column) -> Column:
        first = lambda words: F.slice(hits(low, words), 1, 1)
        money = F.when(body.rlike(lex.money_pattern), literals([lx.MONEY_TAG])).otherwise(literals([]))
        weak = F.concat(hits(low, lex.en_weak), money)
        at_least = lambda words, n: bind(words, lambda h: F.when(F.size(h) >= n, h))
        return F.coalesce(
            at_least(first(lex.zh_strong), 1),
            at_least(hits(low, lex.zh_weak), 2),
            at_least(hits(low, lex.ru), 1),
            at_least(hits(low, lex.en_strong), 1),
            at_least(weak, 2),
            literals([]),
        )

    long = many(lex.zh_strong, lex.zh_weak, lex.ru, lex.en_strong, lex.en_weak)
    return bind(bind_unless(long, F.lower(body), decide), lambda n: F.struct((F.size(n) > 0).alias("ok"), n.alias("hits")))


def passes_prefilter(text: Column, lex: lx.Lexicon = lx.Lexicon()) -> Column:
    """The decision of :func:`prefilter` alone: tests stop at the first satisfied tier and no word lists are built."""
    body, strong = F.coalesce(text, F.lit("")), (*lex.zh_strong, *lex.ru, *lex.en_strong)

    def decide(low: Column) -> Column:
        money = body.rlike(lex.money_pattern)
        return (
            has_any(low, strong)
            | (F.size(hits(low, lex.zh_weak)) >= 2)
            | bind(F.size(hits(low, lex.en_weak)), lambda n: (n >= 2) | ((n == 1) & money))
        )

    return bind_unless(many(strong, lex.zh_weak, lex.en_weak), F.lower(body), decide)


def _number(found: Column) -> Column:
    return F.replace(truthy_text(found), F.lit(","), F.lit(".")).try_cast("double")


def parse_amount(text: Column) -> Column:
    """``struct(amount, currency)``: first of the three amount forms, a comma read as a decimal point.

    The currency is USD for a dollar amount, or for another amount in a text with a dollar word.
    """
    dollar, worded, credit = (F.regexp_extract(text, p, 1) for p in lx.AMOUNT_PATTERNS)
    in_dollars = F.when(F.contains(text, F.lit("$")), _number(dollar))
    other = F.when(text.rlike(r"\d"), F.coalesce(_number(worded), _number(credit)))

    def pair(usd: Column) -> Column:
        by_word = bind(
            other,
            lambda a: F.struct(
                a.alias("amount"), F.when(a.isNotNull() & has_any(text, lx.USD_WORDS), "USD").alias("currency")
            ),
        )
        return F.when(usd.isNotNull(), F.struct(usd.alias("amount"), F.lit("USD").alias("currency"))).otherwise(by_word)

    return bind(in_dollars, pair)


def find_models(text: Column, words=lx.MODEL_KEYWORDS) -> Column:
    """Sorted model keywords contained in the text."""
    return hits(F.lower(text), sorted(words))


def guess_type(text: Column, low: Column, lang: Column) -> Column:
    """Offer type; ``low`` is the lower-case text."""
    return (
        F.when((lang == "zh") | has_any(text, lx.RELAY_WORDS), "relay")
        .when(has_any(low, lx.RELEASE_WORDS), "model_release")
        .when(has_any(low, lx.STAR_WORDS) & has_any(low, lx.REPO_WORDS), "grant")
        .otherwise("saas_trial")
    )


def guess_topic(low: Column, offer_type: Column) -> Column:
    promo = offer_type.isin(*lx.FREEBIE_TYPES) | has_any(low, lx.FREEBIE_WORDS)
    return F.when(promo, "freebie").otherwise("ai_service")


def is_referral(text: Column, url: Column) -> Column:
    in_url = F.coalesce(url.rlike(lx.REFERRAL_PATTERN), F.lit(False))
    return text.rlike(lx.REFERRAL_PATTERN) | in_url


def detect_effort(low: Column, referral: Column) -> Column:
    return (
        F.when(has_any(low, lx.HARD_WORDS), "hard")
        .when(referral | has_any(low, lx.MEDIUM_WORDS), "medium")
        .otherwise("easy")
    )


def detect_unit(low: Column, amount: Column, currency: Column) -> Column:
    out = F.when(F.coalesce(amount, F.lit(0.0)) == 0, F.lit(None)).when(currency == "USD", "usd")
    for unit, pattern in lx.UNIT_PATTERNS:
        out = out.when(low.rlike(pattern), unit)
    return out.when(truthy_text(currency).isNotNull(), "usd").otherwise("credits")


def detect_conditions(low: Column, url: Column, referral: Column) -> Column:
    """Three-state flags (NULL = not stated), region tag and risk flags in vocabulary order."""
    blob = F.concat(low, F.when(truthy_text(url).isNotNull(), F.concat(F.lit(" "), F.lower(url))).otherwise(""))
    # every form of the pattern has one of these words; the regex only runs on texts with one
    cardless = has_any(blob, _CARD_STEMS) & blob.rlike(lx.NO_CARD_PATTERN)
    card = F.when(cardless, F.lit(False)).when(has_any(low, lx.CARD_WORDS), F.lit(True))
    risks = [F.when(has_any(low, words), F.lit(flag)) for flag, words in lx.RISK_RULES]
    risks.append(F.when(referral | has_any(blob, lx.REFERRAL_RISK_WORDS), F.lit("referral")))
    return F.struct(
        card.alias("requires_card"),
        F.when(has_any(low, lx.PHONE_WORDS), F.lit(True)).alias("requires_phone"),
        F.when(has_any(low, lx.NEW_USER_WORDS), F.lit(True)).alias("new_users_only"),
        first_label(low, lx.REGION_RULES).alias("region"),
        F.array_compact(F.array(*risks)).alias("risk_flags"),
    )


def not_offer() -> Column:
    """Label of a text that is not about an offer."""
    none = F.struct(
        F.lit(False).alias("requires_card"),
        F.lit(False).alias("requires_phone"),
        F.lit(False).alias("new_users_only"),
        F.lit(None).cast("string").alias("region"),
        F.array().cast(_NO_WORDS).alias("risk_flags"),
    )
    text = F.lit(None).cast("string")
    return F.struct(
        F.lit(False).alias("is_offer"),
        text.alias("service_name"),
        F.lit("other").alias("offer_type"),
        F.lit(None).cast("double").alias("amount"),
        text.alias("currency"),
        F.array().cast(_NO_WORDS).alias("models"),
        text.alias("claim_steps"),
        text.alias("requirements"),
        F.lit(False).alias("referral_required"),
        text.alias("effort"),
        text.alias("unit"),
        text.alias("topic"),
        none.alias("conditions"),
        F.lit(0.0).alias("confidence"),
    ).cast(LABEL_TYPE)


def is_plausible(label: Column) -> Column:
    """False only for a USD amount above the ceiling of its offer type."""
    ceiling = F.lit(None).cast("double")
    for offer_type, limit in lx.MAX_PLAUSIBLE_USD.items():
        ceiling = F.when(label["offer_type"] == offer_type, F.lit(limit)).otherwise(ceiling)
    usd = F.coalesce(label["currency"] == "USD", F.lit(False)) | F.coalesce(label["unit"] == "usd", F.lit(False))
    too_big = label["is_offer"] & usd & (label["amount"] > ceiling)
    return ~F.coalesce(too_big, F.lit(False))
