"""Scalar fixtures: one value in, one value out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadlens import lexicon as lx
from leadlens.functions import display as DI
from leadlens.functions import domains as D
from leadlens.functions import html as H
from leadlens.functions import pagefacts as P
from leadlens.functions import score as S
from leadlens.functions import text as X

x = "x"


@pytest.mark.parametrize("text, lang", [("free credits register", "en"), ("дает бесплатные кредиты", "ru"), ("注册送 额度 免费", "zh"), ("", "en"), (None, "en")])
def test_language(one, text, lang):
    assert one(X.detect_lang(F.col(x)), text) == lang


@pytest.mark.parametrize(
    "url, host",
    [("https://www.Nanonets.com/pricing", "nanonets.com"), ("freemodel.dev", "freemodel.dev"), (None, None), ("", None), ("http://h.io:8080/x", "h.io")],
)
def test_canonical_domain(one, url, host):
    assert one(D.canonical_domain(F.col(x)), url) == host


@pytest.mark.parametrize("host, reg", [("app.base44.com", "base44.com"), ("rappi.com.co", "rappi.com.co"), ("kiro.dev", "kiro.dev"), ("a.b.co.uk", "b.co.uk"), ("localhost", "localhost")])
def test_registrable_domain(one, host, reg):
    assert one(D.registrable_domain(F.col(x)), host) == reg


def test_service_domains_skip_platforms(one):
    text = "see https://freemodel.dev and https://t.me/foo or https://github.com/a/b"
    assert one(D.service_domains(F.lit(None).cast("string"), F.col(x)), text) == ["freemodel.dev"]


@pytest.mark.parametrize(
    "text, ok",
    [
        ("Get $200 free credits, sign up", True), ("注册送 额度 公益站", True), ("дают триальный баланс при регистрации", True),
        ("just a normal sentence about cats", False), ("now $25/mo", True), ("please register", False), (None, False),
    ],
)
def test_prefilter(one, text, ok):
    assert one(X.prefilter(F.col(x)), text)["ok"] is ok
    assert one(X.passes_prefilter(F.col(x)), text) is ok


def test_prefilter_names_only_first_strong_chinese_word(one):
    assert one(X.prefilter(F.col(x)), "公益站 注册送")["hits"] == ["注册送"]


@pytest.mark.parametrize(
    "text, amount, currency",
    [("$1,000 free credits", 1.0, "USD"), ("送 50刀", 50.0, "USD"), ("100 credits", 100.0, None), ("10 кредитов", 10.0, None), ("no number", None, None), ("1.5 $ 7", 7.0, "USD")],
)
def test_amount(one, text, amount, currency):
    got = one(X.parse_amount(F.col(x)), text)
    assert (got["amount"], got["currency"]) == (amount, currency)


@pytest.mark.parametrize("name, blocked", [("reddit.com", True), ("www.reddit.com", True), ("old.reddit.com", True), ("https://reddit.com/r/x/1", True), ("ebay.com", True), ("verdent.ai", False), ("amazon.com", False), (None, False)])
def test_blocked(one, name, blocked):
    assert one(D.is_blocked(F.col(x)), name) is blocked


@pytest.mark.parametrize(
    "offer_type, amount, currency, unit, ok",
    [("saas_trial", 2500.0, "USD", "usd", False), ("relay", 5000.0, "USD", None, False), ("saas_trial", 200.0, "USD", None, True),
     ("saas_trial", None, "USD", None, True), ("grant", 100000.0, "USD", None, True), ("saas_trial", 50000.0, None, "credits", True)],
)
def test_plausible(spark, offer_type, amount, currency, unit, ok):
    row = spark.createDataFrame([(True, offer_type, amount, currency, unit)], "is_offer boolean, offer_type string, amount double, currency string, unit string")
    assert row.select(X.is_plausible(F.struct("*")).alias("v")).first()["v"] is ok


def test_page_models(one):
    found = one(P.detect_models(F.col(x)), "Access Claude Opus, GPT-4, and Gemini via one API.")
    assert found == ["claude", "opus", "gpt", "gemini"]
    assert one(P.detect_models(F.col(x)), "egypt photo1x") == []


@pytest.mark.parametrize(
    "text, amount",
    [("We saved customers $80,170 last year.", None), ("Get $200 in free credits when you sign up.", 200.0), ("注册送 100 额度", 100.0),
     ("free credits worth $999999", None), ("a free $2500 bonus", 250.0), (None, None)],
)
def test_page_amount(one, text, amount):
    assert one(P.detect_amount(F.col(x)), text) == amount


@pytest.mark.parametrize("html, engine", [("<title>New API</title>", "new-api"), ("Powered by Sub2API footer", "sub2api"), ("<title>One API</title>", "one-api"), ("in one API call", None)])
def test_engine(one, html, engine):
    assert one(P.detect_engine(F.col(x)), html) == engine


def test_description_prefers_meta(one):
    page = '<html><head><meta name="description" content="FooAI is an agentic coding suite &amp; more"></head><body>text</body></html>'
    assert one(H.description(F.col(x)), page) == "FooAI is an agentic coding suite & more"


def test_visible_text_drops_scripts(one):
    page = "<p>a&nbsp;<b>b</b></p><script>var x='<p>';</script><style>p{}</style>c &lt;3"
    assert one(H.visible_text(F.col(x)), page) == "a b c <3"


def test_reliability(spark):
    df = spark.createDataFrame([(False, False, False, None), (True, True, True, 30.0)], "a boolean, p boolean, e boolean, d double")
    got = [r["v"] for r in df.select(S.reliability(F.col("a"), F.col("p"), F.col("e"), F.col("d")).alias("v")).collect()]
    assert got == [0.0, 1.0]


@pytest.mark.parametrize("hours, fresh, decay", [(0.0, 1.0, 1.0), (24.0, 0.5, None), (60.0, None, 0.5), (120.0, None, 0.25), (-3.0, 1.0, 1.0)])
def test_freshness_and_decay(one, hours, fresh, decay):
    if fresh is not None:
        assert one(S.freshness(F.col(x)), hours, "double") == pytest.approx(fresh)
    if decay is not None:
        assert one(S.recency_decay(F.col(x)), hours, "double") == pytest.approx(decay)


@pytest.mark.parametrize("amount, score", [(400.0, 1.0), (100.0, 0.5), (None, 0.0), (-1.0, 0.0)])
def test_amount_score(one, amount, score):
    assert one(S.amount_score(F.col(x)), amount, "double") == score


def test_lead_hours_sign(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 4, 30, 12), dt.datetime(2026, 5, 13, 12)), (None, dt.datetime(2026, 5, 13))], "us timestamp, agg timestamp")
    rows = df.select(S.lead_hours(F.col("us"), F.col("agg")).alias("v"), S.lead_hours(F.col("agg"), F.col("us")).alias("w")).collect()
    assert [r["v"] for r in rows] == [312.0, None]
    assert rows[0]["w"] == -312.0


@pytest.mark.parametrize("host, hit", [("swiftrouter.com", True), ("api-cc.freemodel.dev", True), ("*.newapi.example.com", True), ("example.com", False), ("googleapis.com", False)])
def test_certificate_keyword(one, host, hit):
    assert one(D.ct_keyword_match(F.col(x)), host) is hit


@pytest.mark.parametrize("host, ok", [("a.ai", True), ("localhost", False), ("printer.lan", False), ("10.0.0.1", False), ("nodot", False), (None, False)])
def test_safe_to_probe(one, host, ok):
    assert one(D.safe_to_probe(F.col(x)), host) is ok


@pytest.mark.parametrize(
    "text, found",
    [("btw zenmux.ai has", ["zenmux.ai"]), ("mail user@api.example.ai now", ["example.ai"]), ("v2.io or go.ai", []), ("use node.js", []), ("GetMerlin.in!", ["getmerlin.in"])],
)
def test_bare_domains(one, text, found):
    assert one(D.bare_domains(F.col(x)), text) == found


def test_offer_word_near_domain(one):
    near = D.offer_word_near(F.col(x), F.lit("zenmux.ai"))
    assert one(near, "btw ZENMUX.ai has a free plan") is True
    assert one(near, "zenmux.ai " + "x" * 120 + " free") is False
    assert one(near, "nothing here is free") is False


def test_conditions_three_states(one):
    cond = X.detect_conditions(F.lower(F.col(x)), F.lit(None).cast("string"), F.lit(False))
    none = one(cond, "plain text")
    assert (none["requires_card"], none["requires_phone"], none["new_users_only"]) == (None, None, None)
    free = one(cond, "no credit card, new users, sms, eu only, refund")
    assert (free["requires_card"], free["requires_phone"], free["new_users_only"], free["region"]) == (False, True, True, "EU-only")
    assert free["risk_flags"] == ["chargeback"]
    # the word "card" still makes the effort hard
    assert one(X.detect_effort(F.lower(F.col(x)), F.lit(False)), "no credit card") == "hard"


@pytest.mark.parametrize("url, label", [("https://t.me/chan/5", "@chan"), ("https://t.me/+abc", "Telegram"), ("https://x.y", None), (None, None)])
def test_channel_label(one, url, label):
    assert one(DI.channel_label(F.col(x)), url) == label


def test_display(one):
    assert one(DI.hours_label(F.col(x)), -1.75, "double") == "1h 45m"
    assert one(DI.lead_label(F.col(x)), 50.0, "double") == "+2d ahead"
    assert one(DI.lead_label(F.col(x)), -1.0, "double") is None
    assert one(DI.value_label(F.col(x), F.lit("credits"), F.lit(None).cast("string")), 12000.0, "double") == "12,000cr"
    assert one(DI.amount_label(F.col(x), F.lit("EUR")), 9.6, "double") == "EUR 10"
    assert one(DI.claim_steps(F.col(x)), "1. open site\n2) sign up ● take key • ok") == ["open site", "sign up", "take key"]


def test_settings_overlay_words():
    lex = lx.Lexicon.from_settings({"prefilter_ru": ["слово"], "unknown": 1})
    assert lex.ru == ("слово",) and lex.en_strong == lx.EN_STRONG
