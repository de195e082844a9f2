"""Feed queries, service detail, staleness and notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import kit as K
from checks import views as V
from leadlens import lexicon as lx
from leadlens.functions import display as DI
from leadlens.functions import score as S
from leadlens.operators import enrich, feed as FD, notify, votes



def _as_of():
    return V.instant(V.ORDERS_AS_OF)


_SHOWN = (
    "id", "service_id", "domain", "name", "type", "amount", "currency", "claim_steps", "referral_required", "effort",
    "unit", "url", "score", "status", "reliability", "engine", "source", "source_url",
)


def _run(spark, sf, request, shown=_SHOWN, **more):
    out = FD.feed(V.offers(spark, sf), V.services(spark, sf), V.order_signals(spark, sf), request, _as_of(), **more)
    return out.select(*shown, F.array_join("models", ",").alias("models"))


def feed_default(spark, sf):
    return _run(spark, sf, FD.FeedFilter())


def feed_new(spark, sf):
    return _run(spark, sf, FD.FeedFilter(sort="new", limit=50, offset=20, type="relay"))


def feed_amount(spark, sf):
    return _run(spark, sf, FD.FeedFilter(sort="amount", min_amount=1000.0, effort="easy", status="active"))


def feed_search(spark, sf):
    return _run(spark, sf, FD.FeedFilter(q="SHOP 1", limit=None))


def feed_model(spark, sf):
    return _run(spark, sf, FD.FeedFilter(model="gpt", limit=200))


def feed_recent(spark, sf):
    return _run(spark, sf, FD.FeedFilter(since_hours=24.0 * 200, limit=None))


def _all_votes(spark, sf):
    return votes.current_votes(V.vote_events(spark, sf))


def feed_edge(spark, sf):
    request = FD.FeedFilter(variant="edge", limit=300, model="claude", since_hours=99999.0, sort="new")
    return _run(spark, sf, request, (*_SHOWN, "likes", "dislikes"), votes=_all_votes(spark, sf))


def offers_with_votes(spark, sf):
    """Edge feed without paging: every offer with its votes."""
    request = FD.FeedFilter(variant="edge", limit=None)
    out = FD.feed(
        V.offers(spark, sf), V.services(spark, sf), V.order_signals(spark, sf), request, _as_of(), _all_votes(spark, sf)
    )
    return out.select("id", "name", "likes", "dislikes", "source")


def best_offer_per_domain(spark, sf):
    items = FD.public_offer(FD.joined_offers(V.offers(spark, sf), V.services(spark, sf), "left"))
    return FD.best_per_domain(items).select("id", "domain", "score")


def feed_view(spark, sf):
    items = FD.feed(V.offers(spark, sf), V.services(spark, sf), V.order_signals(spark, sf), FD.FeedFilter(limit=None), _as_of())
    view = FD.ViewFilter(tab="easy", live_only=True, source_category="forums", no_referral=True, sort="amount")
    return FD.feed_view(items, view).select("id", "domain", "type", "amount", "source", "score")


def feed_view_saved(spark, sf):
    items = FD.feed(V.offers(spark, sf), V.services(spark, sf), V.order_signals(spark, sf), FD.FeedFilter(limit=None), _as_of())
    saved = V.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()
    return FD.feed_view(items, FD.ViewFilter(tab="saved", engine="new-api"), saved).select("id", "engine", "score")


def service_latest_signals(spark, sf):
    rows = FD.latest_signals(V.order_signals(spark, sf))
    return FD.public_signal(rows).select("service_id", "signal_id", "source", "channel", "raw_text")


def service_offers(spark, sf):
    return FD.service_offers(V.offers(spark, sf), V.services(spark, sf)).select("id", "domain", "name", "status", "score")


def signal_provenance(spark, sf):
    return FD.provenance(V.order_signals(spark, sf)).select("service_id", "signal_id", "source")


def richest_signal(spark, sf):
    return FD.richest_signal(V.order_signals(spark, sf))


def stale_services(spark, sf):
    seen = V.order_signals(spark, sf).groupBy("service_id").agg(F.max("observed_at").alias("seen"))
    s = V.services(spark, sf).drop("last_checked").join(seen.withColumnRenamed("service_id", "id"), "id", "left")
    s = s.withColumnRenamed("seen", "last_checked")
    o = V.offers(spark, sf)
    return enrich.stale_services(s, o, V.instant("2001-06-01 00:00:00"), 24.0 * 30).select("id", "canonical_domain")


def notify_single(spark, sf):
    return notify.single_batch(V.offers(spark, sf), V.services(spark, sf), limit=200)


def notify_group(spark, sf):
    return notify.group_batch(V.offers(spark, sf), V.services(spark, sf), V.order_signals(spark, sf), limit=100)


def notified_after_single(spark, sf):
    o = V.offers(spark, sf).withColumn("canonical_domain", F.lit(None).cast("string"))
    marked = notify.mark_notified(o, notify.single_batch(o, V.services(spark, sf)), _as_of())
    return marked.groupBy(F.col("notified_at").isNotNull().alias("sent")).agg(F.count("*").alias("offers"))


def display_texts(spark, sf):
    """Labels shown with an offer."""
    first = F.col("first_seen_at")
    age = S.hours_between(_as_of(), first)
    born = first - F.expr("make_dt_interval(0, CAST(id % 100 AS INT), 0, 0)")
    lead = S.domain_age_lead(born, first)
    return V.offers(spark, sf).select(
        "id",
        DI.amount_label(F.col("amount"), F.col("currency")).alias("amount_label"),
        DI.value_label(F.floor("amount").cast("double"), F.col("unit"), F.col("currency")).alias("value_label"),
        DI.lead_label(lead).alias("lead_label"),
        DI.hours_label(age).alias("hours_label"),
        DI.age_label(first, _as_of()).alias("age_label"),
        DI.score_percent(F.col("score")).alias("score_percent"),
        DI.is_within_hours(first, _as_of(), 24.0 * 365).alias("is_recent"),
        F.array_join(DI.claim_steps(F.col("claim_steps")), "|").alias("steps"),
    )


def visitor_fingerprint(spark, sf):
    e = V.table(spark, sf, "events")
    ip = F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string"))
    forwarded = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(" , 1.1.1.1")))
    agent = F.when(F.col("event_type") != "view", F.col("event_type"))
    return e.select("event_id", DI.fingerprint(ip, forwarded, agent).alias("fingerprint"))


QUERIES = {
    f.__name__: f
    for f in (
        feed_default, feed_new, feed_amount, feed_search, feed_model, feed_recent, feed_edge, offers_with_votes,
        best_offer_per_domain, feed_view, feed_view_saved, service_latest_signals, service_offers, signal_provenance,
        richest_signal, stale_services, notify_single, notify_group, notified_after_single, display_texts,
        visitor_fingerprint,
    )
}

# ------------------------------------------------------------------ SQL
_BASE = f"""WITH {V.OFFERS_SQL}, {V.SERVICES_SQL}, {V.ORDER_SIGNALS_SQL},
first_src AS (
  SELECT offer_id, source, source_url FROM (
    SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY observed_at, signal_id) AS n FROM order_signals) WHERE n = 1
),
items AS (
  SELECT o.id, o.service_id, s.canonical_domain AS domain, coalesce(nullif(s.name, ''), o.url) AS name, o.type, o.amount,
         o.currency, o.claim_steps, o.referral_required, o.effort, o.unit, o.url, round(o.score, 4) AS score,
         coalesce(s.status, o.status) AS status, s.reliability, s.engine, f.source, f.source_url,
         array_to_string(o.models, ',') AS models, o.first_seen_at, s.status AS service_status, s.name AS service_name
  FROM offers o JOIN services s ON s.id = o.service_id LEFT JOIN first_src f ON f.offer_id = o.id
)"""
_COLS = ", ".join(_SHOWN) + ", models"
_VOTED = f"""{_BASE}, {V.VOTES_SQL},
tot AS (SELECT offer_id, count(*) FILTER (WHERE vote = 1) AS likes, count(*) FILTER (WHERE vote = -1) AS dislikes
        FROM votes GROUP BY 1)"""
_AMT = "CASE WHEN amount IS NULL OR amount = 0 THEN NULL ELSE CAST(trunc(amount) AS BIGINT) END"
_ROUNDED = "CAST(CAST(round(amount) AS BIGINT) AS VARCHAR)"
_SYM = "CASE WHEN coalesce(currency, 'USD') = 'USD' THEN '$' ELSE currency || ' ' END"
_CARD = """'🟢 ' || canonical_domain || chr(10) || '💰 ' ||
   CASE WHEN coalesce(amount, 0) = 0 THEN '?' ELSE coalesce(currency, '$') || CAST(CAST(trunc(amount) AS BIGINT) AS VARCHAR) END
   || ' · ' || type || ' · ' || effort || ' · score ' || printf('%.2f', score + 0.0000000001)
   || CASE WHEN models <> '' THEN chr(10) || '🤖 ' || replace(models, ',', ', ') ELSE '' END
   || CASE WHEN referral_required THEN chr(10) || '⚠ referral required' ELSE '' END
   || CASE WHEN claim_steps IS NOT NULL THEN chr(10) || claim_steps[1:300] ELSE '' END || chr(10) || url"""
_UNSENT = f"""WITH {V.OFFERS_SQL}, {V.SERVICES_SQL}, {V.ORDER_SIGNALS_SQL},
unsent AS (SELECT o.id, o.type, o.amount, o.currency, o.effort, o.score, o.referral_required, o.claim_steps, o.url,
                  o.topic, o.description, array_to_string(o.models, ',') AS models, s.canonical_domain
           FROM offers o JOIN services s ON s.id = o.service_id)"""
_FREEBIE = K.any_word("blob", lx.FREEBIE_WORDS)
_RECENT_SEEN = "TIMESTAMP '2001-08-02 00:00:00'"

ORACLE = {
    "feed_default": f"{_BASE} SELECT {_COLS} FROM items ORDER BY score DESC, first_seen_at DESC, id LIMIT 100",
    "feed_new": f"{_BASE} SELECT {_COLS} FROM items WHERE type = 'relay' ORDER BY first_seen_at DESC, score DESC, id LIMIT 50 OFFSET 20",
    "feed_amount": f"""{_BASE} SELECT {_COLS} FROM items WHERE amount >= 1000 AND effort = 'easy' AND service_status = 'active'
ORDER BY amount DESC NULLS LAST, score DESC, id LIMIT 100""",
    "feed_search": f"""{_BASE} SELECT {_COLS} FROM items
WHERE contains(lower(domain), 'shop 1') OR contains(lower(coalesce(service_name, '')), 'shop 1')
   OR contains(lower(coalesce(claim_steps, '')), 'shop 1')""",
    "feed_model": f"{_BASE} SELECT {_COLS} FROM items WHERE contains(lower(models), 'gpt') ORDER BY score DESC, first_seen_at DESC, id LIMIT 200",
    "feed_recent": f"{_BASE} SELECT {_COLS} FROM items WHERE first_seen_at >= {_RECENT_SEEN} - INTERVAL 4800 HOUR",
    "feed_edge": f"""{_VOTED}
SELECT {_COLS.replace('name,', 'domain AS name,', 1)}, coalesce(likes, 0) AS likes, coalesce(dislikes, 0) AS dislikes
FROM (SELECT * FROM items WHERE first_seen_at >= {_RECENT_SEEN} - INTERVAL 8760 HOUR
      ORDER BY first_seen_at DESC, score DESC, id LIMIT 300) LEFT JOIN tot ON tot.offer_id = id
WHERE contains(lower(models), 'claude')""",
    "offers_with_votes": f"""{_VOTED}
SELECT id, domain AS name, coalesce(likes, 0) AS likes, coalesce(dislikes, 0) AS dislikes, source
FROM items LEFT JOIN tot ON tot.offer_id = id""",
    "best_offer_per_domain": f"""{_BASE}
SELECT id, domain, score FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, id) AS n FROM items)
WHERE n = 1""",
    "feed_view": f"""{_BASE}
SELECT id, domain, type, amount, source, score FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, id) AS n FROM items
  WHERE effort = 'easy' AND source IS NOT NULL AND source <> 'export' AND {K.in_list('source', lx.SOURCE_CATEGORIES['forums'])}
    AND NOT referral_required AND type <> 'model_release') WHERE n = 1""",
    "feed_view_saved": f"""{_BASE}
SELECT id, engine, score FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, id) AS n FROM items
  WHERE engine = 'new-api' AND type <> 'model_release'
    AND id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) WHERE n = 1""",
    "service_latest_signals": f"""WITH {V.ORDER_SIGNALS_SQL}
SELECT service_id, signal_id, source,
       CASE WHEN source_url LIKE '%t.me/%' THEN '@' || split_part(split_part(source_url, 't.me/', 2), '/', 1) END AS channel,
       raw_text[1:1200] AS raw_text
FROM (SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY observed_at DESC, signal_id DESC) AS n FROM order_signals)
WHERE n <= 20""",
    "service_offers": f"{_BASE} SELECT id, domain, name, status, score FROM items",
    "signal_provenance": f"""WITH {V.ORDER_SIGNALS_SQL}
SELECT service_id, signal_id, source FROM (
  SELECT *, row_number() OVER (PARTITION BY service_id, coalesce(source_url, source || ':' || raw_text)
    ORDER BY CASE WHEN source_url LIKE 'http%' THEN 1 ELSE 0 END DESC, length(raw_text) DESC, signal_id) AS n FROM order_signals)
WHERE n = 1""",
    "richest_signal": f"""WITH {V.ORDER_SIGNALS_SQL}
SELECT service_id, raw_text FROM (
  SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY length(raw_text) DESC, signal_id) AS n FROM order_signals)
WHERE n = 1""",
    "stale_services": f"""WITH {V.OFFERS_SQL}, {V.SERVICES_SQL},
seen AS (SELECT o_custkey, max(o_orderdate) AS seen_at FROM orders GROUP BY 1)
SELECT id, canonical_domain FROM services LEFT JOIN seen ON o_custkey = id
WHERE seen_at IS NULL OR seen_at < TIMESTAMP '2001-06-01 00:00:00' - INTERVAL 720 HOUR
   OR id IN (SELECT service_id FROM offers WHERE description IS NULL)""",
    "notify_single": f"""{_UNSENT}
SELECT id AS offer_id, CAST(NULL AS VARCHAR) AS topic, {_CARD} AS text FROM unsent WHERE score >= 0.6
ORDER BY score DESC, id LIMIT 200""",
    "notify_group": f"""{_UNSENT},
win AS (SELECT * FROM unsent ORDER BY score DESC, id LIMIT 500),
facts AS (
  SELECT offer_id, max(confidence) AS confidence,
         (arg_min(source_url, signal_id) FILTER (WHERE source = 'telegram')) AS tg_url,
         (arg_min(source_url, signal_id) FILTER (WHERE source_url IS NOT NULL)) AS link,
         (list(raw_text ORDER BY length(raw_text) DESC, signal_id))[1] AS best
  FROM order_signals GROUP BY 1
),
gated AS (
  SELECT w.*, f.*, lower(concat_ws(' ', canonical_domain, nullif(description, ''), claim_steps, replace(models, ',', ' '))) AS blob,
         split_part(split_part(tg_url, 't.me/', 2), '/', 1) AS channel
  FROM win w LEFT JOIN facts f ON f.offer_id = w.id
  WHERE tg_url IS NOT NULL OR (score >= 0.6 AND coalesce(confidence, 0) >= 0.5)
  ORDER BY score DESC, id LIMIT 100
)
SELECT id AS offer_id,
       CASE WHEN tg_url IS NOT NULL THEN 'forwarded' WHEN topic = 'ai_service' THEN 'ai_services'
            WHEN topic = 'freebie' THEN 'freebies' WHEN type IN ('saas_promo', 'grant') OR {_FREEBIE} THEN 'freebies'
            ELSE 'ai_services' END AS topic,
       CASE WHEN tg_url IS NOT NULL
            THEN '📡 из @' || channel || chr(10) || chr(10) || trim(best)[1:3500] || coalesce(chr(10) || chr(10) || link, '')
            ELSE {_CARD} END AS text
FROM gated""",
    "notified_after_single": f"""{_UNSENT}
SELECT sent, count(*) AS offers FROM (
  SELECT id IN (SELECT id FROM unsent WHERE score >= 0.6 ORDER BY score DESC, id LIMIT 20) AS sent FROM offers) GROUP BY 1""",
    "display_texts": f"""WITH {V.OFFERS_SQL},
t AS (SELECT *, {K.hours(_RECENT_SEEN, 'first_seen_at')} AS age, id % 100 AS lead,
             CAST(floor((epoch_us({_RECENT_SEEN}) - epoch_us(first_seen_at)) / 1000000) AS BIGINT) AS sec,
             CAST(floor(amount) AS BIGINT) AS whole FROM offers)
SELECT id,
  CASE WHEN coalesce(amount, 0) = 0 THEN '' ELSE {_SYM} || {_ROUNDED} END AS amount_label,
  CASE WHEN coalesce(whole, 0) = 0 THEN ''
       WHEN unit = 'credits' THEN regexp_replace(format('{{:,}}', whole), '^$', '') || 'cr'
       WHEN unit = 'days' THEN CAST(whole AS VARCHAR) || 'd trial' WHEN unit = 'months' THEN CAST(whole AS VARCHAR) || 'mo'
       ELSE {_SYM} || CAST(whole AS VARCHAR) END AS value_label,
  CASE WHEN lead <= 0 THEN NULL WHEN lead < 24 THEN '+' || CAST(lead AS VARCHAR) || 'h ahead'
       ELSE '+' || CAST(CAST(round(lead / 24.0) AS BIGINT) AS VARCHAR) || 'd ahead' END AS lead_label,
  CAST(CAST(floor(age) AS BIGINT) AS VARCHAR) || 'h ' || CAST(CAST(round((age - floor(age)) * 60) AS BIGINT) AS VARCHAR) || 'm' AS hours_label,
  CASE WHEN sec < 60 THEN 'только что' WHEN sec < 3600 THEN CAST(sec // 60 AS VARCHAR) || ' мин назад'
       WHEN sec < 86400 THEN CAST(sec // 3600 AS VARCHAR) || ' ч назад' ELSE CAST(sec // 86400 AS VARCHAR) || ' дн назад' END AS age_label,
  CAST(round(score * 100) AS INTEGER) AS score_percent,
  sec < 31536000 AS is_recent,
  CASE WHEN claim_steps IS NULL THEN NULL ELSE
    'sign up at shop ' || CAST(service_id AS VARCHAR) || '|enter code ' || CAST(id AS VARCHAR) || '|wait for mail' END AS steps
FROM t""",
    "visitor_fingerprint": """
SELECT event_id, sha256(coalesce(CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) END,
       CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || CAST(user_id AS VARCHAR) END, 'unknown') || '|' ||
       CASE WHEN event_type <> 'view' THEN event_type ELSE 'unknown' END) AS fingerprint
FROM events""",
}
