"""Lead time, statistics and votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import kit as K
from checks import views as V
from leadlens import lexicon as lx
from leadlens.operators import leads as L
from leadlens.operators import scoring, stats, votes
from leadlens.session import checkpointed


def _stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def source_leaderboard(spark, sf):
    return L.source_leaderboard_single_pass(V.event_signals(spark, sf), V.AGGREGATORS)


def source_leaderboard_joined(spark, sf):
    s = V.event_signals(spark, sf)
    return L.source_leaderboard(L.lead_metrics(s, V.AGGREGATORS), s)


def lead_metrics(spark, sf):
    m = L.lead_metrics(V.event_signals(spark, sf), V.AGGREGATORS)
    return m.select("offer_id", _stamp("first_seen_by_us"), _stamp("first_seen_in_aggregator"), "lead_hours")


def _order_metrics(spark, sf):
    return L.lead_metrics(V.order_signals(spark, sf))


def lead_summary_api(spark, sf):
    return L.lead_summary(L.lead_metrics(V.event_signals(spark, sf), V.AGGREGATORS))


def lead_summary_edge(spark, sf):
    out = L.lead_summary(L.lead_metrics(V.event_signals(spark, sf), V.AGGREGATORS), "edge")
    return out.withColumn("median_hours", F.round("median_hours", 4))


def lead_scoreboard(spark, sf):
    return L.lead_scoreboard(_order_metrics(spark, sf), V.offers(spark, sf), V.services(spark, sf))


def lead_top10(spark, sf):
    top = L.top_leads(_order_metrics(spark, sf), V.offers(spark, sf), V.services(spark, sf))
    return top.select("offer_id", "canonical_domain", "lead_hours", _stamp("first_seen_by_us"))


def first_source_per_offer(spark, sf):
    return L.first_source(V.event_signals(spark, sf))


def signals_by_source(spark, sf):
    return stats.signals_by_source(V.event_signals(spark, sf))


def top_sources(spark, sf):
    return stats.signals_by_source(V.document_signals(spark, sf), 10)


def stats_totals(spark, sf):
    return stats.status_share(V.services(spark, sf), V.offers(spark, sf))


def offers_by_type(spark, sf):
    return stats.with_bar_percent(stats.count_by(V.offers(spark, sf), "type"))


def offers_by_effort(spark, sf):
    return stats.count_by(V.offers(spark, sf), "effort", keep_null=False)


def description_coverage(spark, sf):
    o = V.offers(spark, sf)
    api = stats.description_coverage(o).withColumn("variant", F.lit("api"))
    return api.unionByName(stats.description_coverage(o, False).withColumn("variant", F.lit("edge")))


def model_ranking(spark, sf):
    return stats.model_ranking(V.offers(spark, sf), V.services(spark, sf))


def top_models(spark, sf):
    return stats.top_models(V.offers(spark, sf), V.services(spark, sf))


def model_ranking_all(spark, sf):
    return stats.model_ranking(V.offers(spark, sf), V.services(spark, sf), include_dead=True)


def vote_totals(spark, sf):
    return votes.vote_totals(votes.current_votes(V.vote_events(spark, sf)))


def my_vote(spark, sf):
    offers = V.event_signals(spark, sf).select(F.col("offer_id").alias("id")).distinct()
    return votes.my_votes(offers, votes.current_votes(V.vote_events(spark, sf)), "7")


SCORE_WEIGHTS = lx.ScoreWeights(half_life_hours=20000.0, amount_cap=500000.0)


def offer_score(spark, sf):
    out = scoring.rescore(
        V.offers(spark, sf), V.services(spark, sf), V.order_signals(spark, sf), V.instant(V.ORDERS_AS_OF), SCORE_WEIGHTS
    )
    return out.select("id", "score")


# Before many offers, at the end of them, and long after.
RANK_TIMES = ("1995-03-01 12:00:00", V.ORDERS_AS_OF, "2019-01-01 00:00:00")


def pages_by_rank(spark, sf):
    """The second page of the feed's default order at three times, from one table of ranks."""
    rows = checkpointed(scoring.ranked(V.offers(spark, sf), V.services(spark, sf), V.order_signals(spark, sf), SCORE_WEIGHTS))
    pages = []
    for time in RANK_TIMES:
        page = scoring.top_by_score(rows, V.instant(time), 100, 100, SCORE_WEIGHTS)
        pages.append(page.select(F.lit(time).alias("as_of"), "id", "score"))
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


def service_evidence(spark, sf):
    return scoring.service_evidence(V.order_signals(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        source_leaderboard, source_leaderboard_joined, lead_metrics, lead_summary_api, lead_summary_edge,
        lead_scoreboard, lead_top10, first_source_per_offer, signals_by_source, top_sources, stats_totals,
        offers_by_type, offers_by_effort, description_coverage, model_ranking, model_ranking_all, top_models, vote_totals,
        my_vote, offer_score, pages_by_rank, service_evidence,
    )
}

# ------------------------------------------------------------------ SQL
_LEADS = """
leads AS (
  SELECT offer_id, first_seen_by_us, first_seen_in_aggregator,
         {hours} AS lead_hours
  FROM (SELECT offer_id, min(observed_at) FILTER (WHERE NOT ({agg})) AS first_seen_by_us,
               min(observed_at) FILTER (WHERE {agg}) AS first_seen_in_aggregator
        FROM {signals} GROUP BY offer_id)
)"""
_HOURS = K.steady(K.hours("first_seen_in_aggregator", "first_seen_by_us"), 2)
_EVENT_LEADS = f"WITH {V.EVENT_SIGNALS_SQL}, " + _LEADS.format(
    hours=_HOURS, agg="source = 'purchase'", signals="event_signals"
)
_ORDER_LEADS = (
    f"WITH {V.ORDER_SIGNALS_SQL}, {V.OFFERS_SQL}, {V.SERVICES_SQL}, "
    + _LEADS.format(hours=_HOURS, agg="source IN ('telegram', 'telegram_ingest')", signals="order_signals")
    + """,
scored AS (
  SELECT l.*, s.canonical_domain FROM leads l JOIN offers o ON o.id = l.offer_id JOIN services s ON s.id = o.service_id
  WHERE l.lead_hours IS NOT NULL
)"""
)
_LEADERBOARD = (
    _EVENT_LEADS
    + f"""
SELECT source, {K.steady('avg(lead_hours)', 2)} AS avg_lead_hours, count(*) AS count_total,
       count(*) FILTER (WHERE lead_hours > 0) AS count_ahead
FROM leads JOIN (
  SELECT offer_id, source FROM (
    SELECT offer_id, source, row_number() OVER (PARTITION BY offer_id ORDER BY observed_at, signal_id) AS n
    FROM event_signals) WHERE n = 1) USING (offer_id)
WHERE lead_hours IS NOT NULL GROUP BY source"""
)
_EASE = "CASE type " + " ".join(f"WHEN {K.quoted(t)} THEN {v}" for t, v in lx.EASE_BY_TYPE.items()) + " ELSE 0.5 END"
_SOURCE_LANG = "CASE lower(trim(source)) " + " ".join(
    f"WHEN {K.quoted(s)} THEN {K.quoted(c)}" for s, c in lx.SOURCE_LANG.items()
) + " END"
_EVIDENCE = f"""
langs AS (
  SELECT service_id, source,
         coalesce(CASE WHEN lower(trim(lang)) LIKE 'zh%' THEN 'zh' WHEN lower(trim(lang)) LIKE 'ru%' THEN 'ru'
                       WHEN lower(trim(lang)) LIKE 'en%' THEN 'en' END, {_SOURCE_LANG}) AS code
  FROM order_signals
),
evidence AS (
  SELECT service_id, count(DISTINCT source) AS source_count,
         coalesce(bool_or(code IN ('zh', 'ru')), false) AND NOT coalesce(bool_or(code = 'en'), false) AS is_early
  FROM langs GROUP BY service_id
)"""

def _scores(as_of: str) -> str:
    """Scores of all offers at a time, as common table expressions that end in ``scores``."""
    return f"""base AS (
  SELECT o.id, o.first_seen_at, coalesce(e.source_count, 0) AS n, coalesce(e.is_early, false) AS early,
         greatest({K.hours(f"TIMESTAMP '{as_of}'", 'o.first_seen_at')}, 0) AS age,
         (0.3 * CASE WHEN coalesce(o.amount, 0) <= 0 THEN 0.0 ELSE least(o.amount / 500000.0, 1.0) END
          + 0.2 * ({_EASE.replace('CASE type', 'CASE o.type')}) * CASE WHEN o.referral_required THEN 0.85 ELSE 1.0 END
          + 0.1 * coalesce(s.reliability, 0.0)) / (0.3 + 0.2 + 0.1) AS quality
  FROM offers o LEFT JOIN services s ON s.id = o.service_id LEFT JOIN evidence e ON e.service_id = o.service_id
),
composed AS (
  SELECT *, {K.steady('power(CAST(0.5 AS DOUBLE), CAST(age AS DOUBLE) / 20000.0) * (0.35 + 0.65 * quality)', 4)} AS c FROM base
),
boosted AS (
  SELECT *, least({K.steady('c * (1.0 + 0.15 * least(greatest(CASE WHEN n = 0 THEN 1 ELSE n END - 1, 0), 3))', 4)}, 1.0) AS b
  FROM composed
),
scores AS (
  SELECT id, first_seen_at, CASE WHEN early THEN least({K.steady('b + 0.1', 4)}, 1.0) ELSE b END AS score FROM boosted
)"""


_SCORED = f"WITH {V.OFFERS_SQL}, {V.SERVICES_SQL}, {V.ORDER_SIGNALS_SQL}, {_EVIDENCE}"
ORACLE = {
    "source_leaderboard": _LEADERBOARD,
    "source_leaderboard_joined": _LEADERBOARD,
    "lead_metrics": _EVENT_LEADS
    + f"""
SELECT offer_id, {K.stamp('first_seen_by_us')} AS first_seen_by_us,
       {K.stamp('first_seen_in_aggregator')} AS first_seen_in_aggregator, lead_hours FROM leads""",
    "lead_summary_api": _EVENT_LEADS
    + f"""
SELECT {K.steady('avg(lead_hours)', 2)} AS avg_hours, {K.steady('median(lead_hours)', 2)} AS median_hours,
       count(*) FILTER (WHERE lead_hours > 0) AS count_ahead, count(lead_hours) AS count_total
FROM leads WHERE lead_hours IS NOT NULL""",
    "lead_summary_edge": _EVENT_LEADS
    + f"""
SELECT {K.steady('avg(lead_hours) FILTER (WHERE lead_hours > 0)', 2)} AS avg_hours, round(median(lead_hours), 4) AS median_hours,
       count(*) FILTER (WHERE lead_hours > 0) AS count_ahead, count(lead_hours) AS count_total
FROM leads WHERE lead_hours IS NOT NULL""",
    "lead_scoreboard": _ORDER_LEADS
    + f"""
SELECT count(*) AS tracked, count(*) FILTER (WHERE lead_hours > 0) AS ahead,
       count(*) FILTER (WHERE lead_hours < 0) AS behind, count(*) FILTER (WHERE lead_hours = 0) AS tied,
       {K.steady('avg(lead_hours)', 1)} AS avg_lead, {K.steady('median(lead_hours)', 1)} AS median_lead,
       max(lead_hours) FILTER (WHERE lead_hours > 0) AS best_lead,
       (SELECT canonical_domain FROM scored WHERE lead_hours > 0 ORDER BY lead_hours DESC, offer_id LIMIT 1) AS best_domain,
       CAST(floor(100.0 * count(*) FILTER (WHERE lead_hours > 0) / count(*)) AS BIGINT) AS ahead_pct,
       CAST(floor(100.0 * count(*) FILTER (WHERE lead_hours < 0) / count(*)) AS BIGINT) AS behind_pct
FROM scored""",
    "lead_top10": _ORDER_LEADS
    + f"""
SELECT offer_id, canonical_domain, lead_hours, {K.stamp('first_seen_by_us')} AS first_seen_by_us
FROM scored ORDER BY lead_hours DESC, offer_id LIMIT 10""",
    "first_source_per_offer": f"""WITH {V.EVENT_SIGNALS_SQL}
SELECT offer_id, source, source_url FROM (
  SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY observed_at, signal_id) AS n FROM event_signals)
WHERE n = 1""",
    "signals_by_source": "SELECT event_type AS source, count(*) AS count FROM events GROUP BY 1",
    "top_sources": "SELECT source, count(*) AS count FROM documents GROUP BY 1 ORDER BY count DESC, source LIMIT 10",
    "stats_totals": f"""WITH {V.SERVICES_SQL}, {V.OFFERS_SQL}
SELECT services, active, dead, (SELECT count(*) FROM offers) AS offers,
       CAST(round(100.0 * active / services) AS INTEGER) AS active_pct,
       CAST(round(100.0 * dead / services) AS INTEGER) AS dead_pct
FROM (SELECT count(*) AS services, count(*) FILTER (WHERE status = 'active') AS active,
             count(*) FILTER (WHERE status = 'dead') AS dead FROM services)""",
    "offers_by_type": f"""WITH {V.OFFERS_SQL}
SELECT type, count, CAST(round(100.0 * count / max(count) OVER ()) AS INTEGER) AS bar_pct
FROM (SELECT type, count(*) AS count FROM offers GROUP BY type)""",
    "offers_by_effort": f"WITH {V.OFFERS_SQL} SELECT effort, count(*) AS count FROM offers WHERE effort IS NOT NULL GROUP BY 1",
    "description_coverage": f"""WITH {V.OFFERS_SQL}
SELECT 'api' AS variant, count(*) FILTER (WHERE description <> '') AS with_description, count(*) AS offers_total FROM offers
UNION ALL SELECT 'edge', count(description), count(*) FROM offers""",
    "model_ranking": f"""WITH {V.OFFERS_SQL}, {V.SERVICES_SQL}
SELECT lower(model) AS model, count(*) AS count
FROM (SELECT unnest(o.models) AS model FROM offers o JOIN services s ON s.id = o.service_id WHERE s.status <> 'dead')
GROUP BY 1""",
    "top_models": f"""WITH {V.OFFERS_SQL}, {V.SERVICES_SQL}
SELECT lower(model) AS model, count(*) AS count
FROM (SELECT unnest(o.models) AS model FROM offers o JOIN services s ON s.id = o.service_id WHERE s.status <> 'dead')
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""",
    "model_ranking_all": f"""WITH {V.OFFERS_SQL}, {V.SERVICES_SQL}
SELECT lower(model) AS model, count(*) AS count
FROM (SELECT unnest(o.models) AS model FROM offers o JOIN services s ON s.id = o.service_id) GROUP BY 1""",
    "vote_totals": f"""WITH {V.VOTES_SQL}
SELECT offer_id, count(*) FILTER (WHERE vote = 1) AS likes, count(*) FILTER (WHERE vote = -1) AS dislikes
FROM votes GROUP BY 1""",
    "my_vote": f"""WITH {V.VOTES_SQL}
SELECT e.offer_id, coalesce(v.vote, 0) AS my_vote
FROM (SELECT DISTINCT user_id AS offer_id FROM events) e
LEFT JOIN votes v ON v.offer_id = e.offer_id AND v.fingerprint = '7'""",
    "service_evidence": f"WITH {V.ORDER_SIGNALS_SQL}, {_EVIDENCE} SELECT * FROM evidence",
    "offer_score": f"{_SCORED}, {_scores(V.ORDERS_AS_OF)} SELECT id, score FROM scores",
    "pages_by_rank": " UNION ALL ".join(
        f"(SELECT * FROM ({_SCORED}, {_scores(t)} SELECT '{t}' AS as_of, id, score FROM scores "
        "ORDER BY score DESC, first_seen_at DESC, id LIMIT 100 OFFSET 100))" for t in RANK_TIMES
    ),
}
