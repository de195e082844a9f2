"""Candidate queue, probe outcomes, promotion, enrichment and purge."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import kit as K
from checks import views as V
from leadlens import lexicon as lx
from leadlens import schemas
from leadlens.functions import domains as D
from leadlens.functions import score as S
from leadlens.operators import admin as A
from leadlens.operators import candidates as C
from leadlens.operators import enrich as E

_NOW = "2024-01-31 12:00:00"
# customers as candidates: portable expressions for both engines
_CANDIDATE = {
    "id": "c_custkey",
    "domain": V.DOMAIN_EXPR,
    "first_source": "c_mktsegment",
    "status": "CASE c_nationkey % 5 WHEN 0 THEN 'rejected' ELSE 'pending' END",
    "attempts": "CAST(c_custkey % 4 AS INT)",
    "priority": "CASE WHEN c_acctbal > 7000 THEN 'high' ELSE 'normal' END",
    "minutes_ago": "CAST(c_custkey % 2000 AS INT)",
}
_FACT = {
    "alive": "c_acctbal > 0",
    "status": "CASE WHEN c_acctbal > 0 THEN 200 ELSE 503 END",
    "title": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'T ' || c_name END",
    "engine": "CASE c_custkey % 8 WHEN 1 THEN 'one-api' WHEN 2 THEN 'relay' ELSE NULL END",
    "has_pricing": "c_nationkey % 2 = 0",
    "pricing_triggers": "c_nationkey % 3 = 0",
    "amount": "CASE WHEN c_nationkey % 7 = 0 THEN CAST(c_custkey % 500 AS DOUBLE) ELSE NULL END",
    "is_relay": "c_custkey % 8 = 2",
    "description": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'page of ' || c_name END",
}


def _candidates(spark, sf):
    c = V.table(spark, sf, "customer").select(*[F.expr(e).alias(n) for n, e in _CANDIDATE.items()])
    now = V.instant(_NOW)
    at = lambda minutes: F.timestamp_micros(F.unix_micros(now) - minutes.cast("bigint") * 60000000)
    return schemas.with_schema(
        c.withColumns(
            {
                "probed_at": F.when(F.col("attempts") > 0, at(F.col("minutes_ago"))),
                "first_seen": at(F.col("minutes_ago") * 7),
            }
        ),
        "candidates",
    )


def _facts(spark, sf):
    """Page facts per customer domain; customers of nations 20 and up were never fetched."""
    c = V.table(spark, sf, "customer").where("c_nationkey < 20")
    models = F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("gpt"), F.lit("claude")))
    rows = c.select(
        D.registrable_domain(F.expr(V.DOMAIN_EXPR)).alias("domain"), "c_custkey",
        *[F.expr(e).alias(n) for n, e in _FACT.items()], models.alias("models"),
    )
    one = rows.groupBy("domain").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("domain", "c_custkey")]), "c_custkey").alias("f"))
    return schemas.with_schema(one.select("domain", "f.*"), "page_facts")


def _services(spark, sf):
    """Customers of one market segment are known services."""
    return V.services(spark, sf).where("type = 'BUILDING'")


def candidate_queue(spark, sf):
    return C.dequeue(_candidates(spark, sf), limit=500, max_attempts=3, max_probes=400).select("id", "domain", "priority", "attempts")


def retry_backoff(spark, sf):
    c = _candidates(spark, sf)
    return c.select("id", C.waits_for_retry(F.col("attempts"), F.col("probed_at"), V.instant(_NOW)).alias("waits"))


def _outcomes(spark, sf):
    batch = _candidates(spark, sf).where("status = 'pending' AND attempts < 3")
    return C.probe_outcomes(batch, _services(spark, sf), _facts(spark, sf), V.instant(_NOW))


def probe_outcomes(spark, sf):
    return _outcomes(spark, sf).select("id", "reg", "outcome")


def candidates_after_probe(spark, sf):
    done = C.apply_outcomes(_candidates(spark, sf), _outcomes(spark, sf), V.instant(_NOW))
    done = C.retire_exhausted(done)
    alive = F.get_json_object("probe_result", "$.alive")
    return done.select("id", "status", "attempts", alive.alias("probe_alive"))


def discovery_counters(spark, sf):
    return C.discovery_counters(_outcomes(spark, sf))


def promoted_services(spark, sf):
    out = C.promote(_services(spark, sf), _outcomes(spark, sf), V.instant(_NOW))
    return out.select("canonical_domain", "name", "type", "status", F.array_join("models", ",").alias("models"))


def linkgraph_queue(spark, sf):
    """Novel outbound domains of the pages: not a service, not queued, not blocked."""
    body = F.concat(
        F.lit("https://svc"), (F.col("page_id") * 3).cast("string"), F.lit(".ai/x https://new"), (F.col("page_id") % 60).cast("string"),
        F.lit(".dev https://x.com/y "), F.col("html"),
    )
    pages = V.text_table(spark, sf, "pages").select(D.canonical_domain(F.col("url")).alias("domain"), body.alias("body"))
    return C.linkgraph_candidates(pages, _services(spark, sf), _candidates(spark, sf)).select("domain", "first_source", "priority")


def enriched_services(spark, sf):
    s = V.services(spark, sf)
    c = V.table(spark, sf, "orders")
    certs = c.join(
        s.select(F.col("id").alias("o_custkey"), F.col("canonical_domain").alias("domain")), "o_custkey"
    ).select(
        "domain",
        F.when(F.col("o_orderstatus") == "F", "bad-date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("not_before"),
    )
    facts = _facts(spark, sf)
    out = E.enrich_services(s, facts, V.instant("2001-01-01 00:00:00"), certs)
    return out.select(
        "canonical_domain", "status", "engine", "reliability",
        F.date_format("domain_first_seen", "yyyy-MM-dd").alias("born"), F.col("last_checked").isNotNull().alias("checked"),
    )


def enriched_offers(spark, sf):
    s = V.services(spark, sf).select(F.col("id").alias("service_id"), "canonical_domain")
    o = V.offers(spark, sf).join(s, "service_id")
    out = E.enrich_offers(o, _facts(spark, sf))
    return out.select("id", "description", "amount", F.array_join("models", ",").alias("models"))


def reliability_values(spark, sf):
    c = V.table(spark, sf, "customer")
    age = F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).otherwise(F.col("c_custkey") % 45).cast("double")
    return c.select(
        F.col("c_custkey").alias("id"),
        S.reliability(F.col("c_acctbal") > 0, F.col("c_nationkey") % 2 == 0, F.col("c_custkey") % 3 == 0, age).alias("reliability"),
    )


def _purged(spark, sf):
    metrics = V.order_signals(spark, sf).select("offer_id").distinct().withColumn("lead_hours", F.lit(1.0))
    return A.purge_blocked(V.services(spark, sf), V.offers(spark, sf), V.order_signals(spark, sf), metrics)


def purge_counters(spark, sf):
    p = _purged(spark, sf)
    left = p.signals.agg(F.count("*").alias("signals_left"))
    from leadlens.operators.leads import one_row

    return one_row(p.counters, left, p.lead_metrics.agg(F.count("*").alias("metrics_left")))


def purged_services(spark, sf):
    return _purged(spark, sf).services.select("id", "canonical_domain")


def purged_offers(spark, sf):
    return _purged(spark, sf).offers.select("id", "service_id")


QUERIES = {
    f.__name__: f
    for f in (
        candidate_queue, retry_backoff, probe_outcomes, candidates_after_probe, discovery_counters, promoted_services,
        linkgraph_queue, enriched_services, enriched_offers, reliability_values, purge_counters, purged_services,
        purged_offers,
    )
}

# ------------------------------------------------------------------ SQL
_T = f"TIMESTAMP '{_NOW}'"
_REG = K.registrable(K.canonical("domain"))
_CAND = f"""cand0 AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _CANDIDATE.items())} FROM customer),
cand AS (SELECT *, {_REG} AS reg, CASE WHEN attempts > 0 THEN {_T} - to_minutes(minutes_ago) END AS probed_at,
                {_T} - to_minutes(minutes_ago * 7) AS first_seen FROM cand0)"""
_WAITS = f"""(attempts > 0 AND ({K.hours(_T, 'probed_at')}) < CASE attempts WHEN 1 THEN 1 WHEN 2 THEN 6 ELSE 24 END)"""
_FACTS = f"""facts AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY domain ORDER BY c_custkey) AS k FROM (
      SELECT c_custkey, {K.registrable(K.canonical('(' + V.DOMAIN_EXPR + ')'))} AS domain, {', '.join(f'{e} AS {n}' for n, e in _FACT.items())},
             CASE WHEN c_custkey % 4 = 0 THEN 'gpt,claude' END AS models
      FROM customer WHERE c_nationkey < 20)) WHERE k = 1
)"""
_KNOWN = f"{V.SERVICES_SQL}, known AS (SELECT * FROM services WHERE type = 'BUILDING')"
_OUT = f"""WITH {_CAND}, {_FACTS}, {_KNOWN},
outc AS (
  SELECT c.id, c.reg, f.domain IS NOT NULL AS has_facts, f.title, f.models, f.alive,
    CASE WHEN {_WAITS} THEN 'waiting' WHEN {K.in_list('reg', lx.BLOCKED_DOMAINS)} THEN 'unsafe'
         WHEN reg IN (SELECT canonical_domain FROM known) THEN 'known' WHEN f.domain IS NULL THEN 'failed'
         WHEN f.alive AND (f.models IS NOT NULL OR f.engine IS NOT NULL OR f.is_relay)
              AND (f.is_relay OR f.pricing_triggers OR f.amount IS NOT NULL OR f.has_pricing) THEN 'promoted'
         ELSE 'rejected' END AS outcome
  FROM cand c LEFT JOIN facts f ON f.domain = c.reg WHERE c.status = 'pending' AND c.attempts < 3
)"""
_BAD = f"bad AS (SELECT id FROM services WHERE {K.in_list(K.registrable(K.canonical('canonical_domain')), lx.BLOCKED_DOMAINS)})"
_PURGE = f"WITH {V.SERVICES_SQL}, {V.OFFERS_SQL}, {V.ORDER_SIGNALS_SQL}, {_BAD}"

ORACLE = {
    "candidate_queue": f"""WITH {_CAND} SELECT id, domain, priority, attempts FROM cand WHERE status = 'pending' AND attempts < 3
ORDER BY CASE WHEN priority = 'high' THEN 0 ELSE 1 END, first_seen, id LIMIT 400""",
    "retry_backoff": f"WITH {_CAND} SELECT id, coalesce({_WAITS}, false) AS waits FROM cand",
    "probe_outcomes": f"{_OUT} SELECT id, reg, outcome FROM outc",
    "candidates_after_probe": f"""{_OUT},
done AS (
  SELECT c.id, CASE o.outcome WHEN 'unsafe' THEN 'rejected' WHEN 'known' THEN 'known' WHEN 'promoted' THEN 'promoted'
                  WHEN 'rejected' THEN 'rejected' ELSE c.status END AS status,
    CASE WHEN o.outcome IS NOT NULL AND o.outcome <> 'waiting' THEN c.attempts + 1 ELSE c.attempts END AS attempts,
    CASE WHEN o.outcome IN ('promoted', 'rejected') THEN CAST(o.alive AS VARCHAR) END AS probe_alive
  FROM cand c LEFT JOIN outc o ON o.id = c.id
)
SELECT id, CASE WHEN status = 'pending' AND attempts >= 3 THEN 'rejected' ELSE status END AS status, attempts, probe_alive FROM done""",
    "discovery_counters": f"""{_OUT}
SELECT count(*) FILTER (WHERE outcome IN ('promoted', 'rejected')) AS probed, count(DISTINCT reg) FILTER (WHERE outcome = 'promoted') AS promoted,
  count(*) FILTER (WHERE outcome = 'rejected') AS rejected,
  count(*) FILTER (WHERE outcome IN ('waiting', 'unsafe', 'known')) AS skipped FROM outc""",
    "promoted_services": f"""{_OUT}
SELECT canonical_domain, name, type, status, CAST(NULL AS VARCHAR) AS models FROM known
UNION ALL
SELECT reg, coalesce(title, reg), 'other', 'new', models FROM (
  SELECT *, row_number() OVER (PARTITION BY reg ORDER BY id) AS k FROM outc WHERE outcome = 'promoted')
WHERE k = 1 AND reg NOT IN (SELECT canonical_domain FROM known)""",
    "linkgraph_queue": f"""WITH {_CAND}, {_KNOWN},
t AS (SELECT DISTINCT unnest(['svc' || CAST(page_id * 3 AS VARCHAR) || '.ai', 'new' || CAST(page_id % 60 AS VARCHAR) || '.dev']) AS domain FROM pages)
SELECT domain, 'linkgraph' AS first_source, 'normal' AS priority FROM t
WHERE domain NOT IN (SELECT canonical_domain FROM known) AND domain NOT IN (SELECT domain FROM cand)""",
    "enriched_services": f"""WITH {V.SERVICES_SQL}, {_FACTS},
cert AS (
  SELECT canonical_domain, min(o_orderdate) FILTER (WHERE o_orderstatus <> 'F') AS born
  FROM orders JOIN services s ON s.id = o_custkey GROUP BY 1
)
SELECT s.canonical_domain, CASE WHEN f.domain IS NULL THEN s.status WHEN f.alive THEN 'active' ELSE 'dead' END AS status,
  CASE WHEN f.domain IS NULL THEN s.engine ELSE f.engine END AS engine,
  CASE WHEN f.domain IS NULL THEN s.reliability ELSE {K.steady('''least(
    CASE WHEN f.alive THEN 0.5 ELSE 0 END + CASE WHEN f.has_pricing THEN 0.2 ELSE 0 END + CASE WHEN f.engine IS NOT NULL THEN 0.1 ELSE 0 END
    + CASE WHEN born IS NULL THEN 0 ELSE least(((epoch_us(TIMESTAMP '2001-01-01 00:00:00') - epoch_us(born)) / 3600000000.0) / 24 / 30.0, 1.0) * 0.2 END, 1.0)''', 3)} END AS reliability,
  CASE WHEN f.domain IS NOT NULL THEN strftime(born, '%Y-%m-%d') END AS born, f.domain IS NOT NULL AS checked
FROM services s LEFT JOIN facts f ON f.domain = s.canonical_domain LEFT JOIN cert c ON c.canonical_domain = s.canonical_domain""",
    "enriched_offers": f"""WITH {V.SERVICES_SQL}, {V.OFFERS_SQL}, {_FACTS}
SELECT o.id, coalesce(f.description, f.title, o.description) AS description,
  coalesce(nullif(o.amount, 0), f.amount, o.amount) AS amount,
  coalesce(nullif(array_to_string(o.models, ','), ''), f.models, '') AS models
FROM offers o JOIN services s ON s.id = o.service_id LEFT JOIN facts f ON f.domain = s.canonical_domain""",
    "reliability_values": f"""SELECT c_custkey AS id, {K.steady('''least(CASE WHEN c_acctbal > 0 THEN 0.5 ELSE 0 END
  + CASE WHEN c_nationkey % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 0.1 ELSE 0 END
  + CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE least((c_custkey % 45) / 30.0, 1.0) * 0.2 END, 1.0)''', 3)} AS reliability FROM customer""",
    "purge_counters": f"""{_PURGE},
bad_offers AS (SELECT id FROM offers WHERE service_id IN (SELECT id FROM bad))
SELECT (SELECT count(*) FROM bad) AS services, (SELECT count(*) FROM bad_offers) AS offers,
  (SELECT count(*) FROM order_signals WHERE service_id IN (SELECT id FROM bad)) AS signals,
  (SELECT count(*) FROM order_signals WHERE service_id NOT IN (SELECT id FROM bad)) AS signals_left,
  (SELECT count(DISTINCT offer_id) FROM order_signals WHERE offer_id NOT IN (SELECT id FROM bad_offers)) AS metrics_left""",
    "purged_services": f"{_PURGE} SELECT id, canonical_domain FROM services WHERE id NOT IN (SELECT id FROM bad)",
    "purged_offers": f"{_PURGE} SELECT id, service_id FROM offers WHERE service_id NOT IN (SELECT id FROM bad)",
}
