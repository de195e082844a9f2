"""Offer posts through the whole ingest: normalise, pre-filter, label, route, deduplicate, merge."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from checks import kit as K
from checks import views as V
from checks.text import _LANG, prefilter_sql
from leadlens import lexicon as lx
from leadlens import schemas
from leadlens.functions import domains as D
from leadlens.operators import candidates as C
from leadlens.operators import ingest as I
from leadlens.plans import sink
from leadlens.plans.batch import IngestJob
from leadlens.session import shared_dir
from leadlens.operators import relabel as RL
from leadlens.session import checkpointed

_AS_OF = V.ORDERS_AS_OF


def posts_normalized(spark, sf):
    n = I.normalize(V.posts(spark, sf))
    return n.select("ingest_seq", "lang", "url", F.array_join("domains", ",").alias("domains"))


def posts_registrable(spark, sf):
    """Blocked and registrable domains of the posts' first host and of customers' domains."""
    first = I.normalize(V.posts(spark, sf)).select(F.get("domains", F.lit(0)).alias("host")).where("host IS NOT NULL")
    own = V.services(spark, sf).select(F.col("canonical_domain").alias("host"))
    hosts = first.unionByName(own).distinct()
    return hosts.select(
        "host", D.registrable_domain(F.col("host")).alias("registrable"), D.is_blocked(F.col("host")).alias("blocked")
    )


def _routed(spark, sf):
    return I.label_signals(V.posts(spark, sf))


def posts_labels(spark, sf):
    """Rule labels of the posts that pass the pre-filter or are forced."""
    c = F.col("label.conditions")
    label = F.col("label")
    kept = I.prefiltered(I.keep_matched(I.normalize(V.posts(spark, sf))))
    return I.rule_classifier(kept).select(
        "ingest_seq", F.array_join("match.hits", ",").alias("hits"), label["is_offer"].alias("is_offer"),
        label["service_name"].alias("service_name"), label["offer_type"].alias("offer_type"),
        label["amount"].alias("amount"), label["currency"].alias("currency"),
        F.array_join(label["models"], ",").alias("models"), label["referral_required"].alias("referral_required"),
        label["effort"].alias("effort"), label["unit"].alias("unit"), label["topic"].alias("topic"),
        F.round(label["confidence"], 2).alias("confidence"),
        F.when(label["is_offer"], c["requires_card"]).alias("requires_card"),
        F.when(label["is_offer"], c["requires_phone"]).alias("requires_phone"),
        F.when(label["is_offer"], c["new_users_only"]).alias("new_users_only"),
        c["region"].alias("region"), F.array_join(c["risk_flags"], ",").alias("risk_flags"),
    )


def posts_routes(spark, sf):
    return _routed(spark, sf).select("ingest_seq", "blocked", "implausible", "route", "service_key", "offer_type")


def _rows(spark, sf, stored=None):
    return I.storable(_routed(spark, sf), stored)


def posts_stored(spark, sf):
    return _stored_columns(I.stored_signals(_rows(spark, sf)))


def appended_signals(spark, sf):
    """Stored signals through the append-only sink, the run being repeated under its name."""
    stored = I.stored_signals(_rows(spark, sf))
    path = f"{shared_dir(spark).removeprefix('file:')}/appended-{uuid.uuid4().hex}"
    sink.append(stored, path, "run")
    sink.append(stored, path, "run")
    return _stored_columns(sink.read_appended(spark, path, stored.schema))


def _stored_columns(s):
    return s.select(
        "source", "source_url", "url", F.md5("raw_text").alias("digest"), "lang", F.round("confidence", 2).alias("confidence"),
        F.col("offer_id").isNotNull().alias("has_offer"), F.col("service_id").isNotNull().alias("has_service"),
    )


def posts_counters(spark, sf):
    return I.pipeline_counters(V.posts(spark, sf))


def ingest_counters(spark, sf):
    """The counters that a whole ingest run writes with its tables, counted while rows are written."""
    target = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    IngestJob().run(V.posts(spark, sf), None, target, _instant())
    return spark.read.parquet(f"{target}/counters")


def posts_outcomes(spark, sf):
    """Duplicate, blocked and stored counts with their dependence on arrival order."""
    return I.outcome_counts(_routed(spark, sf)).drop("offer_observations")


def _instant():
    return V.instant(_AS_OF)


def posts_services(spark, sf):
    """Services after the posts, starting from nothing."""
    out = I.merge_services(schemas.empty(spark, "services"), _rows(spark, sf), _instant())
    return out.select("canonical_domain", "name", "type", F.array_join("models", ",").alias("models"), "status")


def _known_services(spark, sf):
    """Customers as services that exist already (ids are hashes of the domain)."""
    s = V.services(spark, sf)
    reg = D.registrable_domain(F.col("canonical_domain"))
    return s.withColumn("canonical_domain", reg).groupBy("canonical_domain").agg(
        F.min_by("name", "id").alias("name"), F.min_by("type", "id").alias("type"), F.min_by("status", "id").alias("status")
    ).withColumn("id", I.service_id(F.col("canonical_domain")))


def posts_services_merged(spark, sf):
    """Services after the posts, on top of the customers."""
    out = I.merge_services(schemas.new_rows(_known_services(spark, sf), "services"), _rows(spark, sf), _instant())
    return out.select("canonical_domain", "name", "type", "status")


def posts_aliases(spark, sf):
    out = I.merge_aliases(schemas.empty(spark, "service_aliases"), _rows(spark, sf))
    return out.select("canonical_domain", "host", "first_seq")


def _offer_columns(df):
    return df.select(
        "canonical_domain", "type", "amount", "currency", F.array_join("models", ",").alias("models"), "claim_steps",
        "referral_required", "effort", "unit", "topic", "url", F.col("last_verified_at").isNotNull().alias("seen_again"),
    )


def posts_offers(spark, sf):
    """Offers after the posts: first usable value per column in arrival order."""
    return _offer_columns(I.merge_offers(schemas.empty(spark, "offers"), _rows(spark, sf), _instant()))


def _known_offers(spark, sf):
    """One stored offer per known service, without amount, models and unit."""
    s = _known_services(spark, sf)
    kind = F.when(F.length("canonical_domain") % 2 == 0, "saas_trial").otherwise("relay")
    rows = s.select(
        I.offer_id(F.col("canonical_domain"), kind).alias("id"), F.col("id").alias("service_id"), "canonical_domain",
        kind.alias("type"), F.lit(0.0).alias("amount"), F.lit("hard").alias("effort"), F.lit("").alias("currency"),
        F.lit("https://kept.example").alias("url"),
    )
    return schemas.new_rows(rows, "offers")


def posts_offers_merged(spark, sf):
    return _offer_columns(I.merge_offers(_known_offers(spark, sf), _rows(spark, sf), _instant()))


def posts_lead_metrics(spark, sf):
    """Lead metrics of the offers the posts created (joined by the hashed ids)."""
    rows = checkpointed(_rows(spark, sf).drop("match"))
    leads = I.merge_lead_metrics(schemas.empty(spark, "lead_metrics"), rows)
    offers = I.merge_offers(schemas.empty(spark, "offers"), rows, _instant()).select(
        F.col("id").alias("offer_id"), "canonical_domain", "type"
    )
    return leads.join(offers, "offer_id").select("canonical_domain", "type", "lead_hours")


def posts_harvest(spark, sf):
    h = I.harvest_candidates(I.normalize(V.posts(spark, sf)))
    return h.select("domain", "first_source", "mentions", "priority")


TEST_HINT = r"the|die|les|los"


def harvested_from_documents(spark, sf):
    """Candidate domains of documents with an offer context: blocked hosts, suffixes of two parts, both priorities."""
    lex = replace(lx.Lexicon(), harvest_hint=TEST_HINT)
    return I.harvest_candidates(I.normalize(V.document_mentions(spark, sf)), lex).select("domain", "first_source", "mentions", "priority")


def posts_candidates(spark, sf):
    """Candidate queue after the harvest, customers' domains being queued already."""
    known = V.services(spark, sf).select(
        D.registrable_domain(F.col("canonical_domain")).alias("domain"), F.lit("seed").alias("first_source")
    ).distinct().withColumn("id", C.candidate_id(F.col("domain")))
    out = C.merge_candidates(
        schemas.new_rows(known, "candidates"), I.harvest_candidates(I.normalize(V.posts(spark, sf))), _instant()
    )
    return out.select("domain", "first_source", "priority", "status", "attempts")


def relabelled_offers(spark, sf):
    """Offers relabelled from the longest text of their service: an external label for some, rules for the rest."""
    offers, services = V.offers(spark, sf), V.services(spark, sf)
    posts = V.posts(spark, sf).join(
        V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ingest_seq"), F.col("o_custkey").alias("service_id")),
        "ingest_seq",
    ).withColumn("signal_id", F.col("ingest_seq"))
    raw = F.from_json(
        F.format_string(
            '{"is_offer": %s, "offer_type": "%s", "amount": %d, "effort": "%s", "unit": "credits", "topic": "spam", '
            '"models": ["gpt"], "conditions": {"requires_card": true, "region": " ", "risk_flags": ["vpn", "other"]}}',
            F.when(F.col("id") % 4 == 0, "false").otherwise("true"),
            F.when(F.col("id") % 3 == 0, "grant").otherwise("gift"),
            F.col("id") % 7000,
            F.when(F.col("id") % 2 == 0, "easy").otherwise("extreme"),
        ),
        RL.X.LABEL_TYPE,
    )
    external = offers.where(F.col("effort") == "easy").select("id", raw.alias("raw"))
    labels = RL.labels_or_fallback(RL.relabel_inputs(offers, services, posts), external)
    out = RL.apply_labels(offers, labels)
    c = F.col("conditions")
    return out.select(
        "id", "type", "amount", "currency", "unit", "effort", "topic", "referral_required",
        F.array_join("models", ",").alias("models"), c["requires_card"].alias("requires_card"), c["region"].alias("region"),
        F.array_join(c["risk_flags"], ",").alias("risk_flags"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        posts_normalized, posts_registrable, posts_labels, posts_routes, posts_stored, appended_signals, posts_counters, ingest_counters, posts_outcomes,
        posts_services, posts_services_merged, posts_aliases, posts_offers, posts_offers_merged, posts_lead_metrics,
        posts_harvest, harvested_from_documents, posts_candidates, relabelled_offers,
    )
}

# ------------------------------------------------------------------ SQL
_URLS = "list_transform(regexp_extract_all(raw_text, '(?i)https?://[^\\s<>\"'')\\]]+'), lambda u: rtrim(u, '.,);'))"
_ORDERED = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"
def _norm(posts: str) -> str:
    return f"""{posts},
n1 AS (
  SELECT *, list_filter(list_transform(list_concat(CASE WHEN url IS NOT NULL THEN [url] ELSE [] END, {_URLS}),
           lambda u: {K.canonical('u')}), lambda h: h IS NOT NULL AND NOT ({K.in_list('h', lx.SKIP_HOSTS)})) AS hosts
  FROM posts
),
n2 AS (SELECT *, {_ORDERED.format(l='hosts')} AS domains FROM n1),
norm AS (
  SELECT * REPLACE (coalesce(url, 'https://' || domains[1]) AS url), {_LANG.format(t='raw_text')} AS lang,
         lower(raw_text) AS low, domains[1] AS host
  FROM n2
)"""


_NORM = _norm(V.POSTS_SQL)


def _java_to_re2(pattern: str) -> str:
    return K.quoted(pattern.replace("(?iU)", "(?i)").replace("(?U)", ""))


def _amount(pattern: str, text: str = "raw_text") -> str:
    return f"TRY_CAST(replace(nullif(regexp_extract({text}, {_java_to_re2(pattern)}, 1), ''), ',', '.') AS DOUBLE)"


def label_sql(source: str) -> str:
    """CTEs from ``source`` (raw_text, low, url, lang, host) to ``labelled`` with the rule label as columns."""
    referral = (
        f"(regexp_matches(raw_text, {_java_to_re2(lx.REFERRAL_PATTERN)}) "
        f"OR coalesce(regexp_matches(url, {_java_to_re2(lx.REFERRAL_PATTERN)}), false))"
    )
    risks = ", ".join(f"CASE WHEN {K.any_word('low', w)} THEN {K.quoted(f)} END" for f, w in lx.RISK_RULES)
    blob = "(low || coalesce(' ' || lower(url), ''))"
    units = " ".join(f"WHEN regexp_matches(low, {_java_to_re2(p)}) THEN {K.quoted(u)}" for u, p in lx.UNIT_PATTERNS)
    return f"""
m1 AS (SELECT *, {prefilter_sql('raw_text', lx.Lexicon())} AS h FROM {source}),
m2 AS (
  SELECT *, len(h) > 0 AS ok, coalesce({', '.join(_amount(p) for p in lx.AMOUNT_PATTERNS)}) AS p_amount,
    {K.word_hits('low', sorted(lx.MODEL_KEYWORDS))} AS p_models, {referral} AS p_ref,
    CASE WHEN lang = 'zh' OR {K.any_word('raw_text', lx.RELAY_WORDS)} THEN 'relay'
         WHEN {K.any_word('low', lx.RELEASE_WORDS)} THEN 'model_release'
         WHEN {K.any_word('low', lx.STAR_WORDS)} AND {K.any_word('low', lx.REPO_WORDS)} THEN 'grant'
         ELSE 'saas_trial' END AS p_type
  FROM m1
),
m3 AS (
  SELECT *, CASE WHEN regexp_matches(raw_text, {_java_to_re2(lx.AMOUNT_PATTERNS[0])})
                   OR (p_amount IS NOT NULL AND {K.any_word('raw_text', lx.USD_WORDS)}) THEN 'USD' END AS p_cur
  FROM m2
),
labelled AS (
  SELECT *, ok AS is_offer, CASE WHEN ok THEN host END AS service_name, CASE WHEN ok THEN p_type ELSE 'other' END AS l_type,
    CASE WHEN ok THEN p_amount END AS amount, CASE WHEN ok THEN p_cur END AS currency,
    CASE WHEN ok THEN array_to_string(p_models, ',') ELSE '' END AS models, ok AND p_ref AS referral_required,
    CASE WHEN NOT ok THEN NULL WHEN {K.any_word('low', lx.HARD_WORDS)} THEN 'hard'
         WHEN p_ref OR {K.any_word('low', lx.MEDIUM_WORDS)} THEN 'medium' ELSE 'easy' END AS effort,
    CASE WHEN NOT ok OR coalesce(p_amount, 0) = 0 THEN NULL WHEN p_cur = 'USD' THEN 'usd' {units} ELSE 'credits' END AS unit,
    CASE WHEN NOT ok THEN NULL WHEN p_type IN ('saas_promo', 'grant') OR {K.any_word('low', lx.FREEBIE_WORDS)} THEN 'freebie'
         ELSE 'ai_service' END AS topic,
    CASE WHEN ok THEN round(least(0.45 + CASE WHEN coalesce(p_amount, 0) <> 0 THEN 0.25 ELSE 0 END
         + CASE WHEN len(p_models) > 0 THEN 0.15 ELSE 0 END, 0.95), 2)::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
    CASE WHEN NOT ok THEN NULL WHEN regexp_matches({blob}, {_java_to_re2(lx.NO_CARD_PATTERN)}) THEN false
         WHEN {K.any_word('low', lx.CARD_WORDS)} THEN true END AS requires_card,
    CASE WHEN ok AND {K.any_word('low', lx.PHONE_WORDS)} THEN true END AS requires_phone,
    CASE WHEN ok AND {K.any_word('low', lx.NEW_USER_WORDS)} THEN true END AS new_users_only,
    CASE WHEN ok THEN {K.first_label('low', lx.REGION_RULES)} END AS region,
    CASE WHEN ok THEN array_to_string(list_filter([{risks},
      CASE WHEN p_ref OR {K.any_word(blob, lx.REFERRAL_RISK_WORDS)} THEN 'referral' END], lambda f: f IS NOT NULL), ',')
      ELSE '' END AS risk_flags
  FROM m3
)"""


_KEPT = f"WITH {_NORM}, {label_sql('norm')}, kept AS (SELECT * FROM labelled WHERE ok OR force_classify)"
_ROUTED = f"""{_KEPT},
r1 AS (
  SELECT *, {K.registrable('host')} AS reg,
    ok AND coalesce(l_type IN ('saas_trial', 'relay') AND (coalesce(currency = 'USD', false) OR coalesce(unit = 'usd', false)) AND amount > 1000, false) AS implausible
  FROM kept
),
routed AS (
  SELECT *, coalesce({K.in_list('reg', lx.BLOCKED_DOMAINS)}, false) AND NOT model_release AS blocked,
    CASE WHEN ok AND NOT implausible AND confidence >= 0.4 AND host IS NOT NULL THEN 'offer'
         WHEN model_release AND url IS NOT NULL THEN 'model_release'
         WHEN service_candidate AND host IS NOT NULL THEN 'candidate' ELSE 'signal' END AS route
  FROM r1
),
keyed AS (
  SELECT *, CASE WHEN route IN ('offer', 'candidate') THEN reg WHEN route = 'model_release' THEN 'hf/' || lower(org) END AS service_key,
    CASE WHEN route = 'offer' THEN l_type WHEN route = 'model_release' THEN 'model_release' END AS offer_type,
    coalesce('=' || source_url, '#' || CAST(ingest_seq AS VARCHAR)) AS loc
  FROM routed
),
stored AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, loc ORDER BY ingest_seq) AS rn FROM keyed WHERE NOT blocked)
  WHERE rn = 1
)"""
_SERVICES = """
seen AS (
  SELECT service_key AS canonical_domain, ingest_seq,
    CASE WHEN route = 'model_release' THEN service_key[4:] ELSE service_key END AS nm,
    CASE WHEN route = 'model_release' THEN 'model_release' ELSE l_type END AS type,
    CASE WHEN route <> 'model_release' THEN nullif(models, '') END AS models,
    CASE WHEN route = 'model_release' THEN 'active' ELSE 'new' END AS status
  FROM stored WHERE service_key IS NOT NULL
),
svc AS (
  SELECT canonical_domain, nm AS name, type, models, status FROM (
    SELECT *, row_number() OVER (PARTITION BY canonical_domain ORDER BY ingest_seq) AS k FROM seen) WHERE k = 1
)"""
_KNOWN = f"""{V.SERVICES_SQL},
known AS (
  SELECT canonical_domain, name, type, status FROM (
    SELECT {K.registrable(K.canonical('canonical_domain'))} AS canonical_domain, id,
           first_value(name) OVER w AS name, type, status,
           row_number() OVER w AS k
    FROM services WINDOW w AS (PARTITION BY {K.registrable(K.canonical('canonical_domain'))} ORDER BY id)) WHERE k = 1
)"""
_FIRST = "arg_min({c}, seq) FILTER (WHERE {ok})"


def _offers_sql(observations: str) -> str:
    first = {
        "amount": "coalesce(amount, 0) <> 0", "models": "coalesce(models, '') <> ''", "currency": "coalesce(currency, '') <> ''",
        "claim_steps": "coalesce(claim_steps, '') <> ''", "url": "coalesce(url, '') <> ''", "effort": "effort IS NOT NULL",
        "unit": "unit IS NOT NULL", "topic": "topic IS NOT NULL",
    }
    cols = ", ".join(f"arg_min({c}, seq) FILTER (WHERE {ok}) AS {c}" for c, ok in first.items())
    return f"""
obs AS ({observations}),
merged AS (
  SELECT canonical_domain, type, {cols}, arg_min(referral_required, seq) AS referral_required,
    count(*) FILTER (WHERE seq >= 0 AND NOT release) > CASE WHEN min(seq) < 0 THEN 0 ELSE 1 END AS seen_again
  FROM obs GROUP BY canonical_domain, type, release_url
)
SELECT canonical_domain, type, amount, currency, models, claim_steps, referral_required, effort, unit, topic, url, seen_again
FROM merged"""


_OBS = """
  SELECT service_key AS canonical_domain, offer_type AS type, ingest_seq AS seq, route = 'model_release' AS release,
    CASE WHEN route = 'model_release' THEN url END AS release_url, url,
    CASE WHEN route = 'offer' THEN amount END AS amount, CASE WHEN route = 'offer' THEN currency END AS currency,
    CASE WHEN route = 'offer' THEN models END AS models, CASE WHEN route = 'model_release' THEN model_id END AS claim_steps,
    CASE WHEN route = 'offer' THEN referral_required ELSE false END AS referral_required,
    CASE WHEN route = 'offer' THEN effort END AS effort, CASE WHEN route = 'offer' THEN unit END AS unit,
    CASE WHEN route = 'offer' THEN topic END AS topic
  FROM stored WHERE route IN ('offer', 'model_release')"""
_OBS_KNOWN = """
  SELECT canonical_domain, CASE WHEN length(canonical_domain) % 2 = 0 THEN 'saas_trial' ELSE 'relay' END AS type, -1 AS seq,
    false AS release, NULL AS release_url, 'https://kept.example' AS url, 0.0 AS amount, '' AS currency, NULL AS models,
    NULL AS claim_steps, false AS referral_required, 'hard' AS effort, NULL AS unit, NULL AS topic FROM known"""
_TLD = "(?:ai|io|com|net|org|dev|app|co|in|xyz|gg|sh|me|cloud|tech|so|chat|run|top|pro|cc)"
_BARE = rf"(?i)(?:^|[^0-9a-z_\pL\pN@])((?:[a-z0-9]{{2}}[a-z0-9-]{{0,60}}[a-z0-9]\.)+{_TLD})(?:$|[^0-9a-z_\pL\pN])"
_EDGE = r"(?:^|[^0-9A-Za-z_\pL\pN])"
_HINT = (
    _EDGE + r"(?:ai|llm|api|gpt|claude|gemini|deepseek|qwen|glm|kimi|grok|llama|mistral|model|tokens?|credits?|free|trial|"
    r"promo|voucher|coupon|tier)(?:$|[^0-9A-Za-z_\pL\pN])|ключ|кредит|бесплат|триал|промокод|额度|免费|注册送|中转"
)
_NEAR = (
    _EDGE + r"(?:free|trial|promo|voucher|coupon|credits?|discount|offer|bonus|gift)(?:$|[^0-9A-Za-z_\pL\pN])"
    r"|[0-9A-Za-z_\pL\pN]\$\d(?:$|[^0-9A-Za-z_\pL\pN])|注册送|免费|额度|бесплатн|кредит|триал"
)
def _harvest(norm: str, hint: str) -> str:
    return f"""WITH {norm},
mention AS (
  SELECT *, list_concat(domains, list_transform(regexp_extract_all(raw_text, {K.quoted(_BARE)}, 1), lambda d: lower(d))) AS all_hosts
  FROM norm WHERE regexp_matches(raw_text, {K.quoted(hint)})
),
hosts1 AS (SELECT *, {_ORDERED.format(l='all_hosts')} AS uniq FROM mention),
hosts2 AS (SELECT source, ingest_seq, raw_text, unnest(range(len(uniq))) AS pos, unnest(uniq) AS mhost FROM hosts1),
hosts3 AS (
  SELECT *, {K.registrable(K.canonical('mhost'))} AS domain, strpos(lower(raw_text), mhost) AS at1 FROM hosts2
),
hosts4 AS (
  SELECT *, at1 > 0 AND regexp_matches(substring(raw_text, greatest(at1 - 100, 1),
      least(length(raw_text), at1 - 1 + length(mhost) + 100) - greatest(at1 - 101, 0)), {K.quoted('(?i)' + _NEAR)}) AS high
  FROM hosts3 WHERE domain IS NOT NULL AND NOT ({K.in_list('domain', lx.BLOCKED_DOMAINS)})
),
harvest AS (
  SELECT domain, arg_min(source, ingest_seq * 1000 + pos) AS first_source, count(*) AS mentions,
         CASE WHEN bool_or(high) THEN 'high' ELSE 'normal' END AS priority
  FROM hosts4 GROUP BY domain
)"""


_HARVEST = _harvest(_NORM, "(?i)" + _HINT)
_NAMED = """seen_first AS (
  SELECT source, loc, min(ingest_seq) FILTER (WHERE NOT blocked) AS first_seq FROM keyed GROUP BY 1, 2
),
outcome AS (
  SELECT k.*, coalesce(first_seq < ingest_seq, false) AS dup FROM keyed k JOIN seen_first USING (source, loc)
)"""
_OUTCOMES = f"""count(*) AS classified, count(*) FILTER (WHERE is_offer) AS offers, count(*) FILTER (WHERE dup) AS dup,
  count(*) FILTER (WHERE NOT dup AND blocked) AS blocked, count(*) FILTER (WHERE NOT dup AND NOT blocked) AS signals,
  count(*) FILTER (WHERE NOT dup AND NOT blocked AND implausible) AS implausible,
  count(*) FILTER (WHERE NOT dup AND NOT blocked AND route = 'candidate') AS candidates"""

ORACLE = {
    "posts_normalized": f"WITH {_NORM} SELECT ingest_seq, lang, url, array_to_string(domains, ',') AS domains FROM norm",
    "posts_registrable": f"""WITH {_NORM}, {V.SERVICES_SQL},
hosts AS (SELECT host FROM norm WHERE host IS NOT NULL UNION SELECT canonical_domain FROM services),
c AS (SELECT host, {K.registrable(K.canonical('host'))} AS registrable FROM hosts)
SELECT host, registrable, {K.in_list('registrable', lx.BLOCKED_DOMAINS)} AS blocked FROM c""",
    "posts_labels": f"""{_KEPT}
SELECT ingest_seq, array_to_string(h, ',') AS hits, is_offer, service_name, l_type AS offer_type, amount, currency, models,
  referral_required, effort, unit, topic, confidence, requires_card, requires_phone, new_users_only, region, risk_flags
FROM kept""",
    "posts_routes": f"{_ROUTED} SELECT ingest_seq, blocked, implausible, route, service_key, offer_type FROM keyed",
    "posts_stored": f"""{_ROUTED}
SELECT source, source_url, url, md5(raw_text) AS digest, lang, confidence, route IN ('offer', 'model_release') AS has_offer,
  service_key IS NOT NULL AS has_service FROM stored""",
    "posts_outcomes": f"{_ROUTED}, {_NAMED} SELECT {_OUTCOMES} FROM outcome",
    "posts_counters": f"""{_ROUTED}, {_NAMED},
harvest_n AS ({_HARVEST} SELECT count(*) AS harvested FROM hosts4),
created AS (SELECT count(DISTINCT service_key || '|' || offer_type) FILTER (WHERE route = 'offer') AS offers_created,
                   count(DISTINCT service_key || '|' || url) FILTER (WHERE route = 'model_release') AS model_releases,
                   count(*) FILTER (WHERE route = 'offer') AS observed FROM stored)
SELECT (SELECT count(*) FROM labelled) AS seen, (SELECT count(*) FROM labelled WHERE NOT (ok OR force_classify)) AS prefiltered_out,
  {_OUTCOMES}, any_value(offers_created) AS offers_created, any_value(model_releases) AS model_releases,
  any_value(harvested) AS harvested, any_value(observed) - any_value(offers_created) AS offers_updated
FROM outcome, created, harvest_n""",
    "posts_services": f"{_ROUTED}, {_SERVICES} SELECT * FROM svc",
    "posts_services_merged": f"""{_ROUTED}, {_SERVICES}, {_KNOWN}
SELECT * FROM known UNION ALL
SELECT canonical_domain, name, type, status FROM svc WHERE canonical_domain NOT IN (SELECT canonical_domain FROM known)""",
    "posts_aliases": f"""{_ROUTED}
SELECT service_key AS canonical_domain, host, min(ingest_seq) AS first_seq FROM stored
WHERE route IN ('offer', 'candidate') AND host <> service_key GROUP BY 1, 2""",
    "posts_offers": f"{_ROUTED}, {_offers_sql(_OBS)}",
    "posts_offers_merged": f"{_ROUTED}, {_KNOWN}, {_offers_sql(_OBS + ' UNION ALL BY NAME ' + _OBS_KNOWN)}",
    "posts_lead_metrics": f"""{_ROUTED}
SELECT canonical_domain, type, {K.steady(K.hours('agg', 'us'), 2)} AS lead_hours FROM (
  SELECT service_key AS canonical_domain, offer_type AS type, min(observed_at) FILTER (WHERE source <> 'telegram') AS us,
         min(observed_at) FILTER (WHERE source = 'telegram') AS agg FROM stored WHERE route = 'offer' GROUP BY 1, 2)""",
    "posts_harvest": f"{_HARVEST} SELECT domain, first_source, mentions, priority FROM harvest",
    "harvested_from_documents": f"""{_harvest(_norm(V.MENTIONS_SQL), TEST_HINT)}
SELECT domain, first_source, mentions, priority FROM harvest""",
    "posts_candidates": f"""{_HARVEST}, {V.SERVICES_SQL},
seeded AS (SELECT DISTINCT {K.registrable(K.canonical('canonical_domain'))} AS domain FROM services)
SELECT coalesce(s.domain, h.domain) AS domain, CASE WHEN s.domain IS NOT NULL THEN 'seed' ELSE h.first_source END AS first_source,
  coalesce(h.priority, 'normal') AS priority, 'pending' AS status, 0 AS attempts
FROM seeded s FULL JOIN harvest h USING (domain)""",
    "relabelled_offers": f"""WITH {V.POSTS_SQL}, {V.OFFERS_SQL}, {V.SERVICES_SQL},
best AS (
  SELECT service_id, raw_text FROM (
    SELECT o_custkey AS service_id, raw_text, row_number() OVER (PARTITION BY o_custkey ORDER BY length(raw_text) DESC, ingest_seq) AS k
    FROM posts JOIN orders ON o_orderkey = ingest_seq) WHERE k = 1
),
inputs AS (
  SELECT o.id, b.raw_text, lower(b.raw_text) AS low, 'https://' || s.canonical_domain AS url, s.canonical_domain AS host,
         {_LANG.format(t='b.raw_text')} AS lang
  FROM offers o JOIN services s ON s.id = o.service_id JOIN best b ON b.service_id = o.service_id
),
{label_sql('inputs')},
new AS (
  SELECT o.id, l.ok AND o.effort = 'easy' AS ext, l.* EXCLUDE (id) FROM offers o JOIN labelled l ON l.id = o.id
),
lab AS (
  SELECT id, CASE WHEN ext THEN id % 4 <> 0 ELSE ok END AS use,
    CASE WHEN ext THEN CASE WHEN id % 3 = 0 THEN 'grant' ELSE 'other' END ELSE l_type END AS n_type,
    CASE WHEN ext THEN CAST(id % 7000 AS DOUBLE) ELSE amount END AS n_amount, CASE WHEN NOT ext THEN currency END AS n_currency,
    CASE WHEN ext THEN 'credits' ELSE unit END AS n_unit,
    CASE WHEN ext THEN CASE WHEN id % 2 = 0 THEN 'easy' END ELSE effort END AS n_effort, CASE WHEN NOT ext THEN topic END AS n_topic,
    CASE WHEN ext THEN false ELSE referral_required END AS n_ref, CASE WHEN ext THEN 'gpt' ELSE nullif(models, '') END AS n_models,
    CASE WHEN ext THEN true ELSE requires_card END AS n_card, CASE WHEN NOT ext THEN region END AS n_region,
    CASE WHEN ext THEN 'vpn' ELSE risk_flags END AS n_risks
  FROM new
)
SELECT o.id, coalesce(n_type, o.type) AS type, coalesce(CASE WHEN n_amount <= 5000 THEN n_amount END, o.amount) AS amount,
  coalesce(n_currency, o.currency) AS currency, coalesce(n_unit, o.unit) AS unit, coalesce(n_effort, o.effort) AS effort,
  coalesce(n_topic, o.topic) AS topic, coalesce(n_ref, o.referral_required) AS referral_required,
  coalesce(n_models, array_to_string(o.models, ',')) AS models, n_card AS requires_card, n_region AS region, n_risks AS risk_flags
FROM offers o LEFT JOIN lab ON lab.id = o.id AND lab.use""",
}
ORACLE["ingest_counters"] = ORACLE["posts_counters"]
ORACLE["appended_signals"] = ORACLE["posts_stored"]
