"""Web pages: domains, titles, text, links and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import kit as K
from checks import views as V
from leadlens import lexicon as lx
from leadlens.functions import domains as D
from leadlens.functions import html as H
from leadlens.functions import pagefacts as P
from leadlens.operators import candidates as C
from leadlens.operators import enrich as E
from leadlens.session import checkpointed
from leadlens.sources import html_links as HL


def _pages(spark, sf):
    return V.text_table(spark, sf, "pages")


def page_domains(spark, sf):
    u = F.col("url")
    return _pages(spark, sf).select(
        "page_id", D.canonical_domain(u).alias("domain"), D.registrable_domain(u).alias("registrable"),
        D.host_without_www(u).alias("host"), D.is_blocked(u).alias("blocked"),
        D.safe_to_probe(D.canonical_domain(u)).alias("safe"), D.has_subdomain_signal(D.canonical_domain(u)).alias("signal_label"),
    )


def page_titles(spark, sf):
    return _pages(spark, sf).select("page_id", H.title(F.col("html")).alias("title"))


def page_text(spark, sf):
    """Visible text of whole pages, without a cap."""
    return _pages(spark, sf).select("page_id", F.md5(H.visible_text(F.col("html"), None)).alias("digest"))


def page_descriptions(spark, sf):
    """Descriptions; every second page gets a meta tag made from its URL, in one of the two attribute orders."""
    tag = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<meta name='description' content='About the site "), "url", F.lit("'>")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit('<META content="Q &amp; A  for '), "url", F.lit('" property="og:description">')))
        .otherwise("")
    )
    page = F.concat(tag, F.col("html"))
    return _pages(spark, sf).select("page_id", H.description(page).alias("description"))


def page_links(spark, sf):
    """Every link of every page, resolved against the page URL."""
    rows = HL.page_links(V.page_payloads(spark, sf))
    return rows.select(F.col("payload_id").alias("page_id"), F.col("pos")[0].alias("pos"), F.col("item.href").alias("href"), F.col("item.text").alias("text"))


def page_link_rows(spark, sf):
    """The same links by a table function, row by row."""
    rows = HL.page_link_rows(V.page_payloads(spark, sf))
    return rows.select(F.col("payload_id").alias("page_id"), "pos", "href", "text")


def page_fact_columns(spark, sf):
    """Models, credit amount, engine and offer wording read off whole page texts with numbers and names added."""
    extra = F.concat(
        F.lit(" sign up for "), F.when(F.col("page_id") % 2 == 0, "$").otherwise(""), (F.col("page_id") * 37 % 7000).cast("string"),
        F.lit(" credits free, was $"), (F.col("page_id") * 11 % 900).cast("string"), F.lit(" with GPT-4o and egypt o1x "),
        F.when(F.col("page_id") % 3 == 0, "powered by New-API").when(F.col("page_id") % 3 == 1, "songquanpeng").otherwise("kimi glm-4"),
    )
    text = F.concat(F.regexp_replace("html", r"[0-9$]", ""), extra)
    return _pages(spark, sf).select("page_id", text.alias("text")).select(
        "page_id",
        F.array_join(P.detect_models(F.col("text")), ",").alias("models"),
        P.detect_amount(F.col("text")).alias("amount"),
        P.detect_engine(F.col("text")).alias("engine"),
        P.has_pricing_trigger(F.col("text")).alias("trigger"),
    )


_PATHS = ("/", "/pricing", "/plans", "/billing", "/api/status", "/v1/models", "/api/notice", "/sitemap.xml")


def page_bodies(spark, sf):
    """pages as landed page bodies: eight consecutive pages are the paths of one site."""
    path = F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.col("page_id") % len(_PATHS) + 1).cast("int"))
    site = F.floor(F.col("page_id") / len(_PATHS)).cast("string")
    mark = (
        F.when((path == "/") & (F.col("page_id") % 5 == 1), "<title> One API </title>")
        .when((path == "/") & (F.col("page_id") % 5 == 2), '<meta name="description" content="Home of  Sub2API &amp; friends, with GLM">')
        .otherwise("")
    )
    offer = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<p>free trial with Claude and $"), F.col("page_id").cast("string"), F.lit(" credits</p>"))).otherwise("")
    body = (
        F.when(path == "/api/status", F.lit('{"data": {"version": "1"}}'))
        .when(path == "/v1/models", F.concat(F.lit('{"data": [{"id": "qwen-'), F.col("page_id").cast("string"), F.lit('"}]}')))
        .when(path == "/sitemap.xml", F.concat(F.lit("<loc>https://x/billing</loc> "), F.col("html")))
        .otherwise(F.concat(mark, offer, F.regexp_replace("html", r"\$", "")))
    )
    json = path.isin("/api/status", "/v1/models")
    return _pages(spark, sf).select(
        F.concat(F.lit("site"), site, F.lit(".ai")).alias("domain"),
        path.alias("path"),
        F.when(F.col("page_id") % 7 == 3, 404).when(F.col("page_id") % 29 == 0, 503).otherwise(200).alias("status"),
        F.when(json, "application/json").otherwise("text/html").alias("content_type"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        body.alias("body"),
    )


def page_facts(spark, sf):
    """Facts per site from all its pages."""
    out = E.page_facts(page_bodies(spark, sf))
    return out.withColumns({"models": F.array_join("models", ","), "description": F.md5("description"), "notice": F.md5("notice")})


def page_facts_refreshed(spark, sf):
    """The same facts after a second landing: every third page had another text at the first, the others are not read again."""
    now = page_bodies(spark, sf)
    before = now.withColumn("body", F.when(F.length("body") % 3 == 0, F.concat("body", F.lit(" free trial: $4999 kimi"))).otherwise(F.col("body")))
    first = checkpointed(E.page_rows(before))
    out = E.facts_of(checkpointed(E.page_rows(now, first)))
    return out.withColumns({"models": F.array_join("models", ","), "description": F.md5("description"), "notice": F.md5("notice")})


def promotable_sites(spark, sf):
    f = E.page_facts(page_bodies(spark, sf))
    c = F.col
    gate = C.should_promote(c("alive"), c("models"), c("engine"), c("is_relay"), c("pricing_triggers"), c("amount"), c("has_pricing"))
    return f.select("domain", gate.alias("promote"))


def sitemap_offer_urls(spark, sf):
    """Offer URLs of a sitemap and Sitemap lines of a robots file, both derived from the pages' URLs."""
    u = F.col("url")
    sitemap = F.concat(
        F.lit("<urlset><url><loc> "), u, F.lit(" </loc></url><url><LOC>https://a.b/Pricing?x=1</LOC></url><loc>https://free.b/about</loc><loc>"),
        u, F.lit("/trial</loc></urlset>"),
    )
    robots = F.concat(F.lit("User-agent: *\n  sitemap:  "), u, F.lit(" \r\nDisallow: /x\nSitemap:https://s.t/m.xml"))
    return _pages(spark, sf).select(
        "page_id", F.array_join(P.offer_urls(sitemap), " ").alias("urls"), F.array_join(P.sitemap_lines(robots), " ").alias("maps")
    )


def linkgraph_edges(spark, sf):
    """Outbound registrable domains of every page with partner links added to its text."""
    body = F.concat(
        F.col("html"), F.lit(" see https://docs.partner"), (F.col("page_id") % 90).cast("string"), F.lit(".co.uk/x, (http://www.P"),
        (F.col("page_id") % 7).cast("string"), F.lit(".ai) and "), F.col("url"),
    )
    p = _pages(spark, sf).select(D.canonical_domain(F.col("url")).alias("domain"), body.alias("body"))
    return C.outbound_domains(p)


QUERIES = {
    f.__name__: f
    for f in (
        page_domains, page_titles, page_text, page_descriptions, page_links, page_fact_columns, page_facts, page_facts_refreshed, page_link_rows,
        promotable_sites, sitemap_offer_urls, linkgraph_edges,
    )
}

# ------------------------------------------------------------------ SQL
_ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescaped(column: str) -> str:
    for entity, char in _ENTITIES:
        column = f"replace({column}, {K.quoted(entity)}, {K.quoted(char)})"
    return column


# RE2 has no back-references: script and style are removed one after the other.
_NO_SCRIPT = r"regexp_replace(regexp_replace({c}, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g')"


def visible(column: str) -> str:
    text = unescaped(rf"regexp_replace({_NO_SCRIPT.format(c=column)}, '<[^>]+>', ' ', 'g')")
    return rf"trim(regexp_replace({text}, '[\s\x{{a0}}\x{{85}}\x{{2028}}]+', ' ', 'g'))"


_NEAR = "list_bool_or(list_transform([{words}], lambda w: contains({window}, w)))"
_FACT_TEXT = """regexp_replace(html, '[0-9$]', '', 'g') || ' sign up for ' || CASE WHEN page_id % 2 = 0 THEN '$' ELSE '' END
  || CAST(page_id * 37 % 7000 AS VARCHAR) || ' credits free, was $' || CAST(page_id * 11 % 900 AS VARCHAR)
  || ' with GPT-4o and egypt o1x ' || CASE page_id % 3 WHEN 0 THEN 'powered by New-API' WHEN 1 THEN 'songquanpeng' ELSE 'kimi glm-4' END"""
# Q is the quoted number as the page pattern reads it: up to three digits, then groups of three.
_FIRST_NUMBER = "page_id * 37 % 7000"
_SECOND_NUMBER = "page_id * 11 % 900"

def _page_amounts(text: str, pattern: str) -> str:
    """List of the plausible amounts of one pattern with an offer word close by; matches are found in text order, so their
    places follow from the lengths of the pieces between them."""
    p = K.quoted(pattern.replace("(?iU)", "(?i)").replace("(?U)", ""))
    whole, number, pieces = f"regexp_extract_all({text}, {p}, 0)", f"regexp_extract_all({text}, {p}, 1)", f"string_split_regex({text}, {p})"
    at = (f"list_sum(list_transform({pieces}[1:i], lambda s: length(s))) + "
          f"coalesce(list_sum(list_transform({whole}[1:i - 1], lambda s: length(s))), 0)")
    around = f"lower({text}[CAST(greatest({at} - {lx.PAGE_AMOUNT_WINDOW}, 0) AS BIGINT) + 1:CAST({at} AS BIGINT) + length({whole}[i]) + {lx.PAGE_AMOUNT_WINDOW}])"
    value = f"TRY_CAST(regexp_replace({number}[i], '[, ]', '', 'g') AS DOUBLE)"
    low, high = lx.PAGE_AMOUNT_RANGE
    words = ", ".join(map(K.quoted, lx.PAGE_AMOUNT_TRIGGERS))
    fits = f"{value} BETWEEN {low} AND {high} AND {_NEAR.format(words=words, window=around)}"
    return f"list_transform(range(1, len({whole}) + 1), lambda i: CASE WHEN {fits} THEN {value} END)"


_MODEL_NAMES = list(dict.fromkeys(v for _, v in (*lx.PAGE_MODEL_TOKENS, *lx.PAGE_MODEL_BOUNDED)))


def _names(label: str) -> str:
    plain = [f"contains(low, {K.quoted(t)})" for t, v in lx.PAGE_MODEL_TOKENS if v == label]
    bounded = [f"regexp_matches(low, {K.quoted('(^|[^a-z])' + t + '($|[^a-z])')})" for t, v in lx.PAGE_MODEL_BOUNDED if v == label]
    return f"bool_or({' OR '.join(plain + bounded)})"


_PATH_LIST = ", ".join(map(K.quoted, _PATHS))
_KNOWN_PATHS = ", ".join(map(K.quoted, (*lx.OFFER_PATHS_PRIMARY, *lx.OFFER_PATHS_SECONDARY)))
_META = r"""(?is)<meta[^>]+(?:name|property)\s*=\s*["'](?:description|og:description)["'][^>]*content\s*=\s*["'](.*?)["']"""
_TRIGGERED = K.any_word("{c}", lx.PRICING_TRIGGERS)
_SITES = f"""WITH raw AS (
  SELECT page_id, html, [{_PATH_LIST}][page_id % {len(_PATHS)} + 1] AS path, 'site' || CAST(page_id // {len(_PATHS)} AS VARCHAR) || '.ai' AS domain,
    CASE WHEN page_id % 7 = 3 THEN 404 WHEN page_id % 29 = 0 THEN 503 ELSE 200 END AS status FROM pages
),
landed AS (
  SELECT domain, path, status, CASE path WHEN '/api/status' THEN '{{"data": {{"version": "1"}}}}'
      WHEN '/v1/models' THEN '{{"data": [{{"id": "qwen-' || CAST(page_id AS VARCHAR) || '"}}]}}'
      WHEN '/sitemap.xml' THEN '<loc>https://x/billing</loc> ' || html
      ELSE CASE WHEN path = '/' AND page_id % 5 = 1 THEN '<title> One API </title>'
                WHEN path = '/' AND page_id % 5 = 2 THEN '<meta name="description" content="Home of  Sub2API &amp; friends, with GLM">' ELSE '' END
        || CASE WHEN page_id % 3 = 0 THEN '<p>free trial with Claude and $' || CAST(page_id AS VARCHAR) || ' credits</p>' ELSE '' END
        || replace(html, '$', '') END AS body
  FROM raw
),
kept AS (SELECT domain, path, status, status = 200 AS ok, CASE WHEN status < 400 THEN body ELSE '' END AS body FROM landed),
read AS (
  SELECT *, lower(body) AS page_low, {visible('body')} AS text,
    CASE WHEN regexp_matches(body, '(?is)<title[^>]*>(.*?)</title>')
         THEN trim(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1))[1:200] END AS title,
    trim(regexp_replace({unescaped(f"regexp_extract(body, {K.quoted(_META)}, 1)")}, '\\s+', ' ', 'g')) AS told,
    list_position([{_KNOWN_PATHS}], path) AS known, path IN ('{lx.RELAY_STATUS_PATH}', '{lx.RELAY_MODELS_PATH}', '{lx.RELAY_NOTICE_PATH}') AS gateway
  FROM kept
),
described AS (
  SELECT *, CASE WHEN length(told) > 20 THEN told[1:300] WHEN length(text[1:400]) > 40 THEN text[1:280] END AS description,
    path <> '/' AND NOT gateway AND ok AND NOT regexp_matches(path, '(?i)^/robots\\.txt$|\\.xml(\\.gz)?$') AS other
  FROM read
),
listed AS (SELECT DISTINCT domain, '/billing' AS path, true AS on_map FROM described WHERE path = '/sitemap.xml' AND ok),
own AS (
  SELECT d.*, other AND (known > 0 OR on_map IS NOT NULL OR regexp_matches(d.path, {K.quoted(lx.OFFER_URL_PATTERN)})) AS offer,
    CASE WHEN d.path = '{lx.RELAY_NOTICE_PATH}' AND ok AND text <> '' THEN text END AS notice,
    CASE WHEN d.path = '{lx.RELAY_MODELS_PATH}' AND ok THEN regexp_extract_all(body, '"id": "([^"]*)"', 1) END AS ids,
    CASE WHEN lower(title) = 'new api' THEN 'new-api' WHEN lower(title) = 'one api' THEN 'one-api' WHEN lower(title) = 'sub2api' THEN 'sub2api'
         ELSE {K.first_label('page_low', lx.ENGINE_MARKS)} END AS engine
  FROM described d LEFT JOIN listed USING (domain, path)
),
facts AS (
  SELECT *, lower(blob) AS low FROM (
    SELECT *, CASE WHEN path = '/' THEN coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(text, '')
                   WHEN other THEN coalesce(description, '') || ' ' || coalesce(text, '')
                   ELSE coalesce(notice, array_to_string(ids, ' '), '') END AS blob
    FROM own WHERE path = '/' OR gateway OR known > 0 OR other)
),
amounts AS (
  SELECT *, list_max(list_concat({", ".join(_page_amounts('blob', p) for p in lx.PAGE_AMOUNT_PATTERNS)})) AS amount FROM facts
),
site AS (
  SELECT domain, max(status) FILTER (WHERE path = '/') AS status, max(title) FILTER (WHERE path = '/') AS title,
    max(engine) FILTER (WHERE path = '/') AS engine, coalesce(bool_or(offer), false) AS has_pricing,
    coalesce(bool_or(offer AND ok AND {_TRIGGERED.format(c='page_low')}), false) AS trigger, max(notice) AS notice,
    coalesce(bool_or(coalesce(path = '{lx.RELAY_STATUS_PATH}' AND ok, false) OR coalesce(len(ids) > 0, false)), false) AS is_relay,
    arg_min(description, CASE WHEN path = '/' THEN 0 WHEN known > 0 THEN known ELSE 9 END) FILTER (WHERE description <> '' AND (path = '/' OR other)) AS description,
    list_filter([{", ".join(f"CASE WHEN {_names(v)} THEN {K.quoted(v)} END" for v in _MODEL_NAMES)}], lambda m: m IS NOT NULL) AS models,
    max(amount) AS amount
  FROM amounts GROUP BY domain
),
site_facts AS (
  SELECT domain, coalesce(status < 500, false) AS alive, status, title, coalesce(engine, CASE WHEN is_relay THEN 'relay' END) AS engine,
    has_pricing, trigger OR coalesce({_TRIGGERED.format(c='lower(notice)')}, false) AS pricing_triggers, description, models, amount, is_relay,
    CASE WHEN {_TRIGGERED.format(c='lower(notice)')} THEN notice[1:300] END AS notice
  FROM site
)"""

ORACLE = {
    "page_facts": f"""{_SITES}
SELECT * REPLACE (array_to_string(models, ',') AS models, md5(description) AS description, md5(notice) AS notice) FROM site_facts""",
    "promotable_sites": f"""{_SITES}
SELECT domain, alive AND (len(models) > 0 OR engine IS NOT NULL OR is_relay)
  AND (is_relay OR pricing_triggers OR amount IS NOT NULL OR has_pricing) AS promote FROM site_facts""",
    "page_domains": f"""WITH c AS (SELECT page_id, url, {K.canonical('url')} AS domain FROM pages),
d AS (SELECT *, {K.registrable('domain')} AS registrable FROM c)
SELECT page_id, domain, registrable, replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), 'www.', '') AS host,
  {K.in_list('registrable', lx.BLOCKED_DOMAINS)} AS blocked, contains(domain, '.') AS safe,
  {' OR '.join(f"starts_with(domain, '{p}')" for p in lx.SUBDOMAIN_SIGNALS)} AS signal_label FROM d""",
    "page_titles": r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))[1:200] AS title FROM pages",
    "page_text": f"SELECT page_id, md5({visible('html')}) AS digest FROM pages",
    "page_descriptions": f"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN ('About the site ' || url)[1:300] WHEN 2 THEN ('Q & A for ' || url)[1:300]
  ELSE CASE WHEN length({visible('html')}[1:400]) > 40 THEN {visible('html')}[1:280] END END AS description FROM pages""",
    "page_links": f"""
WITH l AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs,
                  regexp_extract_all(html, '<a href="[^"]*">(.*?)</a>', 1) AS texts FROM pages),
x AS (SELECT page_id, url, CAST(unnest(range(len(hrefs))) AS INTEGER) AS pos, unnest(hrefs) AS href, unnest(texts) AS text FROM l)
SELECT page_id, pos, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || {unescaped('href')} AS href, {unescaped('text')} AS text FROM x""",
    "page_fact_columns": f"""
WITH t AS (SELECT *, {_FACT_TEXT} AS text, lower({_FACT_TEXT}) AS low, {_FIRST_NUMBER} AS a, {_SECOND_NUMBER} AS b FROM pages),
n AS (
  SELECT *, CAST(a AS VARCHAR) AS s,
    CASE WHEN page_id % 2 = 0 THEN CASE WHEN a >= 1000 THEN CAST(CAST(a AS VARCHAR)[1:3] AS BIGINT) ELSE a END END AS usd1,
    CASE WHEN a >= 10 THEN a END AS credit1
  FROM t
),
lab AS (
  SELECT page_id, list_filter([{', '.join(f"CASE WHEN contains(low, {K.quoted(t)}) THEN {K.quoted(v)} END" for t, v in lx.PAGE_MODEL_TOKENS)},
    {', '.join(f"CASE WHEN regexp_matches(low, {K.quoted('(^|[^a-z])' + t + '($|[^a-z])')}) THEN {K.quoted(v)} END" for t, v in lx.PAGE_MODEL_BOUNDED)}],
    lambda m: m IS NOT NULL) AS m, low, usd1, credit1, b FROM n
)
SELECT page_id, array_to_string({'list_filter(m, lambda x, i: list_position(m, x) = i)'}, ',') AS models,
  CAST(greatest(CASE WHEN usd1 BETWEEN 1 AND 5000 THEN usd1 END, CASE WHEN credit1 BETWEEN 1 AND 5000 THEN credit1 END,
           CASE WHEN b BETWEEN 1 AND 5000 THEN b END) AS DOUBLE) AS amount,
  {K.first_label('low', lx.ENGINE_MARKS)} AS engine, {K.any_word('low', lx.PRICING_TRIGGERS)} AS trigger
FROM lab""",
    "sitemap_offer_urls": """
WITH c AS (SELECT page_id, url, regexp_matches(regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '[?#].*$', ''),
                 '(?i)pricing|plans|billing|subscribe|redeem|promo|coupon|trial|credits|free') AS own,
                 NOT regexp_matches(url, '[?#]') AS plain FROM pages)
SELECT page_id, concat_ws(' ', CASE WHEN own THEN url END, 'https://a.b/Pricing?x=1', CASE WHEN own OR plain THEN url || '/trial' END) AS urls,
  url || ' https://s.t/m.xml' AS maps FROM c""",
    "linkgraph_edges": f"""
WITH p AS (SELECT {K.canonical('url')} AS domain, page_id, url FROM pages),
e AS (SELECT domain, 'docs.partner' || CAST(page_id % 90 AS VARCHAR) || '.co.uk' AS host FROM p
      UNION ALL SELECT domain, 'p' || CAST(page_id % 7 AS VARCHAR) || '.ai' FROM p UNION ALL SELECT domain, domain FROM p),
r AS (SELECT DISTINCT domain, {K.registrable('host')} AS target, {K.registrable('domain')} AS own FROM e)
SELECT domain, target FROM r WHERE target <> own""",
}
ORACLE["page_facts_refreshed"] = ORACLE["page_facts"]
ORACLE["page_link_rows"] = ORACLE["page_links"]
