"""Payload parsers over payload documents derived from the tables, one or two items per row."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import kit as K
from checks import views as V
from leadlens import lexicon as lx
from leadlens.functions import domains as D
from leadlens.plans import landed as landed_plan
from leadlens.sources import certificates as CT
from leadlens.sources import channel as CH
from leadlens.sources import feeds as FE
from leadlens.sources import html_links as HL
from leadlens.sources import json_hits as J
from leadlens.sources import markdown as MD
from leadlens.sources import redact as R
from leadlens.sources.common import signals as signal_rows
from leadlens.sources.registry import union_signals

c, lit = F.col, F.lit


def _s(name):
    return F.col(name).cast("string")


def _place():
    return F.array_join(F.col("place").cast("array<string>"), ",").alias("place")


def _out(df, *extra):
    return df.select("source", "raw_text", "url", "source_url", *extra)


def _orders(spark, sf, body, *more):
    o = V.text_table(spark, sf, "orders")
    return o.select(c("o_orderkey").alias("payload_id"), body.alias("body"), *more)


def _json(**fields):
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _items(*structs):
    return F.array(*[F.struct(*[v.alias(k) for k, v in s.items()]) for s in structs])


def _xml_text(text):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, lit(char), lit(entity))
    return text


# ------------------------------------------------------------------ feeds
def _feed_payloads(spark, sf):
    """documents as RSS items and Atom entries, the text as escaped markup."""
    d = V.text_table(spark, sf, "documents")
    title = F.concat(lit("Q&amp;A of &lt;b&gt;"), c("source"), lit("&lt;/b&gt;"))
    markup = _xml_text(F.concat(lit("<p class='x'>"), F.replace(_xml_text(c("text")), lit("&gt;"), lit(">")), lit("</p>")))
    link = F.concat(lit("https://docs.example/"), _s("doc_id"), lit("?a=1&amp;b=2"))
    rss = F.concat(
        lit("<?xml version='1.0'?><rss><channel><title>t</title><item><title>"), title, lit("</title><link>"), link,
        lit("</link><description>"), markup, lit("</description></item></channel></rss>"),
    )
    atom = F.concat(
        lit("<feed xmlns='http://www.w3.org/2005/Atom'><entry><title type='html'>"), title,
        lit("</title><link rel='self' href='https://self.example'/><link rel='alternate' href='"), link,
        lit("'/><summary type='html'>"), markup, lit("</summary></entry></feed>"),
    )
    return d.select(
        c("doc_id").alias("payload_id"), F.when(c("doc_id") % 2 == 0, rss).otherwise(atom).alias("body"), "source",
        c("lang").alias("feed"), lit("https://docs.example").alias("instance"),
    )


def _digest(df):
    return df.select("source", F.md5("raw_text").alias("digest"), "url", "source_url")


def feed_items(spark, sf):
    return _digest(FE.parse_feed(_feed_payloads(spark, sf)))


def feed_items_community(spark, sf):
    rows = FE.parse_feed(_feed_payloads(spark, sf), FE.COMMUNITY)
    return _digest(rows.withColumn("url", c("meta.extra")["subreddit"]))


def feed_items_launches(spark, sf):
    return _digest(FE.parse_feed(_feed_payloads(spark, sf), FE.LAUNCHES))


def feed_items_changelog(spark, sf):
    rows = FE.parse_feed(_feed_payloads(spark, sf), FE.CHANGELOG)
    return _digest(rows.withColumn("url", c("meta.extra")["feed"]))


def feed_items_mirror(spark, sf):
    return _digest(FE.parse_mirror_feed(_feed_payloads(spark, sf)))


def feed_formats(spark, sf):
    return _feed_payloads(spark, sf).select("payload_id", FE.is_feed(c("body")).alias("is_feed"), FE.is_feed(F.concat(F.repeat(lit(" "), 600), "body")).alias("late"))


def package_feed(spark, sf):
    """parts as package index entries; names of one colour family mention AI."""
    p = V.table(spark, sf, "part")
    title = F.concat(F.when(c("p_size") % 2 == 0, lit("llm ")).otherwise(lit("mailx ")), c("p_name"))
    body = F.concat(lit("<rss><channel><item><title>"), title, lit("</title><link>https://pypi.example/"), _s("p_partkey"), lit("</link></item></channel></rss>"))
    return _out(FE.parse_package_feed(p.select(c("p_partkey").alias("payload_id"), body.alias("body"))))


# ------------------------------------------------------------------ JSON
KEY, CUST = "CAST(o_orderkey AS STRING)", "CAST(o_custkey AS STRING)"


def news_hits(spark, sf):
    k, u = _s("o_orderkey"), _s("o_custkey")
    none = lit(None).cast("string")
    body = _json(
        hits=_items(
            {"title": F.concat(lit("Show "), k), "story_title": none, "url": F.concat(lit("https://a"), u, lit(".ai")), "story_url": none, "story_text": c("o_orderpriority"), "objectID": k},
            {"title": lit(""), "story_title": F.when(c("o_orderkey") % 3 == 0, c("o_orderstatus")), "url": none, "story_url": F.when(c("o_orderkey") % 5 == 0, lit("https://s.io")), "story_text": none, "objectID": none},
        )
    )
    return _out(J.parse_news_hits(_orders(spark, sf, body)))


def repo_hits(spark, sf):
    k, u = _s("o_orderkey"), _s("o_custkey")
    body = _json(
        items=_items(
            {"full_name": F.concat(lit("o/r"), k), "description": c("o_orderpriority"), "homepage": F.concat(lit("https://h"), u), "html_url": F.concat(lit("https://github.com/o/r"), k)},
            {"full_name": lit("o/none"), "description": lit(""), "homepage": lit(None).cast("string"), "html_url": lit("https://github.com/o/none")},
        )
    )
    return _out(J.parse_repo_hits(_orders(spark, sf, body)))


def _code_body():
    k, u = _s("o_orderkey"), _s("o_custkey")
    frag = F.concat(lit("base_url='https://a"), u, lit(".ai/v1' or https://b"), k, lit(".dev)"))
    match = F.array(F.struct(frag.alias("fragment")), F.struct(c("o_orderpriority").alias("fragment")), F.struct(lit("").alias("fragment")))
    return _json(items=_items({"html_url": F.concat(lit("https://g/"), k), "text_matches": match}))


def code_hits(spark, sf):
    return _out(J.parse_code_hits(_orders(spark, sf, _code_body())), _place())


def _issue_body():
    k, u = _s("o_orderkey"), _s("o_custkey")
    text = F.when(c("o_orderkey") % 3 == 0, F.concat(lit("my url https://a"), u, lit(".ai and https://b"), u, lit(".ai"))).when(c("o_orderkey") % 3 == 1, "a free trial here").otherwise("nothing")
    return _json(items=_items({"title": F.concat(lit("Issue "), k), "body": text, "html_url": F.concat(lit("https://g/"), k)}))


def issue_hits(spark, sf):
    return _out(J.parse_issue_hits(_orders(spark, sf, _issue_body())))


def landed_signals(spark, sf):
    """orders landed by four collectors; one is switched off, the others go through their registered parsers."""
    payloads, bodies = landed_payloads(spark, sf)
    off = V.table(spark, sf, "region").select(lit("twitter").alias("name"), (c("r_regionkey") > 0).alias("enabled"))
    names = [n for n in landed_plan.enabled_names(payloads, off) if n in bodies]
    return _out(landed_plan.landed_signals(payloads, names=names))


def landed_payloads(spark, sf):
    bodies = {"npm": _package_body(), "github_code": _code_body(), "github_issues": _issue_body(), "twitter": _issue_body()}
    landed = [_orders(spark, sf, body).withColumn("collector", lit(name)) for name, body in bodies.items()]
    payloads = landed[0]
    for more in landed[1:]:
        payloads = payloads.unionByName(more)
    return payloads, bodies


def web_and_video_hits(spark, sf):
    """Web hits and video hits in one frame (the union of collectors)."""
    k, u = _s("o_orderkey"), _s("o_custkey")
    web = _json(items=_items({"title": c("o_orderpriority"), "snippet": F.concat(lit("s "), k), "link": F.when(c("o_orderkey") % 2 == 0, F.concat(lit("https://w"), u))}))
    desc = F.concat(lit("see https://v"), u, lit(".ai/x and http://t.io"))
    video = _json(items=_items({"id": F.struct(F.when(c("o_orderkey") % 4 != 0, k).alias("videoId")), "snippet": F.struct(c("o_orderstatus").alias("title"), desc.alias("description"))}))
    return _out(union_signals(J.parse_web_hits(_orders(spark, sf, web)), J.parse_video_hits(_orders(spark, sf, video))))


def model_catalogue(spark, sf):
    k, u = _s("o_orderkey"), _s("o_custkey")
    body = _json(data=_items({"id": F.concat(lit("prov"), u, lit("/m"), k), "name": c("o_orderpriority")}, {"id": F.concat(lit("plain"), k), "name": lit(None).cast("string")}))
    rows = J.parse_model_catalogue(_orders(spark, sf, body))
    return _out(rows, c("meta.model_id").alias("model_id"), c("meta.extra")["provider"].alias("provider"))


def hub_models(spark, sf):
    """Model lists joined with per-model status by id."""
    k, u = _s("o_orderkey"), _s("o_custkey")
    org = F.element_at(F.array(lit("Qwen"), lit("google"), lit("someone"), lit("OpenAI")), (c("o_orderkey") % 4 + 1).cast("int"))
    mid = F.concat(org, lit("/m"), k)
    body = F.to_json(_items({"id": mid, "pipeline_tag": c("o_orderstatus")}, {"id": F.concat(lit("noslash"), u), "pipeline_tag": lit(None).cast("string")}))
    status = V.table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(mid.alias("model_id"), F.when(c("o_orderstatus") == "F", "WARM").otherwise("cold").alias("inference"))
    rows = J.hub_signals(J.with_inference(J.hub_models(_orders(spark, sf, body)), status))
    return _out(rows, F.coalesce("meta.force_classify", lit(False)).alias("forced"), c("meta.org").alias("org"))


def _package_body():
    k, u = _s("o_orderkey"), _s("o_custkey")
    links = F.struct(F.concat(lit("https://h"), u, lit(".dev")).alias("homepage"), F.when(c("o_orderkey") % 2 == 0, F.concat(lit("git+https://h"), u, lit(".dev."))).alias("repository"))
    one = F.struct(F.struct(F.concat(lit("p"), k).alias("name"), F.concat(lit("about (http://d"), u, lit(".io), ok")).alias("description"), links.alias("links")).alias("package"))
    two = F.struct(F.struct(F.concat(lit("q"), k).alias("name"), lit("bare").alias("description"), F.struct(lit(None).cast("string").alias("homepage"), lit(None).cast("string").alias("repository")).alias("links")).alias("package"))
    return F.to_json(F.struct(F.array(one, two).alias("objects")))


def package_hits(spark, sf):
    return _out(J.parse_package_hits(_orders(spark, sf, _package_body())), _place())


def app_charts(spark, sf):
    """Apps listed in several charts, distinct over all of them."""
    u = _s("o_custkey")
    name = F.when(c("o_custkey") % 3 == 0, F.concat(lit("Chatty "), u)).otherwise(F.concat(lit("Game "), u))
    body = F.to_json(F.struct(F.struct(_items({"name": name, "artistName": lit("X"), "url": F.when(c("o_custkey") % 2 == 0, F.concat(lit("https://apps/"), u))}).alias("results")).alias("feed")))
    return _out(J.distinct_apps(J.parse_app_chart(_orders(spark, sf, body))))


def companies_and_launches(spark, sf):
    k, u = _s("o_orderkey"), _s("o_custkey")
    yc = _json(hits=_items({"name": F.concat(lit("Co"), k), "website": F.concat(lit("https://c"), u), "one_liner": c("o_orderpriority"), "batch": c("o_orderstatus")}))
    topics = F.struct(F.array(F.struct(F.struct(c("o_orderstatus").alias("name")).alias("node")), F.struct(F.struct(lit("AI").alias("name")).alias("node"))).alias("edges"))
    node = F.struct(F.concat(lit(" N"), k, lit(" ")).alias("name"), c("o_orderpriority").alias("tagline"), F.when(c("o_orderkey") % 2 == 0, F.concat(lit("https://w"), u)).alias("website"), F.concat(lit("https://ph/"), k).alias("url"), topics.alias("topics"))
    ph = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(node.alias("node"))).alias("edges")).alias("posts")).alias("data")))
    both = union_signals(J.parse_company_hits(_orders(spark, sf, yc)), J.parse_launch_graph(_orders(spark, sf, ph)))
    return _out(both, c("meta.extra")["topics"].alias("topics"), c("meta.extra")["batch"].alias("batch"))


def hosts_and_posts(spark, sf):
    k, u = _s("o_orderkey"), _s("o_custkey")
    cell = F.when(c("o_orderkey") % 2 == 0, F.concat(lit('["https://h'), u, lit('.io/", "x"]'))).otherwise(F.concat(lit('"http://g'), u, lit('.io"')))
    fofa = F.concat(lit('{"results": ['), cell, lit(', [""]]}'))
    tweets = _json(data=_items({"id": k, "text": c("o_orderpriority")}))
    return _out(union_signals(J.parse_host_rows(_orders(spark, sf, fofa)), J.parse_post_hits(_orders(spark, sf, tweets))))


def price_catalogue(spark, sf):
    k, u = _s("o_orderkey"), _s("o_custkey")
    body = F.concat(
        lit('{"sample_spec": {"litellm_provider": "zz"}, "Prov'), u, lit("/m"), k, lit('": {"litellm_provider": "prov'), u,
        lit('"}, "m2": {"litellm_provider": "other"}, "x/y": {}}'),
    )
    return _out(J.parse_price_catalogue(_orders(spark, sf, body)))


# ------------------------------------------------------------------ certificates
def certificate_hits(spark, sf):
    """orders as search entries: three patterns per path, two names per entry, first meeting kept."""
    n, k = c("o_orderkey"), c("o_custkey")
    path = F.element_at(F.array(*[lit(p) for p in CT.PATHS]), (n % 3 + 1).cast("int"))
    name = F.concat(
        lit("*.llm"), _s("o_custkey"), lit(".com\n"),
        F.when(k % 2 == 0, F.concat(lit("api.shop"), _s("o_custkey"), lit(".net"))).otherwise(F.concat(lit("brand"), _s("o_custkey"), lit(".ai"))),
    )
    e = V.text_table(spark, sf, "orders").select(
        path.alias("path"), (F.floor(n / 3) % 2).cast("int").alias("pattern_no"), n.alias("entry_no"), name.alias("name_value")
    )
    rows = CT.parse_certificate_hits(e)
    return _out(rows, F.coalesce("meta.force_classify", lit(False)).alias("forced"), _place())


# ------------------------------------------------------------------ pages
def _listing(spark, sf):
    """customers as listing pages with an inner, a social, a repeated and two outbound links."""
    u = _s("c_custkey")
    html = F.concat(
        lit("<html><body><a href='/about'>About</a><a href='https://twitter.com/x'>T</a><div>Deal: 20% off <a title='go' href='https://Tool"), u,
        lit(".ai/?r=1'> The <b>tool</b>&nbsp;"), c("c_mktsegment"), lit("</a></div><p><a href='https://tool"), u, lit(".ai/?r=1'>again</a><a href='//other"),
        u, lit(".io'></a><a href='https://named"), u, lit(".io' title='Named'></a></p></body></html>"),
    )
    p = V.text_table(spark, sf, "customer")
    return p.select(c("c_custkey").alias("payload_id"), html.alias("body"), F.concat(lit("https://www.list"), u, lit(".com/new")).alias("page_url"), c("c_mktsegment").alias("aggregator"), F.concat(lit("brand"), u, lit(".ai")).alias("brand"))


def listing_links(spark, sf):
    return _out(HL.parse_listing(_listing(spark, sf)))


def job_listing(spark, sf):
    return _out(HL.parse_job_listing(_listing(spark, sf)), c("meta.service_candidate").alias("candidate"))


def deal_links(spark, sf):
    return _out(HL.parse_deal_page(_listing(spark, sf)))


def brand_pages(spark, sf):
    return _out(HL.parse_brand_page(_listing(spark, sf)))


def server_cards(spark, sf):
    u = _s("c_custkey")
    html = F.concat(
        lit("<div class='server-card'><div class='server-name'> Club "), u, lit("</div><p class='server-description'>about "), c("c_mktsegment"),
        lit("</p><a href='https://x.com/a'>x</a><a href='https://club"), u, lit(".gg/i'>join</a></div><div class='server-card'><span class='server-name'>Solo</span></div>"),
        lit("<div class='server-card'><span class='server-name'>Solo</span></div>"),
    )
    p = V.text_table(spark, sf, "customer").select(c("c_custkey").alias("payload_id"), html.alias("body"), lit("https://disboard.org/servers/tag/ai").alias("page_url"))
    return _out(HL.parse_server_cards(p))


# ------------------------------------------------------------------ markdown and snippets
def markdown_lists(spark, sf):
    u = _s("c_custkey")
    body = F.concat(
        lit("# List\n| [A"), u, lit("](https://www.a"), u, lit(".ai/) | free | https://img.shields.io/x |\n* repeat https://a"), u,
        lit(".ai/y\n- only https://github.com/x\n> `B` https://b"), u, lit(".dev.\nno link"),
    )
    p = V.table(spark, sf, "customer").select(
        c("c_custkey").alias("payload_id"), body.alias("body"), F.lower("c_mktsegment").alias("source"), F.when(c("c_custkey") % 2 == 0, F.concat(lit("o/r"), u)).alias("repo")
    )
    return _out(MD.parse_list(p))


def provider_docs(spark, sf):
    u = _s("c_custkey")
    body = F.concat(
        lit("see https://P"), u, lit(".ai/docs. and http://p"), u, lit(".ai\n| Provider | x |\n| Anth"), u, lit(" | y |\n- [anth"), u,
        lit("](z)\n* p"), u, lit(".ai\n- httpfoo\nplain line"),
    )
    return _out(MD.parse_provider_doc(V.table(spark, sf, "customer").select(c("c_custkey").alias("payload_id"), body.alias("body"))))


def repo_set(spark, sf):
    """Supplier repositories as seeds, order rows as search results."""
    seeds = V.table(spark, sf, "supplier").select(F.concat(lit("seed"), _s("s_suppkey")).alias("source"), F.concat(lit("o/R-"), _s("s_suppkey")).alias("repo"))
    found = V.table(spark, sf, "orders").select(
        F.when(c("o_orderstatus") == "F", F.concat(lit("o/R-"), _s("o_custkey"))).otherwise(c("o_orderstatus")).alias("repo"), c("o_orderkey").alias("found_no")
    )
    return MD.repo_set(seeds, found)


def snippet_hosts(spark, sf):
    """Pasted configuration with a credential line: only hosts of the other lines come out."""
    u, k = _s("o_custkey"), _s("o_orderkey")
    body = F.concat(
        lit("base_url=https://Relay"), u, lit(".example.net/v1\napi_key = abcdefghij"), k, lit(" https://leak"), u,
        lit(".net\nhttps://api.openai.com https://x"), u, lit(".io:8080/a https://relay"), u, lit(".example.net"),
    )
    return _out(R.host_candidates(_orders(spark, sf, body)))


def snippet_filters(spark, sf):
    o = V.text_table(spark, sf, "orders")
    name = F.concat(_s("o_orderkey"), F.element_at(F.array(lit(".env"), lit(".PY"), lit(".exe"), lit("")), (c("o_orderkey") % 4 + 1).cast("int")))
    note = F.when(c("o_orderkey") % 3 == 0, "an OpenAI relay").when(c("o_orderkey") % 3 == 1, "api.key of LLM").otherwise("cooking")
    link = F.concat(lit("https://pastebin.com/"), F.when(c("o_orderkey") % 2 == 0, "raw/").otherwise(""), _s("o_orderkey"), lit("?x=1"))
    return o.select("o_orderkey", R.relevant_file(name, note).alias("file_ok"), R.relevant_title(note, lit(None).cast("string")).alias("title_ok"), R.raw_url(link).alias("raw_url"))


# ------------------------------------------------------------------ channel messages
def _messages(spark, sf):
    return as_messages(V.text_table(spark, sf, "conversations"))


def as_messages(t):
    """conversations as channel messages; the conversation picks channel, topic and forward origin."""
    chan = F.concat(lit("chan"), _s("conv_id"))
    forward = F.struct(
        F.when(c("conv_id") % 4 == 0, F.concat(lit("up"), (c("conv_id") % 10).cast("string"))).alias("username"),
        F.when(c("conv_id") % 4 == 1, F.concat(lit("Title "), (c("conv_id") % 6).cast("string"))).alias("title"), lit("").alias("from_name"),
    )
    header = F.struct(F.when(c("conv_id") % 4 == 2, "someone").alias("from_name"))
    reply = F.struct(F.when(c("turn") % 2 == 0, c("turn")).alias("top_id"), (c("turn") + 1).alias("msg_id"))
    return t.select(
        F.when(c("conv_id") % 5 != 0, chan).alias("channel"), c("conv_id").alias("chat_id"), c("turn").alias("msg_id"),
        F.timestamp_seconds(c("conv_id") * 1000 + c("turn")).alias("date"), "text", forward.alias("forward"), header.alias("fwd_from"), reply.alias("reply_to"),
    )


def _topic_config(spark, sf):
    t = V.table(spark, sf, "conversations")
    return t.select(F.concat(lit("chan"), _s("conv_id")).alias("channel"), (c("conv_id") % 3).alias("topic_id")).distinct()


def channel_messages(spark, sf):
    rows = CH.message_signals(CH.on_topic(_messages(spark, sf), _topic_config(spark, sf)))
    return rows.select("source", F.md5("raw_text").alias("digest"), "source_url", c("meta.forward_from").alias("forward_from"), "ingest_seq")


def upstream_channels(spark, sf):
    return CH.upstream_channels(CH.message_signals(_messages(spark, sf)))


QUERIES = {
    f.__name__: f
    for f in (
        feed_items, feed_items_community, feed_items_launches, feed_items_changelog, feed_items_mirror, feed_formats, package_feed, news_hits, repo_hits, code_hits,
        issue_hits, landed_signals, web_and_video_hits, model_catalogue, hub_models, package_hits, app_charts, companies_and_launches,
        hosts_and_posts, price_catalogue, certificate_hits, listing_links, job_listing, deal_links, brand_pages,
        server_cards, markdown_lists, provider_docs, repo_set, snippet_hosts, snippet_filters, channel_messages,
        upstream_channels,
    )
}

# ------------------------------------------------------------------ SQL
N = "CAST(NULL AS VARCHAR)"
K_, U_ = "CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)"
C_ = "CAST(c_custkey AS VARCHAR)"


def _rows(*selects):
    """UNION ALL of (source, raw_text, url, source_url, from-where)."""
    return " UNION ALL ".join(
        f"SELECT {s} AS source, {t} AS raw_text, {u} AS url, {l} AS source_url FROM {rest}" for s, t, u, l, rest in selects
    )


_FEED_TEXT = "'Q&A of  ' || source || ' ' || '. '"
_CLEAN = r"trim(text, e' \t\n\r\f\x0b ')"
_LINK = "'https://docs.example/' || CAST(doc_id AS VARCHAR) || '?a=1&b=2'"
_FEED_BODY = f"'Q&A of  ' || source || '. ' || {_CLEAN}"
_MIRROR = f"trim(trim({_FEED_BODY}, '. '), e' \\t\\n\\r')"
_CERT = """cert0 AS (
  SELECT o_orderkey AS n, o_custkey AS u, o_orderkey % 3 AS p, (o_orderkey // 3) % 2 AS pat FROM orders
),
cert1 AS (SELECT *, row_number() OVER (PARTITION BY p, pat ORDER BY n) AS rn FROM cert0),
cert2 AS (
  SELECT p, pat, n, 0 AS nn, 'llm' || CAST(u AS VARCHAR) || '.com' AS host FROM cert1
  UNION ALL
  SELECT p, pat, n, 1, CASE WHEN u % 2 = 0 THEN 'api.shop' || CAST(u AS VARCHAR) || '.net' ELSE 'brand' || CAST(u AS VARCHAR) || '.ai' END
  FROM cert1
),
cert3 AS (
  SELECT *, CASE WHEN p = 2 THEN 'candidate' WHEN starts_with(host, 'llm') THEN 'force' WHEN p = 1 AND ends_with(host, '.ai') THEN 'candidate' END AS kind,
         CASE WHEN p = 2 AND starts_with(host, 'api.') THEN host[5:] ELSE host END AS target FROM cert2
)"""

ORACLE = {
    "feed_items": f"SELECT source, md5(({_FEED_BODY})) AS digest, {N} AS url, {_LINK} AS source_url FROM documents",
    "feed_items_community": f"SELECT 'reddit' AS source, md5(({_FEED_BODY})) AS digest, lang AS url, {_LINK} AS source_url FROM documents",
    "feed_items_launches": f"SELECT 'producthunt' AS source, md5(({_FEED_BODY})) AS digest, {N} AS url, {_LINK} AS source_url FROM documents",
    "feed_items_changelog": f"SELECT 'changelog' AS source, md5(({_FEED_BODY})) AS digest, lang AS url, {_LINK} AS source_url FROM documents",
    "feed_items_mirror": f"""SELECT 'twitter' AS source, md5(({_MIRROR})) AS digest, {N} AS url,
  'https://twitter.com/' || CAST(doc_id AS VARCHAR) || '?a=1&b=2' AS source_url FROM documents""",
    "feed_formats": "SELECT doc_id AS payload_id, true AS is_feed, false AS late FROM documents",
    "package_feed": """SELECT 'pypi' AS source, 'llm ' || p_name || '.' AS raw_text, 'https://pypi.example/' || CAST(p_partkey AS VARCHAR) AS url,
  'https://pypi.example/' || CAST(p_partkey AS VARCHAR) AS source_url FROM part WHERE p_size % 2 = 0""",
    "news_hits": _rows(
        ("'hackernews'", f"'Show ' || {K_} || '. ' || o_orderpriority", f"'https://a' || {U_} || '.ai'", f"'https://news.ycombinator.com/item?id=' || {K_}", "orders"),
        ("'hackernews'", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE '' END", "CASE WHEN o_orderkey % 5 = 0 THEN 'https://s.io' END",
         "CASE WHEN o_orderkey % 5 = 0 THEN 'https://s.io' END", "orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0"),
    ),
    "repo_hits": _rows(("'github'", f"'o/r' || {K_} || '. ' || o_orderpriority", f"'https://h' || {U_}", f"'https://github.com/o/r' || {K_}", "orders")),
    "code_hits": f"""
WITH r AS (SELECT *, 'base_url=''https://a' || {U_} || '.ai/v1'' or https://b' || {K_} || '.dev)' AS t FROM orders)
SELECT 'github_code' AS source, t AS raw_text, 'https://a' || {U_} || '.ai/v1' AS url, 'https://g/' || {K_} AS source_url, {K_} || ',0,0,0' AS place FROM r
UNION ALL SELECT 'github_code', t, 'https://b' || {K_} || '.dev', 'https://g/' || {K_}, {K_} || ',0,0,1' FROM r
UNION ALL SELECT 'github_code', o_orderpriority, {N}, 'https://g/' || {K_}, {K_} || ',0,1,0' FROM r""",
    "issue_hits": _rows(
        *[("'github_issues'", f"'Issue ' || {K_} || '. my url https://a' || {U_} || '.ai and https://b' || {U_} || '.ai'", f"'https://{h}' || {U_} || '.ai'", f"'https://g/' || {K_}", "orders WHERE o_orderkey % 3 = 0") for h in "ab"],
        ("'github_issues'", f"'Issue ' || {K_} || '. a free trial here'", N, f"'https://g/' || {K_}", "orders WHERE o_orderkey % 3 = 1"),
    ),
    "web_and_video_hits": _rows(
        ("'searchdorks'", f"o_orderpriority || '. s ' || {K_}", f"'https://w' || {U_}", f"'https://w' || {U_}", "orders WHERE o_orderkey % 2 = 0"),
        ("'youtube'", f"o_orderstatus || '. see https://v' || {U_} || '.ai/x and http://t.io' || chr(10) || 'https://v' || {U_} || '.ai/x http://t.io'",
         f"'https://youtu.be/' || {K_}", f"'https://youtu.be/' || {K_}", "orders WHERE o_orderkey % 4 <> 0"),
    ),
    "model_catalogue": f"""SELECT 'openrouter' AS source, o_orderpriority || ' (prov' || {U_} || '/m' || {K_} || ')' AS raw_text, {N} AS url, {N} AS source_url,
  'prov' || {U_} || '/m' || {K_} AS model_id, 'prov' || {U_} AS provider FROM orders
UNION ALL SELECT 'openrouter', 'plain' || {K_} || ' (plain' || {K_} || ')', {N}, {N}, 'plain' || {K_}, {N} FROM orders""",
    "hub_models": f"""
WITH m AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'Qwen' WHEN 1 THEN 'google' WHEN 2 THEN 'someone' ELSE 'OpenAI' END AS o FROM orders),
n AS (SELECT *, o || '/m' || {K_} AS mid FROM m WHERE o <> 'someone')
SELECT 'huggingface' AS source, 'New model release: ' || mid || ' (' || o_orderstatus || ')' || CASE WHEN o_orderstatus = 'F' THEN
  '. Available on HuggingFace Inference API (status=warm) — free access with HF token via OpenAI-compatible endpoint. No registration on third-party services required.' ELSE '' END AS raw_text,
  'https://huggingface.co/' || mid AS url, 'https://huggingface.co/' || mid AS source_url, o_orderstatus = 'F' AS forced, lower(o) AS org FROM n""",
    "package_hits": f"""
WITH r AS (SELECT *, 'p' || {K_} || '. about (http://d' || {U_} || '.io), ok' AS t FROM orders)
SELECT 'npm' AS source, t AS raw_text, 'https://h' || {U_} || '.dev' AS url, {N} AS source_url, {K_} || ',0,0' AS place FROM r
UNION ALL SELECT 'npm', t, 'http://d' || {U_} || '.io', {N}, {K_} || ',0,1' FROM r
UNION ALL SELECT 'npm', 'q' || {K_} || '. bare', {N}, {N}, {K_} || ',1,0' FROM r""",
    "app_charts": f"""SELECT DISTINCT 'appstore' AS source, 'Chatty ' || {U_} || ' — X' AS raw_text,
  CASE WHEN o_custkey % 2 = 0 THEN 'https://apps/' || {U_} END AS url, {N} AS source_url FROM orders WHERE o_custkey % 3 = 0""",
    "companies_and_launches": f"""SELECT 'yc' AS source, 'Co' || {K_} || ' (' || o_orderstatus || '). ' || o_orderpriority AS raw_text, 'https://c' || {U_} AS url,
  {N} AS source_url, {N} AS topics, o_orderstatus AS batch FROM orders
UNION ALL SELECT 'ph_upcoming', 'N' || {K_} || '. ' || o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 'https://w' || {U_} ELSE 'https://ph/' || {K_} END,
  'https://ph/' || {K_}, o_orderstatus || ',AI', {N} FROM orders""",
    "hosts_and_posts": f"""
WITH h AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'h' ELSE 'g' END || {U_} || '.io' AS host FROM orders)
SELECT 'fofa' AS source, 'Possible relay panel: ' || host AS raw_text, 'https://' || host AS url, 'https://' || host AS source_url FROM h
UNION ALL SELECT 'twitter', o_orderpriority, {N}, 'https://twitter.com/i/web/status/' || {K_} FROM orders""",
    "price_catalogue": _rows(
        *[("'provider_lists'", f"'LLM provider listed: ' || {t}", N, N, "orders") for t in (f"'Prov' || {U_}", "'other'", "'x'")]
    ),
    "certificate_hits": f"""WITH {_CERT},
cert4 AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY p, pat, n, nn) AS k FROM cert3 WHERE kind IS NOT NULL)
SELECT 'crtsh' AS source, target AS raw_text, 'https://' || target AS url, 'https://crt.sh/?q=' || target AS source_url, kind = 'force' AS forced,
  concat_ws(',', 0, p, pat, n, nn) AS place
FROM cert4 WHERE k = 1""",
    "deal_links": f"""SELECT c_mktsegment AS source, ('Thetool' || c_mktsegment || ' Deal: 20% off The tool ' || c_mktsegment) AS raw_text,
  'https://tool' || {C_} || '.ai' AS url, 'https://www.list' || {C_} || '.com/new' AS source_url FROM customer
UNION ALL SELECT c_mktsegment, 'T About T Deal: 20% off The tool ' || c_mktsegment || ' again', 'https://twitter.com',
  'https://www.list' || {C_} || '.com/new' FROM customer""",
    "server_cards": f"""SELECT 'discord_dir' AS source, 'Club ' || {C_} || '. about ' || c_mktsegment AS raw_text, 'https://club' || {C_} || '.gg/i' AS url,
  'https://disboard.org/servers/tag/ai' AS source_url FROM customer
UNION ALL SELECT 'discord_dir', 'Solo', {N}, 'https://disboard.org/servers/tag/ai' FROM customer""",
    "markdown_lists": f"""
WITH m AS (SELECT *, lower(c_mktsegment) AS s, 'https://github.com/' || CASE WHEN c_custkey % 2 = 0 THEN 'o/r' || {C_} ELSE lower(c_mktsegment) END AS o FROM customer)
SELECT s AS source, 'A' || {C_} || ' (https://www.a' || {C_} || '.ai/) free https://img.shields.io/x' AS raw_text, 'https://www.a' || {C_} || '.ai/' AS url, o AS source_url FROM m
UNION ALL SELECT s, 'B https://b' || {C_} || '.dev.', 'https://b' || {C_} || '.dev', o FROM m""",
    "provider_docs": _rows(
        ("'provider_lists'", f"'LLM provider listed: p' || {C_} || '.ai'", f"'https://p' || {C_} || '.ai'", N, "customer"),
        ("'provider_lists'", f"'LLM provider listed: Anth' || {C_}", N, N, "customer"),
    ),
    "repo_set": """
WITH s AS (SELECT 'seed' || CAST(s_suppkey AS VARCHAR) AS source, 'o/R-' || CAST(s_suppkey AS VARCHAR) AS repo FROM supplier),
f AS (SELECT 'o/R-' || CAST(o_custkey AS VARCHAR) AS repo, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT * FROM s UNION ALL
SELECT 'ghlist_' || replace(replace(lower(repo), '/', '_'), '-', '_'), repo FROM (
  SELECT * FROM f WHERE repo NOT IN (SELECT repo FROM s))""",
    "snippet_hosts": _rows(
        *[("'pastebin'", f"'Paste config: ' || {h}", f"'https://' || {h}", N, "orders") for h in (f"'relay' || {U_} || '.example.net'", f"'x' || {U_} || '.io'")]
    ),
    "snippet_filters": f"""SELECT o_orderkey, o_orderkey % 4 IN (0, 1) AND o_orderkey % 3 <> 2 AS file_ok, o_orderkey % 3 <> 2 AS title_ok,
  'https://pastebin.com/raw/' || {K_} || '?x=1' AS raw_url FROM orders""",
    "channel_messages": """
WITH m AS (SELECT *, CASE WHEN conv_id % 5 <> 0 THEN 'chan' || CAST(conv_id AS VARCHAR) END AS chan, conv_id % 3 AS topic,
                  coalesce(nullif(CASE WHEN turn % 2 = 0 THEN turn END, 0), turn + 1) AS tid FROM conversations)
SELECT 'telegram' AS source, md5(text) AS digest,
  'https://t.me/' || coalesce(chan, CAST(conv_id AS VARCHAR)) || '/' || CAST(turn AS VARCHAR) AS source_url,
  CASE conv_id % 4 WHEN 0 THEN 'up' || CAST(conv_id % 10 AS VARCHAR) WHEN 1 THEN 'Title ' || CAST(conv_id % 6 AS VARCHAR) WHEN 2 THEN 'someone' END AS forward_from,
  (conv_id * 1000 + turn) * 1000000 AS ingest_seq
FROM m WHERE chan IS NULL OR topic = 0 OR tid = topic""",
    "upstream_channels": """SELECT DISTINCT CASE conv_id % 4 WHEN 0 THEN 'up' || CAST(conv_id % 10 AS VARCHAR)
  WHEN 1 THEN 'Title ' || CAST(conv_id % 6 AS VARCHAR) ELSE 'someone' END AS channel FROM conversations WHERE conv_id % 4 <> 3""",
}
_LISTING = f"""SELECT '{{s}}' AS source, 'The tool ' || c_mktsegment || ' go' AS raw_text, 'https://Tool' || {C_} || '.ai/?r=1' AS url,
  'https://www.list' || {C_} || '.com/new' AS source_url{{x}} FROM customer
UNION ALL SELECT '{{s}}', 'again', 'https://tool' || {C_} || '.ai/?r=1', 'https://www.list' || {C_} || '.com/new'{{x}} FROM customer
UNION ALL SELECT '{{s}}', 'Named', 'https://named' || {C_} || '.io', 'https://www.list' || {C_} || '.com/new'{{x}} FROM customer"""
ORACLE["listing_links"] = _LISTING.format(s="directories", x="")
ORACLE["job_listing"] = _LISTING.format(s="wellfound", x=", true AS candidate")
ORACLE["brand_pages"] = f"""
WITH b AS (SELECT *, 'About T Deal: 20% off The tool ' || c_mktsegment || ' again' AS body FROM customer)
SELECT 'coupon' AS source, body AS raw_text, 'https://brand' || {C_} || '.ai' AS url, 'https://www.list' || {C_} || '.com/new' AS source_url FROM b"""
ORACLE["landed_signals"] = " UNION ALL ".join(
    f"SELECT source, raw_text, url, source_url FROM ({ORACLE[name]})" for name in ("package_hits", "code_hits", "issue_hits")
)
