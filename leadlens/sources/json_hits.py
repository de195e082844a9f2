"""JSON API payloads: search hits, catalogues and lists.

Each parser declares the fields it reads; other fields are ignored and missing ones are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions.words import has_any, literals, truthy_text
from leadlens.sources.common import deeper, empty_if_null, exploded, exploded_first, first_chars, first_per, meta, signals, trim_chars

_SPACE = " \t\n\r"


def _items(payloads: DataFrame, schema: str, path: str) -> DataFrame:
    parsed = payloads.withColumn("_j", F.from_json("body", schema))
    return exploded(parsed, F.col(f"_j.{path}"), [c for c in payloads.columns if c != "body"])


def _dotted(first: Column, second: Column) -> Column:
    return F.concat(empty_if_null(first), F.lit(". "), empty_if_null(second))


def _either(*values: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[truthy_text(v) for v in values])


def _per_url(rows: DataFrame, urls: Column) -> DataFrame:
    """One row per URL, or one with a NULL ``found_url``; ``pos`` keeps the order."""
    out = rows.select("*", F.posexplode_outer(urls).alias("_u", "found_url"))
    return out.withColumn("pos", deeper(F.coalesce("_u", F.lit(0)))).drop("_u")


def parse_news_hits(payloads: DataFrame, source: str = "hackernews", cap: int | None = None) -> DataFrame:
    rows = _items(
        payloads,
        "hits array<struct<title:string,story_title:string,url:string,story_url:string,story_text:string,"
        "comment_text:string,objectID:string,points:string>>",
        "hits",
    )
    i = F.col("item")
    url = _either(i["url"], i["story_url"])
    body = _dotted(_either(i["title"], i["story_title"]), _either(i["story_text"], i["comment_text"]))
    rows = rows.withColumns({"text": trim_chars(trim_chars(body, ". "), _SPACE), "link": url})
    rows = rows.where((F.col("text") != "") | F.col("link").isNotNull())
    permalink = F.concat(F.lit("https://news.ycombinator.com/item?id="), truthy_text(i["objectID"]))
    return signals(
        rows, source, first_chars("text", cap), F.col("link"), F.coalesce(permalink, F.col("link")),
        meta_value=meta({"points": i["points"]}),
    )


def parse_repo_hits(payloads: DataFrame, source: str = "github") -> DataFrame:
    rows = _items(
        payloads,
        "items array<struct<full_name:string,name:string,description:string,homepage:string,html_url:string,"
        "stargazers_count:string>>",
        "items",
    )
    i = F.col("item")
    rows = rows.where(_either(i["description"], i["homepage"]).isNotNull())
    body = trim_chars(_dotted(_either(i["full_name"], i["name"]), i["description"]), _SPACE)
    return signals(
        rows, source, body, truthy_text(i["homepage"]), i["html_url"],
        meta_value=meta({"stars": i["stargazers_count"]}),
    )


CODE_URL_PATTERN = r"(?U)https?://[^\s'\"<>)\]]+"  # fixed value
ISSUE_WORDS = ("free", "注册", "trial", "免费")  # fixed value


def parse_code_hits(payloads: DataFrame, source: str = "github_code") -> DataFrame:
    """One row per URL in a matched fragment, or one without a URL."""
    rows = _items(
        payloads, "items array<struct<html_url:string,text_matches:array<struct<fragment:string>>>>", "items"
    )
    rows = rows.select("*", F.posexplode("item.text_matches").alias("_m", "match")).withColumn(
        "pos", deeper(F.col("_m"))
    )
    fragment = F.col("match.fragment")
    rows = rows.where(truthy_text(fragment).isNotNull())
    rows = _per_url(rows, F.regexp_extract_all(fragment, F.lit(CODE_URL_PATTERN), F.lit(0)))
    return signals(rows, source, fragment, F.col("found_url"), F.col("item.html_url"), row_key=F.col("found_url"))


def parse_issue_hits(payloads: DataFrame, source: str = "github_issues") -> DataFrame:
    """One row per URL in an issue, else one row if it has an offer word."""
    rows = _items(payloads, "items array<struct<title:string,body:string,html_url:string>>", "items")
    rows = rows.withColumns(
        {"title": empty_if_null(F.col("item.title")), "text": empty_if_null(F.col("item.body"))}
    )
    urls = F.regexp_extract_all("text", F.lit(CODE_URL_PATTERN), F.lit(0))
    rows = _per_url(rows, urls)
    offered = has_any(F.concat("title", F.lit(" "), "text"), ISSUE_WORDS)
    rows = rows.where(F.col("found_url").isNotNull() | offered)
    return signals(
        rows, source, F.concat("title", F.lit(". "), "text"), F.col("found_url"),
        F.col("item.html_url"), row_key=F.col("found_url"),
    )


def parse_web_hits(payloads: DataFrame, source: str = "searchdorks") -> DataFrame:
    rows = _items(payloads, "items array<struct<title:string,snippet:string,link:string>>", "items")
    link = truthy_text(F.col("item.link"))
    body = trim_chars(_dotted(F.col("item.title"), F.col("item.snippet")), _SPACE)
    return signals(rows.where(link.isNotNull()), source, body, link, link)


def parse_video_hits(payloads: DataFrame, source: str = "youtube") -> DataFrame:
    """Videos; URLs of the description are repeated at the end of the text."""
    rows = _items(
        payloads, "items array<struct<id:struct<videoId:string>,snippet:struct<title:string,description:string>>>", "items"
    )
    i = F.col("item")
    rows = rows.where(truthy_text(i["id"]["videoId"]).isNotNull())
    body = trim_chars(_dotted(i["snippet"]["title"], i["snippet"]["description"]), _SPACE)
    urls = F.regexp_extract_all(empty_if_null(i["snippet"]["description"]), F.lit(r"(?U)https?://\S+"), F.lit(0))
    body = F.when(F.size(urls) > 0, F.concat(body, F.lit("\n"), F.array_join(urls, " "))).otherwise(body)
    link = F.concat(F.lit("https://youtu.be/"), i["id"]["videoId"])
    return signals(rows, source, body, link, link)


def parse_model_catalogue(payloads: DataFrame, source: str = "openrouter") -> DataFrame:
    rows = _items(payloads, "data array<struct<id:string,name:string>>", "data")
    mid = F.col("item.id")
    provider = F.when(F.contains(mid, F.lit("/")), truthy_text(F.substring_index(mid, "/", 1)))
    body = F.concat(_either(F.col("item.name"), mid), F.lit(" ("), mid, F.lit(")"))
    return signals(
        rows.where(truthy_text(mid).isNotNull()), source, body,
        meta_value=meta({"provider": provider}, model_id=mid, model_release=True),
    )


# Model hub.
KEY_ORGS = (
    "thudm", "zai-org", "qwen", "deepseek-ai", "mistralai", "meta-llama", "google", "openai", "anthropic", "01-ai",
    "internlm", "moonshot-ai", "stepfun-ai",
)
LIVE_STATES = ("warm", "loading")
_LIVE_TEXT = (
    ". Available on HuggingFace Inference API (status=%s) — free access with HF token via OpenAI-compatible endpoint."
    " No registration on third-party services required."
)


def hub_models(payloads: DataFrame) -> DataFrame:
    """Model rows of list payloads: payload_id, pos, model_id, pipeline_tag, inference."""
    rows = payloads.withColumn(
        "_j", F.from_json("body", "array<struct<id:string,modelId:string,pipeline_tag:string,inference:string>>")
    )
    rows = exploded(rows, F.col("_j"))
    i = F.col("item")
    return rows.select(
        *[c for c in rows.columns if c != "item"], _either(i["id"], i["modelId"]).alias("model_id"),
        i["pipeline_tag"].alias("pipeline_tag"), i["inference"].alias("inference"),
    )


def with_inference(models: DataFrame, status: DataFrame) -> DataFrame:
    """Attach the per-model status by model id (a model without status keeps NULL)."""
    s = status.select("model_id", truthy_text(F.lower("inference")).alias("_status"))
    return models.drop("inference").join(s, "model_id", "left").withColumnRenamed("_status", "inference")


def parse_hub(payloads: DataFrame) -> DataFrame:
    """Landed hub answers: lists of models, and single-model answers, which state whether a model is served."""
    single = payloads.where(F.startswith(F.ltrim("body"), F.lit("{"))).select(
        F.from_json("body", "id string, modelId string, inference string").alias("_j")
    )
    status = single.select(_either(F.col("_j.id"), F.col("_j.modelId")).alias("model_id"), F.col("_j.inference").alias("inference"))
    newest = status.where(F.col("model_id").isNotNull()).groupBy("model_id").agg(F.max("inference").alias("inference"))
    models = hub_models(payloads.where(F.startswith(F.ltrim("body"), F.lit("["))))
    listed = models.withColumnRenamed("inference", "_listed")
    both = with_inference(listed.withColumn("inference", F.col("_listed")), newest)
    return hub_signals(both.withColumn("inference", F.coalesce("inference", "_listed")).drop("_listed"))


def hub_signals(models: DataFrame, org: str | None = None) -> DataFrame:
    """Releases of the key organisations (or of one); models live on the hosted API say so and force a label."""
    mid = F.col("model_id")
    owner = F.lower(F.substring_index(mid, "/", 1))
    wanted = owner == org if org else owner.isin(*KEY_ORGS)
    state = F.lower(empty_if_null(F.col("inference")))
    live = state.isin(*LIVE_STATES)
    head, tail = _LIVE_TEXT.split("%s")
    body = F.concat(
        F.lit("New model release: "),
        mid,
        F.when(truthy_text(F.col("pipeline_tag")).isNotNull(), F.concat(F.lit(" ("), F.col("pipeline_tag"), F.lit(")"))).otherwise(""),
        F.when(live, F.concat(F.lit(head), state, F.lit(tail))).otherwise(""),
    )
    link = F.concat(F.lit("https://huggingface.co/"), mid)
    return signals(
        models.where(F.contains(mid, F.lit("/")) & wanted), "huggingface", body, link, link,
        meta_value=meta(
            {"hf_inference": truthy_text(state)}, model_release=True, force_classify=F.when(live, True), org=owner, model_id=mid
        ),
    )


PACKAGE_URL_PATTERN = r"(?iU)https?://[^\s<>\"')]+"  # fixed value


def parse_package_hits(payloads: DataFrame, source: str = "npm") -> DataFrame:
    """One row per distinct URL among homepage, repository and description, or one without a URL."""
    rows = _items(
        payloads,
        "objects array<struct<package:struct<name:string,description:string,links:struct<homepage:string,repository:string>>>>",
        "objects",
    )
    p = F.col("item.package")
    rows = rows.where(truthy_text(p["name"]).isNotNull())
    found = [
        F.regexp_extract_all(empty_if_null(v), F.lit(PACKAGE_URL_PATTERN), F.lit(0))
        for v in (p["links"]["homepage"], p["links"]["repository"], p["description"])
    ]
    urls = F.array_distinct(
        F.filter(F.transform(F.concat(*found), lambda u: F.rtrim(u, F.lit(".,);]"))), lambda u: u != "")
    )
    rows = _per_url(rows, urls)
    body = trim_chars(_dotted(p["name"], p["description"]), _SPACE)
    return signals(
        rows, source, body, F.col("found_url"),
        meta_value=meta({"package": p["name"], "registry": F.lit("npm")}),
    )


APP_NAME_PATTERN = r"(?iU)ai|gpt|chat|llm|assistant|claude|gemini"  # fixed value


def parse_app_chart(payloads: DataFrame, source: str = "appstore") -> DataFrame:
    rows = _items(
        payloads, "feed struct<results:array<struct<name:string,artistName:string,url:string>>>", "feed.results"
    )
    i = F.col("item")
    rows = rows.where(empty_if_null(i["name"]).rlike(APP_NAME_PATTERN))
    body = trim_chars(F.concat(i["name"], F.lit(" — "), empty_if_null(i["artistName"])), " —")
    return signals(rows, source, body, truthy_text(i["url"]))


def distinct_apps(apps: DataFrame) -> DataFrame:
    """First row per URL (or text) over all charts."""
    keyed = apps.withColumn("_key", _either(F.col("url"), F.col("raw_text")))
    return first_per(keyed, ["_key"], ["ingest_seq", "place", "raw_text"]).drop("_key")


def parse_company_hits(payloads: DataFrame, source: str = "yc") -> DataFrame:
    rows = _items(payloads, "hits array<struct<name:string,website:string,one_liner:string,batch:string>>", "hits")
    i = F.col("item")
    body = F.concat(i["name"], F.lit(" ("), empty_if_null(i["batch"]), F.lit("). "), empty_if_null(i["one_liner"]))
    return signals(
        rows.where(truthy_text(i["name"]).isNotNull()), source, trim_chars(body, _SPACE), truthy_text(i["website"]),
        meta_value=meta({"batch": empty_if_null(i["batch"])}, service_candidate=True),
    )


def parse_launch_graph(payloads: DataFrame, source: str = "ph_upcoming", cap: int | None = None) -> DataFrame:
    """GraphQL posts with their nested topics."""
    node = (
        "struct<name:string,tagline:string,website:string,url:string,"
        "topics:struct<edges:array<struct<node:struct<name:string>>>>>"
    )
    rows = _items(payloads, f"data struct<posts:struct<edges:array<struct<node:{node}>>>>", "data.posts.edges")
    n = F.col("item.node")
    website, url = truthy_text(n["website"]), truthy_text(n["url"])
    body = _dotted(trim_chars(empty_if_null(n["name"]), _SPACE), trim_chars(empty_if_null(n["tagline"]), _SPACE))
    names = F.transform(n["topics"]["edges"], lambda e: e["node"]["name"])
    topics = F.filter(F.coalesce(names, literals([])), lambda t: truthy_text(t).isNotNull())
    rows = rows.withColumn("text", trim_chars(trim_chars(body, ". "), _SPACE))
    rows = rows.where((F.col("text") != "") | F.coalesce(website, url).isNotNull())
    return signals(
        rows, source, first_chars("text", cap), F.coalesce(website, url), url,
        meta_value=meta({"topics": F.array_join(topics, ",")}, service_candidate=True),
    )


def parse_host_rows(payloads: DataFrame, source: str = "fofa") -> DataFrame:
    """Host list: first column of each result row (array or bare string), scheme and slashes removed."""
    rows = _items(payloads, "results array<string>", "results")
    cell = F.coalesce(F.get(F.from_json("item", "array<string>"), F.lit(0)), F.when(~F.startswith("item", F.lit("[")), F.col("item")))
    bare = F.replace(F.replace(trim_chars(cell, _SPACE), F.lit("https://")), F.lit("http://"))
    rows = rows.withColumn("host", trim_chars(bare, "/")).where(F.col("host") != "")
    link = F.concat(F.lit("https://"), F.col("host"))
    return signals(
        rows, source, F.concat(F.lit("Possible relay panel: "), "host"), link, link, meta_value=meta(service_candidate=True)
    )


def parse_post_hits(payloads: DataFrame, source: str = "twitter", cap: int | None = None) -> DataFrame:
    rows = _items(payloads, "data array<struct<id:string,text:string>>", "data")
    i = F.col("item")
    link = F.concat(F.lit("https://twitter.com/i/web/status/"), truthy_text(i["id"]))
    return signals(
        rows, source, first_chars(empty_if_null(i["text"]), cap), source_url=link,
        meta_value=meta({"via": F.lit("v2api"), "tweet_id": i["id"]}),
    )


def parse_price_catalogue(payloads: DataFrame, source: str = "provider_lists") -> DataFrame:
    """Providers of a price object keyed by model: key prefix, then the provider field; one row per name and
    payload, letter case ignored."""
    rows = payloads.withColumn("_j", F.from_json("body", "map<string,struct<litellm_provider:string>>"))

    def named(entry: Column) -> Column:
        prefix = F.when(F.contains(entry["key"], F.lit("/")), F.substring_index(entry["key"], "/", 1))
        both = F.array(prefix, entry["value"]["litellm_provider"])
        return F.when(entry["key"] == "sample_spec", literals([])).otherwise(F.transform(both, lambda n: trim_chars(n, _SPACE)))

    names = F.filter(F.flatten(F.transform(F.map_entries("_j"), named)), lambda n: truthy_text(n).isNotNull())
    rows = exploded_first(rows, names, F.lower)
    return signals(
        rows, source, F.concat(F.lit("LLM provider listed: "), "item"), meta_value=meta(service_candidate=True)
    )
