"""Markdown lists: repository tables and provider documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions.domains import host_without_www
from leadlens.functions.html import squeeze
from leadlens.functions.words import truthy_text
from leadlens.sources.common import empty_if_null, exploded, exploded_first, first_per, meta, positions, signals, trim_chars

# Link patterns and names that are not services.
LIST_URL_PATTERN = r"(?U)https?://[^\s)\]>\"']+"
LIST_SKIP_HOSTS = (
    "github.com", "raw.githubusercontent.com", "githubusercontent.com", "shields.io", "img.shields.io",
    "camo.githubusercontent.com", "badgen.net", "opencollective.com", "ko-fi.com", "patreon.com", "t.me",
    "twitter.com", "x.com", "youtube.com", "youtu.be",
)
PROVIDER_URL_PATTERN = r"(?iU)https?://[^\s)\]\"'>]+"
PROVIDER_NAME_PATTERN = r"^[|\-*]\s*\[?([A-Za-z][A-Za-z0-9 ._/+-]{1,40})\]?"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
PROVIDER_NOISE = ("provider", "providers", "model", "models")


def lines(documents: DataFrame, keep: list[str]) -> DataFrame:
    """Lines of every document with their position."""
    return exploded(documents, F.split("body", _LINE_END), keep).withColumnRenamed("item", "line")


def parse_list(documents: DataFrame) -> DataFrame:
    """One signal per line with an outbound link, one per linked host; columns source and (optional) repo."""


    def outbound(line: Column) -> Column:
        urls = F.regexp_extract_all(line, F.lit(LIST_URL_PATTERN), F.lit(0))
        ours = F.filter(urls, lambda u: (host_without_www(u) != "") & ~host_without_www(u).isin(*LIST_SKIP_HOSTS))
        return F.struct(line.alias("line"), F.get(ours, F.lit(0)).alias("url"))

    linked = F.filter(F.transform(F.split("body", _LINE_END), outbound), lambda x: x["url"].isNotNull())
    rows = exploded_first(documents, linked, lambda x: host_without_www(x["url"]), ["source", "repo"])
    rows = rows.withColumns({"_url": F.col("item.url"), "_host": F.col("key")})
    context = squeeze(F.regexp_replace("item.line", r"[|#*`>\[\]]", " "))
    repo = truthy_text(F.col("repo")) if "repo" in documents.columns else F.lit(None).cast("string")
    origin = F.concat(F.lit("https://github.com/"), F.coalesce(repo, F.col("source")))
    return signals(rows, F.col("source"), context, F.rtrim("_url", F.lit(".,);")), origin, row_key=F.col("_host"))


def repo_set(seeds: DataFrame, discovered: DataFrame, limit: int | None = None) -> DataFrame:
    """Seeds and the newly found repositories (columns source, repo, found_no), all or the first ``limit``."""
    new = discovered.where(F.contains("repo", F.lit("/"))).join(seeds.select("repo"), "repo", "left_anti")
    new = first_per(new.select("repo", "found_no"), ["repo"], ["found_no"])
    if limit is not None:
        new = new.orderBy("found_no").limit(limit)
    key = F.regexp_replace(F.lower("repo"), "[/-]", "_")
    return seeds.select("source", "repo").unionByName(new.select(F.concat(F.lit("ghlist_"), key).alias("source"), "repo"))


def _url_host(url: Column) -> Column:
    return truthy_text(F.lower(F.regexp_extract(url, r"(?i)^https?://([^/]+)", 1)))


def parse_provider_doc(documents: DataFrame, source: str = "provider_lists") -> DataFrame:
    """Providers named in a document: distinct link hosts first, then distinct names of list and table lines.

    A name equal to a host that was already listed is not repeated.
    """
    urls = F.transform(F.regexp_extract_all("body", F.lit(PROVIDER_URL_PATTERN), F.lit(0)), lambda u: F.rtrim(u, F.lit(".,;")))
    hosts = exploded(documents, urls).withColumns({"label": _url_host(F.col("item")), "part": F.lit(0)}).drop("item")
    rows = lines(documents, [])
    name = F.btrim(F.regexp_extract(F.btrim("line", F.lit(" \t")), PROVIDER_NAME_PATTERN, 1))
    names = rows.withColumns({"label": name, "part": F.lit(1)}).drop("line")
    low = F.lower("label")
    noise = low.isin(*PROVIDER_NOISE) | low.rlike("^(http|---|===)")
    both = hosts.unionByName(names.where(~noise)).where(empty_if_null(F.col("label")) != "").withColumn("_key", low)
    kept = first_per(both, ["payload_id", "_key"], ["part", "pos"])
    kept = kept.withColumn("pos", F.concat(positions(F.col("part")), "pos"))
    link = F.when(F.col("part") == 0, F.concat(F.lit("https://"), "label"))
    return signals(
        kept, source, F.concat(F.lit("LLM provider listed: "), "label"), link, meta_value=meta(service_candidate=True)
    )
