"""Registry of payload parsers, table readers and unions.

A parser is registered under one name with its kind, polling interval and mode; a name can be taken once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens import schemas
from leadlens.sources import certificates, channel, feeds, html_links, json_hits, markdown, redact

Parser = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Source:
    name: str
    parse: Parser
    kind: str = "generic"
    interval: int = 900
    mode: str = "poll"
    label: str | None = None
    requires: str | None = None


_REGISTRY: dict[str, Source] = {}


def register(source: Source) -> Source:
    if source.name in _REGISTRY:
        raise ValueError(f"source {source.name!r} is already registered")
    _REGISTRY[source.name] = source
    return source


def registry() -> dict[str, Source]:
    return dict(_REGISTRY)


def registry_frame(spark: SparkSession) -> DataFrame:
    rows = [(s.name, s.label, s.kind, s.mode, s.interval, s.requires) for s in _REGISTRY.values()]
    return spark.createDataFrame(rows, "name string, label string, kind string, mode string, interval int, requires string")


for _source in (
    Source("forum_rss", feeds.parse_feed, "rss", 600),
    Source("producthunt", lambda p: feeds.parse_feed(p, feeds.LAUNCHES), "rss", 1800),
    Source("reddit", lambda p: feeds.parse_feed(p, feeds.COMMUNITY), "rss", 1800),
    Source("changelog_rss", lambda p: feeds.parse_feed(p, feeds.CHANGELOG), "rss", 3600),
    Source("twitter_mirror", feeds.parse_mirror_feed, "rss", 900),
    Source("twitter", json_hits.parse_post_hits, "api", 900),
    Source("hackernews", json_hits.parse_news_hits, "api", 1800),
    Source("github", json_hits.parse_repo_hits, "api", 3600),
    Source("github_code", json_hits.parse_code_hits, "api", 3600),
    Source("github_issues", json_hits.parse_issue_hits, "api", 3600),
    Source("searchdorks", json_hits.parse_web_hits, "api", 3600),
    Source("youtube", json_hits.parse_video_hits, "api", 3600),
    Source("openrouter", json_hits.parse_model_catalogue, "api", 21600),
    Source("huggingface", json_hits.parse_hub, "api", 900),
    Source("npm", json_hits.parse_package_hits, "api", 21600),
    Source("pypi", feeds.parse_package_feed, "rss", 21600),
    Source("appstore", lambda p: json_hits.distinct_apps(json_hits.parse_app_chart(p)), "api", 43200),
    Source("yc", json_hits.parse_company_hits, "api", 86400),
    Source("ph_upcoming", json_hits.parse_launch_graph, "api", 1800),
    Source("fofa", json_hits.parse_host_rows, "api", 900),
    Source("provider_prices", json_hits.parse_price_catalogue, "api", 43200),
    Source("provider_lists", markdown.parse_provider_doc, "api", 43200),
    Source("github_lists", markdown.parse_list, "api", 7200),
    Source("crtsh", certificates.parse_search_answers, "http-poll", 3600),
    Source("directories", html_links.parse_listing, "scraper", 3600),
    Source("wellfound", html_links.parse_job_listing, "scraper", 86400),
    Source("coupon", html_links.parse_deal_page, "scraper", 7200),
    Source("discord_dir", html_links.parse_server_cards, "scraper", 43200),
    Source("leaks", redact.host_candidates, "api", 900),
    Source("telegram", channel.parse_messages, "ingest", 120, "stream"),
    Source("certstream", certificates.parse_messages, "ct-stream", 60, "stream"),
):
    register(_source)


def union_signals(*frames: DataFrame) -> DataFrame:
    """All sources' signals in one frame; missing columns are NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


# ------------------------------------------------------------------ landed files and stored tables
def read_payload_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as payloads, ids from the file name so that a reread gives the same ids; ``landed_at`` is the time of
    the file, which orders payloads before their ids do.  Folders ``name=value`` (collector, source, ...) become columns."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(
        F.xxhash64("_metadata.file_path").alias("payload_id"), F.col("value").alias("body"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("landed_at"),
        *[c for c in files.columns if c != "value"],
    )


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table with its declared schema; columns added since it was written get their defaults."""
    return schemas.with_schema(spark.read.parquet(path), table)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines export of messages: text and first link."""
    rows = spark.read.schema("text string, links array<string>").json(path)
    return rows.select("text", F.get("links", F.lit(0)).alias("url"))
