"""Certificate search results and certificate stream messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlens.functions import domains as D
from leadlens.functions.words import bind, truthy_text
from leadlens.sources.common import first_per, meta, positions, signals

# Search patterns, in the order they are asked.
KEYWORD_PATTERNS = ("%-api.%", "%router%", "%relay%", "%llm%", "%aiproxy%", "%oneapi%", "%freemodel%", "%chatapi%")
SUBDOMAIN_PATTERNS = ("api.%", "console.%", "studio.%", "dashboard.%")
PATHS = ("keyword", "tld", "subdomain")


def path_order(path: Column) -> Column:
    out = F.lit(len(PATHS))
    for i, name in enumerate(PATHS):
        out = F.when(path == name, i).otherwise(out)
    return out


def parse_certificate_hits(entries: DataFrame, per_pattern: int | None = None, source: str = "crtsh") -> DataFrame:
    """Search entries (path, pattern_no, entry_no, name_value) to distinct hosts; entry_no is a number, or an array of numbers.

    The three paths differ in what they accept: keyword hosts are labelled at once; hosts of the harvest zones
    and hosts behind an API-like first label become candidates.  A host counts where it is first met.  All entries
    count, unless the caller asks for the first ``per_pattern`` of each pattern.
    """
    if per_pattern is not None:
        numbered = Window.partitionBy("path", "pattern_no").orderBy("entry_no")
        entries = entries.withColumn("_n", F.row_number().over(numbered)).where(F.col("_n") <= per_pattern)
    names = entries.select("path", "pattern_no", "entry_no", F.posexplode(F.split("name_value", "\n")).alias("name_no", "name"))
    host = F.ltrim(F.btrim("name", F.lit(" \t\r")), F.lit("*."))
    keyword = D.ct_keyword_match(F.col("host"))
    kind = (
        F.when(F.col("path") == "subdomain", "candidate")
        .when(keyword, "force")
        .when((F.col("path") == "tld") & D.has_harvest_tld(F.col("host")), "candidate")
    )
    target = F.when(F.col("path") == "subdomain", D.strip_subdomain_signal(F.col("host"))).otherwise(F.col("host"))
    found = (
        names.withColumn("host", host)
        .where(F.col("host") != "")
        .withColumns({"kind": kind, "target": target, "order": path_order(F.col("path"))})
        .where(F.col("kind").isNotNull())
        .select("target", "kind", "order", "pattern_no", "entry_no", "name_no")
    )
    entry = F.col("entry_no") if found.schema["entry_no"].dataType.typeName() == "array" else positions(F.col("entry_no"))
    kept = first_per(found, ["target"], ["order", "pattern_no", "entry_no", "name_no"])
    place = F.concat(positions(F.col("order"), F.col("pattern_no")), entry, positions(F.col("name_no")))
    rows = kept.withColumns({"payload_id": F.lit(0), "pos": place})
    return host_signals(rows, source, "https://crt.sh/?q=")


def parse_search_answers(payloads: DataFrame) -> DataFrame:
    """Landed search answers (path, pattern_no, body: a JSON list of entries) through :func:`parse_certificate_hits`."""
    found = payloads.withColumn("_j", F.from_json("body", "array<struct<name_value:string>>"))
    entries = found.select(
        "path", "pattern_no", F.col("payload_id").cast("bigint").alias("_answer"), F.posexplode("_j.name_value").alias("_n", "name_value")
    )
    return parse_certificate_hits(entries.withColumn("entry_no", F.array("_answer", F.col("_n").cast("bigint"))))


def host_signals(rows: DataFrame, source: str, locator: str) -> DataFrame:
    """Signals of hosts with their ``kind``: ``force`` also asks for a label."""
    target = F.col("target")
    return signals(
        rows, source, target, F.concat(F.lit("https://"), target), F.concat(F.lit(locator), target),
        meta_value=meta(service_candidate=True, force_classify=F.when(F.col("kind") == "force", True)),
    )


MESSAGE_SCHEMA = "message_type string, data struct<leaf_cert:struct<all_domains:array<string>>>"


def message_hosts(messages: DataFrame, body: str = "body") -> DataFrame:
    """Hosts of certificate messages with their ``kind`` and ``target``; works on batches and streams.

    Other message types and unreadable messages give no rows.
    """
    keep = [c for c in messages.columns if c != body]

    def host(name: Column, pos: Column) -> Column:
        harvest = D.has_harvest_tld(name) | D.has_subdomain_signal(name)
        kind = F.when(truthy_text(name).isNotNull(), F.when(D.ct_keyword_match(name), "force").when(harvest, "candidate"))
        target = lambda k: F.when(k == "force", D.clean_host(name)).otherwise(D.strip_subdomain_signal(name))
        return bind(kind, lambda k: F.when(k.isNotNull(), F.struct(positions(pos).alias("pos"), k.alias("kind"), target(k).alias("target"))))

    # One expression, and only its result is filtered: Spark repeats an expression in each filter that it derives from it.
    hosts = bind(
        F.from_json(body, MESSAGE_SCHEMA),
        lambda m: F.when(m["message_type"] == "certificate_update", F.transform(m["data"]["leaf_cert"]["all_domains"], host)),
    )
    return messages.select(*keep, F.inline_outer(hosts)).where(F.col("kind").isNotNull())


def parse_messages(payloads: DataFrame, source: str = "certstream") -> DataFrame:
    """Landed certificate messages (payload_id, body) as signals, one per host and message."""
    return host_signals(message_hosts(payloads), source, "certstream://")
