"""Credential-safe reading of pasted configuration: lines with secrets are dropped before anything is derived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens import lexicon as lx
from leadlens.functions.domains import netloc
from leadlens.functions.words import has_any
from leadlens.sources.common import exploded, meta, signals

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def redacted(text: Column, key_lines: str = lx.KEY_LINE_PATTERN) -> Column:
    """The text without the lines that hold a credential."""
    return F.array_join(F.filter(F.split(text, LINE_BREAK), lambda line: ~line.rlike(key_lines)), "\n")


def safe_hosts(text: Column, key_lines: str = lx.KEY_LINE_PATTERN) -> Column:
    """Distinct hosts of the URLs in the redacted text, official providers left out."""
    found = F.regexp_extract_all(redacted(text, key_lines), F.lit(lx.SAFE_HOST_PATTERN), F.lit(1))
    hosts = F.transform(found, lambda h: F.btrim(F.lower(h), F.lit("./")))
    return F.array_distinct(
        F.filter(hosts, lambda h: F.contains(h, F.lit(".")) & ~h.isin(*lx.SAFE_HOST_SKIP))
    )


def redact_documents(documents: DataFrame, key_lines: str = lx.KEY_LINE_PATTERN) -> DataFrame:
    """Documents with their text redacted; no other column is derived from the original text."""
    kept = redacted(F.col("text"), key_lines)
    return documents.withColumn("text", kept)


def relevant_file(filename: Column, description: Column) -> Column:
    """A configuration-like file extension and a keyword in name or description."""
    extension = F.when(F.contains(filename, F.lit(".")), F.concat(F.lit("."), F.lower(F.substring_index(filename, ".", -1))))
    blob = F.lower(F.concat(filename, F.lit(" "), F.coalesce(description, F.lit(""))))
    return F.coalesce(extension.isin(*lx.SNIPPET_EXTENSIONS), F.lit(False)) & has_any(blob, lx.SNIPPET_KEYWORDS)


def relevant_title(title: Column, summary: Column) -> Column:
    blob = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit("")))
    return blob.rlike(lx.SNIPPET_TITLE_PATTERN)


def raw_url(link: Column) -> Column:
    """View URL to raw URL: ``/raw`` put before the path unless it is there."""
    site = F.regexp_extract(link, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    rest = F.substring(link, F.length(site) + 1, F.length(link))
    return F.when(F.startswith(rest, F.lit("/raw")) | (netloc(link) == ""), link).otherwise(F.concat(site, F.lit("/raw"), rest))


def host_candidates(snippets: DataFrame, source: str = "pastebin") -> DataFrame:
    """One candidate signal per safe host of a snippet (payload_id, body); nothing else of the text is kept."""
    rows = exploded(snippets, safe_hosts(F.col("body")))
    return signals(
        rows, source, F.concat(F.lit("Paste config: "), "item"), F.concat(F.lit("https://"), "item"),
        meta_value=meta(service_candidate=True),
    )
