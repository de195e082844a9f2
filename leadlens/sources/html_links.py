"""Listing, deal and directory pages (columns payload_id, body, page_url)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions import html as H
from leadlens.functions.domains import host_without_www, netloc
from leadlens.functions.words import truthy_text
from leadlens.sources.common import exploded, exploded_first, meta, signals, text, trim_chars

# Hosts that are never the listed service, and the offer wording of deal pages.
SOCIAL_HOSTS = ("twitter.com", "x.com", "facebook.com", "linkedin.com", "youtube.com")
LISTING_HOSTS = ("theresanaiforthat.com", "futurepedia.io", "toolify.ai", *SOCIAL_HOSTS)
JOB_HOSTS = ("wellfound.com", "angel.co", "angellist.com", *SOCIAL_HOSTS)
CARD_HOSTS = ("disboard.org", *SOCIAL_HOSTS)
DEAL_PATTERN = (
    r"(?iU)(free trial|free credits?|no credit card|freemium|\d+%\s*off|\$\d+|trial|lifetime deal|free tier|"
    r"free plan|promo code|coupon)"
)


def page_links(pages: DataFrame) -> DataFrame:
    """Every link of every page: payload_id, pos, page_url, item(href, raw_href, text, title)."""
    parsed = pages.withColumn("_links", H.links(F.col("body"), F.col("page_url")))
    return exploded(parsed, F.col("_links"), [c for c in pages.columns if c not in ("body", "payload_id")])


def page_link_rows(pages: DataFrame) -> DataFrame:
    """Every link of every page as a row that a table function yields: payload_id, page_url, pos, href, raw_href, text,
    title.  For pages with very many links; others are as well served by :func:`page_links`."""
    found = H.link_rows(F.col("body").outer(), F.col("page_url").outer())
    return pages.lateralJoin(found).drop("body")


def server_card_rows(pages: DataFrame) -> DataFrame:
    """Every server card as a row of a table function: payload_id, page_url, pos, name, description, hrefs."""
    found = H.card_rows(F.col("body").outer(), F.col("page_url").outer())
    return pages.lateralJoin(found).drop("body")


def parse_listing(
    pages: DataFrame, source: str | Column = "directories", own_hosts=LISTING_HOSTS, candidate: bool = False
) -> DataFrame:
    """One signal per distinct outbound link with text; links to the page's own host and social hosts are left out."""
    parsed = pages.withColumn("_links", H.links(F.col("body"), F.col("page_url")))
    kept = [c for c in pages.columns if c not in ("body", "payload_id")]
    rows = exploded_first(parsed, F.col("_links"), lambda x: x["href"], kept).withColumnRenamed("key", "_href")
    host = host_without_www(F.col("_href"))
    outbound = F.startswith("_href", F.lit("http")) & (host != "") & ~host.isin(*own_hosts)
    rows = rows.where(outbound & (host != host_without_www(F.col("page_url"))))
    raw = trim_chars(F.concat("item.text", F.lit(" "), "item.title"), " \t\n\r")
    rows = rows.withColumn("_raw", raw).where(F.col("_raw") != "")
    flags = meta(service_candidate=True) if candidate else meta()
    return signals(rows, source, F.col("_raw"), F.col("_href"), F.col("page_url"), meta_value=flags, row_key=F.col("_href"))


def parse_job_listing(pages: DataFrame) -> DataFrame:
    return parse_listing(pages, "wellfound", JOB_HOSTS, candidate=True)


def parse_deal_page(pages: DataFrame) -> DataFrame:
    """Outbound links whose anchor or surrounding text speaks of an offer; one per (aggregator, host).

    A link carries its own text and the whole text of the element around it, whatever the number of links in it.  The text
    of an element is held once for a page and joined to its links row by row, after all but the first link to a host are gone.
    """
    wording = DEAL_PATTERN.replace("(?iU)", "(?i)")
    parsed = pages.withColumns({"_page": H.links_in_context(F.col("body"), wording), "_own": F.lower(netloc(F.col("page_url")))})
    target = lambda x: trim_chars(x["href"], " \t\n\r")
    host = lambda x: F.lower(netloc(target(x)))
    offers = F.filter(
        "_page.links",
        lambda x: x["matched"] & F.startswith(target(x), F.lit("http")) & (host(x) != "") & (host(x) != F.col("_own")),
    )
    parsed = parsed.withColumn("_texts", F.col("_page.texts"))
    rows = exploded_first(parsed, offers, host, ["aggregator", "page_url", "_texts"]).withColumnRenamed("key", "_host")
    around = F.get("_texts", F.col("item.element"))
    raw = trim_chars(F.concat(F.col("item.own"), F.lit(" "), around), " \t\n\r")
    return signals(
        rows, F.col("aggregator"), raw, F.concat(F.lit("https://"), "_host"), F.col("page_url"),
        meta_value=meta({"aggregator": F.col("aggregator")}), row_key=F.col("_host"),
    )


def parse_brand_page(pages: DataFrame, source: str = "coupon") -> DataFrame:
    """Title, meta description and 60 characters around the first offer wording of a page about ``brand``."""
    title = F.coalesce(H.title(F.col("body")), F.lit(""))
    meta_pattern = r"(?is)<meta[^>]*name\s*=\s*[\"']description[\"'][^>]*content\s*=\s*[\"'](.*?)[\"']"
    rows = pages.withColumns(
        {
            "_title": H.unescape(title),
            "_desc": H.unescape(F.regexp_extract("body", meta_pattern, 1)),
            "_body": H.visible_text(F.col("body"), None),
        }
    )
    hit = F.regexp_extract("_body", DEAL_PATTERN, 0)
    at = F.instr(F.col("_body"), hit)
    start = F.greatest(at - 1 - 60, F.lit(0))
    end = at - 1 + F.length(hit) + 60
    snippet = F.when(hit != "", F.substring("_body", start + 1, end - start)).otherwise("")
    whole = H.squeeze(F.concat_ws(" ", "_title", "_desc", snippet))
    rows = rows.withColumns({"_text": whole, "pos": F.array(F.lit(0))}).where(F.col("_text").rlike(DEAL_PATTERN))
    return signals(
        rows, source, F.col("_text"), F.concat(F.lit("https://"), "brand"), F.col("page_url"),
        meta_value=meta({"brand": F.col("brand")}),
    )


def parse_server_cards(pages: DataFrame, source: str = "discord_dir") -> DataFrame:
    """Cards with name, description and first external link; one per link, or per text without one."""
    parsed = pages.withColumn("_cards", H.cards(F.col("body"), F.col("page_url")))

    def read(card: Column) -> Column:
        site = F.get(F.filter(
            card["hrefs"],
            lambda u: F.startswith(u, F.lit("http")) & (host_without_www(u) != "") & ~host_without_www(u).isin(*CARD_HOSTS),
        ), F.lit(0))
        body = F.concat(card["name"], F.lit(". "), card["description"])
        return F.struct(site.alias("site"), trim_chars(trim_chars(body, ". "), " \t\n\r").alias("text"))

    cards = F.filter(F.transform("_cards", read), lambda x: (x["text"] != "") | x["site"].isNotNull())
    rows = exploded_first(parsed, cards, lambda x: F.coalesce(truthy_text(x["site"]), x["text"]), ["page_url"])
    return signals(rows, text(source), F.col("item.text"), F.col("item.site"), F.col("page_url"), row_key=F.col("key"))
