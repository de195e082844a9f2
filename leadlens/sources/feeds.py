"""RSS, RDF and Atom payloads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions.html import clean_markup
from leadlens.functions.words import truthy_text
from leadlens.sources.common import empty_if_null, exploded, first_chars, meta, signals, text, trim_chars

_LINK = "array<struct<_VALUE:string,_href:string,_rel:string>>"
_ITEM = (
    "struct<title:string,description:string,summary:string,`content:encoded`:string,content:string,"
    f"link:{_LINK}>"
)
_SCHEMA = f"channel struct<item:array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ITEM}>, _corrupt string"

# Fixed value: entries of the package index kept for their topic.
PACKAGE_PATTERN = (
    r"(?iU)\b(ai|llm|gpt|openai|anthropic|claude|gemini|chatbot|embeddings?|completand?ions?|inference)\b"
)


@dataclass(frozen=True)
class FeedForm:
    """How a feed becomes signals: fixed source (or the payload's), text cap, meta key for the feed name."""

    source: str | None = None
    cap: int | None = None
    feed_key: str | None = None


# The published feed forms.
FORUM = FeedForm()
LAUNCHES = FeedForm(source="producthunt")
COMMUNITY = FeedForm(source="reddit", feed_key="subreddit")
CHANGELOG = FeedForm(source="changelog", feed_key="feed")


def is_feed(body: Column) -> Column:
    """Feed markup within the first 600 characters."""
    return F.coalesce(F.substring(body, 1, 600).rlike("<rss|<feed"), F.lit(False))


def _parsed(body: Column) -> Column:
    return F.from_xml(body, _SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})


def entries(payloads: DataFrame) -> DataFrame:
    """Entries of every payload: title, summary (raw markup) and link."""
    parsed = payloads.withColumn("_x", _parsed(F.col("body")))
    none = F.array().cast(f"array<{_ITEM}>")
    items = F.concat(*[F.coalesce(c, none) for c in (F.col("_x.channel.item"), F.col("_x.item"), F.col("_x.entry"))])
    rows = exploded(parsed, items, [c for c in payloads.columns if c != "body"])
    item = F.col("item")
    alternate = F.filter(item["link"], lambda k: k["_href"].isNotNull() & (F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"))
    plain = F.filter(item["link"], lambda k: truthy_text(F.trim(k["_VALUE"])).isNotNull())
    any_href = F.filter(item["link"], lambda k: k["_href"].isNotNull())
    pick = lambda links, name: F.get(F.transform(links, lambda k: k[name]), F.lit(0))
    return rows.withColumns(
        {
            "title": item["title"],
            "summary": F.coalesce(item["description"], item["summary"], item["content:encoded"], item["content"]),
            "link": F.coalesce(F.trim(pick(plain, "_VALUE")), pick(alternate, "_href")),
            "any_link": pick(any_href, "_href"),
        }
    ).drop("item")


def unreadable(payloads: DataFrame) -> DataFrame:
    """Payloads that are not well-formed XML, so that none is lost without a trace."""
    return payloads.withColumn("_x", _parsed(F.col("body"))).where(F.col("_x._corrupt").isNotNull()).drop("_x")


def _joined_text(rows: DataFrame) -> DataFrame:
    """``title. summary`` with markup removed."""
    cleaned = rows.withColumns({"title": clean_markup(F.col("title")), "summary": clean_markup(F.col("summary"))})
    return cleaned.withColumn("text", trim_chars(F.concat("title", F.lit(". "), "summary"), " \t\n\r"))


def parse_feed(payloads: DataFrame, form: FeedForm = FORUM) -> DataFrame:
    """Entries as signals.  A payload needs ``source`` when the form has none, ``feed`` when it keeps the name.

    The joining dot makes the text non-empty, so an entry without title, summary and link is kept as ``.``.
    """
    rows = _joined_text(entries(payloads))
    rows = rows.where((F.col("text") != "") | truthy_text(F.col("link")).isNotNull())
    extra = {form.feed_key: F.col("feed")} if form.feed_key else {"feed_title": F.col("title")}
    source = F.col("source") if form.source is None else text(form.source)
    return signals(rows, source, first_chars("text", form.cap), source_url=F.col("link"), meta_value=meta(extra))


def parse_mirror_feed(payloads: DataFrame, cap: int | None = None, canonical: str = "https://twitter.com") -> DataFrame:
    """Timeline feed of a mirror (column ``instance``): links are rewritten to the canonical host."""
    rows = _joined_text(entries(payloads))
    rows = rows.withColumn("text", trim_chars(trim_chars(F.col("text"), ". "), " \t\n\r"))
    link = empty_if_null(F.col("link"))
    moved = F.when(
        truthy_text(F.col("instance")).isNotNull() & (link != ""),
        F.replace(link, F.col("instance"), F.lit(canonical)),
    ).otherwise(link)
    rows = rows.where((F.col("text") != "") | (link != ""))
    return signals(
        rows, "twitter", first_chars("text", cap), source_url=truthy_text(moved),
        meta_value=meta({"via": F.lit("nitter"), "instance": F.col("instance")}),
    )


def parse_package_feed(payloads: DataFrame, source: str = "pypi", cap: int | None = None) -> DataFrame:
    """Package index entries about AI; text is kept as written, the link falls back to the first href."""
    rows = entries(payloads).withColumns({"title": empty_if_null(F.col("title")), "summary": empty_if_null(F.col("summary"))})
    rows = rows.where(F.concat("title", F.lit(" "), "summary").rlike(PACKAGE_PATTERN))
    link = F.coalesce(truthy_text(F.col("link")), F.col("any_link"))
    body = trim_chars(F.concat("title", F.lit(". "), "summary"), " \t\n\r")
    return signals(rows, source, first_chars(body, cap), url=link, source_url=link, meta_value=meta({"registry": F.lit("pypi")}))
