"""Facts read off page text: model names, credit amount, gateway engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlens import lexicon as lx
from leadlens.functions.html import title
from leadlens.functions.words import bind, first_label, has_any, literals


def detect_models(text: Column) -> Column:
    """Canonical model labels: plain tokens first, then short tokens that need non-letter neighbours."""
    pairs = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(v).alias("label")) for t, v in lx.PAGE_MODEL_TOKENS])

    def scan(blob: Column) -> Column:
        plain = F.transform(F.filter(pairs, lambda p: F.contains(blob, p["token"])), lambda p: p["label"])
        bounded = [
            F.when(blob.rlike(rf"(?<![a-z]){token}(?![a-z])"), F.lit(label)) for token, label in lx.PAGE_MODEL_BOUNDED
        ]
        return F.array_distinct(F.concat(plain, F.array_compact(F.array(*bounded))))

    return bind(F.lower(F.coalesce(text, F.lit(""))), scan)


def _largest_near_trigger(text: Column, low: Column, pattern: str) -> Column:
    """Largest plausible amount of one pattern with a trigger word close by.

    Matches come in text order and do not overlap, so the next match starts at the first occurrence of its own
    text after the previous one; that recovers the position Spark's find-all does not return.
    """
    span = lx.PAGE_AMOUNT_WINDOW
    lowest, highest = lx.PAGE_AMOUNT_RANGE
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    number = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    start = F.struct(F.lit(0).alias("end"), F.lit(None).cast("double").alias("best"))

    def step(acc: Column, match: Column) -> Column:
        at = F.call_function("locate", match["whole"], text, acc["end"] + 1)
        end = at - 1 + F.length(match["whole"])
        left = F.greatest(at - 1 - span, F.lit(0))
        around = F.substring(low, left + 1, end + span - left)
        value = F.regexp_replace(match["number"], "[, ]", "").try_cast("double")
        fits = value.between(lowest, highest) & has_any(around, lx.PAGE_AMOUNT_TRIGGERS)
        best = F.when(fits, F.greatest(acc["best"], value)).otherwise(acc["best"])
        return F.struct(end.cast("int").alias("end"), best.alias("best"))

    pairs = F.arrays_zip(whole.alias("whole"), number.alias("number"))
    return F.aggregate(pairs, start, step, lambda acc: acc["best"])


def detect_amount(text: Column) -> Column:
    """Largest free-credit amount: a number in range with an offer word within 40 characters."""

    def scan(body: Column) -> Column:
        largest = lambda low: F.greatest(*[_largest_near_trigger(body, low, p) for p in lx.PAGE_AMOUNT_PATTERNS])
        return F.when(body.rlike(r"\d"), bind(F.lower(body), largest))

    return bind(F.coalesce(text, F.lit("")), scan)


def detect_engine(page_html: Column, headers: Column | None = None) -> Column:
    """Engine by exact page title, else by marks in the page or its headers."""
    name = F.lower(title(page_html))
    by_title = F.lit(None).cast("string")
    for exact, engine in lx.ENGINE_TITLES.items():
        by_title = F.when(name == exact, engine).otherwise(by_title)
    blob = F.lower(F.coalesce(page_html, F.lit("")))
    if headers is not None:
        pairs = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
        blob = F.concat(blob, F.lit(" "), F.lower(F.coalesce(F.array_join(pairs, " "), F.lit(""))))
    return F.coalesce(by_title, first_label(blob, lx.ENGINE_MARKS))


def has_pricing_trigger(text: Column) -> Column:
    return has_any(F.lower(text), lx.PRICING_TRIGGERS)


def sitemap_lines(robots: Column) -> Column:
    """Targets of the ``Sitemap:`` lines of a robots file."""
    lines = F.transform(F.split(robots, r"\r\n|\n|\r"), lambda s: F.btrim(s, F.lit(" \t")))
    hits = F.filter(lines, lambda s: F.startswith(F.lower(s), F.lit("sitemap:")))
    targets = F.transform(hits, lambda s: F.btrim(F.regexp_replace(s, r"^[^:]*:", ""), F.lit(" \t")))
    return F.filter(targets, lambda s: s != "")


def offer_urls(sitemap: Column, limit: int | None = None) -> Column:
    """Distinct sitemap locations whose path names an offer page, all or the first ``limit``."""
    locs = F.regexp_extract_all(sitemap, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    path = lambda u: F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"[?#].*$", "")
    kept = F.filter(locs, lambda u: (u != "") & path(u).rlike(lx.OFFER_URL_PATTERN))
    return F.array_distinct(kept) if limit is None else F.slice(F.array_distinct(kept), 1, limit)


def model_ids(body: Column) -> Column:
    """Ids of an OpenAI-style model list; empty for other bodies."""
    parsed = F.from_json(body, "struct<data:array<struct<id:string>>>")
    ids = F.transform(parsed["data"], lambda m: F.coalesce(m["id"], F.lit("")))
    return F.coalesce(ids, literals([]))


def is_relay_status(body: Column) -> Column:
    """A status body that is a JSON object with ``data`` or ``version``."""
    keys = F.json_object_keys(F.when(F.try_parse_json(body).isNotNull() & F.btrim(body).startswith("{"), body))
    return F.coalesce(F.arrays_overlap(keys, literals(["data", "version"])), F.lit(False))
