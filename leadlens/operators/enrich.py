"""Page facts from landed pages, and the service and offer updates they cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens import lexicon as lx
from leadlens.functions import html as H
from leadlens.functions import pagefacts as P
from leadlens.functions.score import hours_between, reliability
from leadlens.functions.words import truthy_array, truthy_number, truthy_text
from leadlens.schemas import with_schema
from leadlens.session import checkpointed

_OFFER_PATHS = (*lx.OFFER_PATHS_PRIMARY, *lx.OFFER_PATHS_SECONDARY)
_GATEWAY_PATHS = (lx.RELAY_STATUS_PATH, lx.RELAY_MODELS_PATH, lx.RELAY_NOTICE_PATH)
# files for machines; the paths that a robots file names as sitemaps come on top
_FILES = r"(?i)^/robots\.txt$|\.xml(\.gz)?$"


def _digest() -> Column:
    """Of all that facts are read from."""
    return F.sha2(F.to_json(F.struct("status", "content_type", F.map_entries("headers").alias("headers"), "body")), 256)


def _age(page_bodies: DataFrame) -> Column:
    """Smaller for a later landing; equal without landing times."""
    if "landed_at" not in page_bodies.columns:
        return F.lit(0).cast("bigint")
    return -F.coalesce(F.unix_micros(F.col("landed_at").cast("timestamp")), F.lit(0))


def _local_path(url: Column) -> Column:
    return F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")


def _keyed(page_bodies: DataFrame) -> DataFrame:
    return page_bodies.withColumns({"digest": _digest(), "age": _age(page_bodies)})


def changed_pages(page_bodies: DataFrame, previous: DataFrame) -> DataFrame:
    """domain, path and digest of the pages whose newest landing differs from what ``previous`` page rows were read from."""
    newest = _keyed(page_bodies).groupBy("domain", "path").agg(F.min_by("digest", F.struct("age", "digest")).alias("digest"))
    return newest.join(previous.select("domain", "path", "digest"), ["domain", "path", "digest"], "left_anti")


def page_rows(page_bodies: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """What is read off each page by itself, in one pass over the bodies: domain, path, digest, page.

    Of the landings of a page the newest counts.  With the ``previous`` page rows only pages whose content changed are read;
    rows of other pages, landed again or not, stay as they are.
    """
    if previous is None:
        return _read(_keyed(page_bodies))
    changed = checkpointed(changed_pages(page_bodies, previous))  # keys only
    read = _read(_keyed(page_bodies).join(changed, ["domain", "path", "digest"], "left_semi"))
    return previous.join(changed.select("domain", "path"), ["domain", "path"], "left_anti").unionByName(read)


def _read(keyed: DataFrame) -> DataFrame:
    path, ok = F.col("path"), F.col("status") == 200
    js = ok & F.contains(F.coalesce("content_type", F.lit("")), F.lit("json"))
    root, gateway = path == "/", path.isin(*_GATEWAY_PATHS)
    rows = keyed.withColumn("_body", F.when(F.col("status") < 400, F.coalesce("body", F.lit(""))).otherwise(""))
    rows = rows.select(
        "domain", "path", "digest", "age", "status", ok.alias("ok"), "_body", "headers", js.alias("_js"),
        H.title(F.col("_body")).alias("title"),
        H.description(F.col("_body")).alias("description"),
        H.visible_text(F.col("_body"), None).alias("text"),
    )
    empty = F.lit("")
    notice = F.when((path == lx.RELAY_NOTICE_PATH) & F.col("ok"), truthy_text(F.col("text")))
    ids = F.when((path == lx.RELAY_MODELS_PATH) & F.col("_js"), truthy_array(P.model_ids(F.col("_body"))))
    own = F.concat_ws(" ", F.when(root, F.coalesce("title", empty)), F.coalesce("description", empty), F.coalesce("text", empty))
    spoken = root | (~gateway & F.col("ok"))
    rows = rows.withColumns(
        {
            "notice": notice, "ids": ids,
            "facts": F.coalesce(F.when(spoken, own), notice, F.array_join(ids, " "), empty),
        }
    )
    none = F.lit(None).cast("array<string>")
    page = F.struct(
        "status", "ok", "title", "description", "notice", "ids",
        P.detect_engine(F.col("_body"), F.col("headers")).alias("engine"),
        (F.col("ok") & P.has_pricing_trigger(F.col("_body"))).alias("trigger"),
        F.coalesce(P.has_pricing_trigger(F.col("notice")), F.lit(False)).alias("told"),
        ((path == lx.RELAY_STATUS_PATH) & F.col("_js") & P.is_relay_status(F.col("_body"))).alias("relay_status"),
        P.detect_models(F.col("facts")).alias("models"),
        P.detect_amount(F.col("facts")).alias("amount"),
        F.when((path == "/robots.txt") & F.col("ok"), P.sitemap_lines(F.col("_body"))).otherwise(none).alias("maps"),
        F.when(F.col("ok") & F.contains(F.lower("_body"), F.lit("<loc>")), P.offer_urls(F.col("_body"), None)).otherwise(none).alias("listed"),
    )
    return rows.select("domain", "path", "digest", F.struct("age", "digest").alias("at"), page.alias("page")).groupBy("domain", "path").agg(
        F.min_by(F.struct("digest", "page"), "at").alias("_newest")
    ).select("domain", "path", "_newest.digest", "_newest.page")


def page_facts(page_bodies: DataFrame) -> DataFrame:
    """One row of facts per domain, from all pages landed for it; the bodies are read once."""
    return facts_of(checkpointed(page_rows(page_bodies)))


def facts_of(rows: DataFrame) -> DataFrame:
    """One row of facts per domain, from ``page_rows``.

    Models and amount are read off the home page, the gateway endpoints and every other page with status 200, each page
    by itself. Prices and offer words count on the known offer paths, on the pages that sitemaps list, and on other pages
    with an offer path. The order of the pages only chooses the description: home page, known offer paths, listed pages,
    the rest by path.
    """
    robots = rows.where(F.col("path") == "/robots.txt").select("domain", "page.maps")
    maps = F.concat(
        F.transform(F.coalesce("maps", F.array().cast("array<string>")), _local_path), F.array(F.lit("/sitemap.xml"))
    )
    maps = rows.select("domain").distinct().join(robots, "domain", "left").select(
        "domain", F.posexplode(F.array_distinct(maps)).alias("map_no", "path")
    )
    is_map = maps.select("domain", "path", F.lit(True).alias("is_map"))
    listed = (
        rows.where(F.col("page.listed").isNotNull()).select("domain", "path", "page.listed").join(maps, ["domain", "path"])
        .select("domain", "map_no", F.posexplode("listed").alias("url_no", "url"))
        .select("domain", F.struct("map_no", "url_no").alias("at"), _local_path(F.col("url")).alias("path"))
        .groupBy("domain", "path").agg(F.min("at").alias("at"))
    )
    rows = rows.join(is_map, ["domain", "path"], "left").join(listed, ["domain", "path"], "left")
    path, no = F.col("path"), F.lit(False)
    known = F.array_position(F.array(*[F.lit(x) for x in _OFFER_PATHS]), path)
    local = F.regexp_replace(path, r"[?#].*$", "")
    root, gateway = path == "/", path.isin(*_GATEWAY_PATHS)
    is_file = F.col("is_map").isNotNull() | path.rlike(_FILES)
    other = ~root & ~gateway & F.col("page.ok") & ~is_file
    offer = other & ((known > 0) | F.col("at").isNotNull() | local.rlike(lx.OFFER_URL_PATTERN))
    rows = rows.where(root | gateway | (known > 0) | other).select(
        "domain",
        F.when(root, F.struct("page.status", "page.title", "page.engine")).alias("home"),
        offer.alias("offer"),
        (offer & F.col("page.trigger")).alias("trigger"),
        F.col("page.notice").alias("notice"),
        F.col("page.told").alias("told"),
        (F.col("page.relay_status") | F.coalesce(F.size("page.ids") > 0, no)).alias("is_relay"),
        F.when(root | other, truthy_text(F.col("page.description"))).alias("description"),
        F.struct(
            ~root, F.when(known > 0, known).otherwise(len(_OFFER_PATHS) + 1), F.col("at").isNull(), F.col("at"), path
        ).alias("order"),
        F.when(root | gateway | other, F.col("page.models")).alias("models"),
        F.when(root | gateway | other, F.col("page.amount")).alias("amount"),
    )
    label = lambda name: F.max(F.array_contains("models", name))
    names = list(dict.fromkeys(v for _, v in (*lx.PAGE_MODEL_TOKENS, *lx.PAGE_MODEL_BOUNDED)))
    out = rows.groupBy("domain").agg(
        F.max("home").alias("home"),
        F.max("offer").alias("has_pricing"),
        F.max("trigger").alias("trigger"),
        F.max("notice").alias("notice"),
        F.max("told").alias("told"),
        F.max(F.coalesce("is_relay", no)).alias("is_relay"),
        F.min_by("description", F.when(F.col("description").isNotNull(), F.col("order"))).alias("description"),
        F.array_compact(F.array(*[F.when(label(name), F.lit(name)) for name in names])).alias("models"),
        F.max("amount").alias("amount"),
    )
    return with_schema(
        out.select(
            "domain",
            F.coalesce(F.col("home.status") < 500, no).alias("alive"),
            F.col("home.status").alias("status"),
            F.col("home.title").alias("title"),
            F.coalesce("home.engine", F.when(F.col("is_relay"), "relay")).alias("engine"),
            F.coalesce("has_pricing", no).alias("has_pricing"),
            (F.coalesce("trigger", no) | F.coalesce("told", no)).alias("pricing_triggers"),
            "description",
            "models",
            "amount",
            "is_relay",
            F.when(F.col("told"), F.substring("notice", 1, 300)).alias("notice"),
        ),
        "page_facts",
    )


def earliest_certificate(certificates: DataFrame) -> DataFrame:
    """Earliest readable ``not_before`` per domain."""
    return certificates.groupBy("domain").agg(F.min(F.col("not_before").try_cast("timestamp")).alias("first_certificate"))


def enrich_services(
    services: DataFrame, facts: DataFrame, as_of: Column, certificates: DataFrame | None = None
) -> DataFrame:
    """Status, engine, reliability and check time of the services that have facts; a known domain age is kept."""
    f = facts.select(
        F.col("domain").alias("canonical_domain"), F.lit(True).alias("_probed"), "alive", "has_pricing",
        F.col("engine").alias("_engine"),
    )
    out = services.join(f, "canonical_domain", "left")
    if certificates is not None:
        ages = earliest_certificate(certificates).withColumnRenamed("domain", "canonical_domain")
        out = out.join(ages, "canonical_domain", "left")
    else:
        out = out.withColumn("first_certificate", F.lit(None).cast("timestamp"))
    probed = F.coalesce("_probed", F.lit(False))
    age = F.coalesce("domain_first_seen", "first_certificate")
    trust = reliability(F.col("alive"), F.col("has_pricing"), F.col("_engine").isNotNull(), hours_between(as_of, age) / 24)
    take = lambda new, old: F.when(probed, new).otherwise(F.col(old))
    out = out.withColumns(
        {
            "status": take(F.when(F.col("alive"), "active").otherwise("dead"), "status"),
            "engine": take(F.col("_engine"), "engine"),
            "reliability": take(trust, "reliability"),
            "domain_first_seen": take(age, "domain_first_seen"),
            "last_checked": take(as_of.cast("timestamp"), "last_checked"),
        }
    )
    return with_schema(out, "services")


def enrich_offers(offers: DataFrame, facts: DataFrame) -> DataFrame:
    """Description overwritten when the page gives one; models and amount filled only where missing."""
    f = facts.select(
        F.col("domain").alias("canonical_domain"),
        F.coalesce(truthy_text(F.col("description")), truthy_text(F.col("title"))).alias("_description"),
        truthy_array(F.col("models")).alias("_models"),
        F.col("amount").alias("_amount"),
    )
    out = offers.join(f, "canonical_domain", "left").withColumns(
        {
            "description": F.coalesce("_description", "description"),
            "models": F.coalesce(truthy_array(F.col("models")), F.col("_models"), F.col("models")),
            "amount": F.coalesce(truthy_number(F.col("amount")), F.col("_amount"), F.col("amount")),
        }
    )
    return with_schema(out, "offers")


def stale_services(services: DataFrame, offers: DataFrame, as_of: Column, stale_hours: float = 24.0, limit: int | None = None) -> DataFrame:
    """Services never checked, checked too long ago, or with an offer that lacks a description."""
    cutoff_micros = F.unix_micros(as_of.cast("timestamp")) - int(stale_hours * 3.6e9)
    bare = offers.where(F.col("description").isNull()).select(F.col("service_id").alias("id")).distinct()
    flagged = services.join(bare.withColumn("_bare", F.lit(True)), "id", "left")
    old = F.col("last_checked").isNull() | (F.unix_micros(F.col("last_checked").cast("timestamp")) < cutoff_micros)
    out = flagged.where(old | F.col("_bare").isNotNull()).drop("_bare")
    return out if limit is None else out.orderBy("id").limit(limit)
