"""Ingest fixtures and properties."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from leadlens import schemas
from leadlens.operators import feed as FD
from leadlens.operators import ingest as I
from leadlens.operators import scoring
from leadlens.plans.batch import IngestJob, read_snapshot
from leadlens.sources import html_links, json_hits
from leadlens.sources.common import meta



def as_of():
    return F.lit("2026-05-20 00:00:00").cast("timestamp")


FREEMODEL = "freemodel.dev $300 free credits register https://freemodel.dev"


def empty_tables(spark):
    return {name: schemas.empty(spark, name) for name in ("signals", "services", "service_aliases", "offers", "lead_metrics")}


def ingest(spark, df, tables=None):
    return I.ingest(I.label_signals(df), tables or empty_tables(spark), as_of())


def test_dedup_and_merge(spark, signals):
    df = signals(
        [
            {"source": "nodeseek", "raw_text": FREEMODEL, "source_url": "https://nodeseek.com/post/1"},
            {"source": "nodeseek", "raw_text": FREEMODEL, "source_url": "https://nodeseek.com/post/1"},
            {"source": "reddit", "raw_text": FREEMODEL, "url": "https://freemodel.dev", "source_url": "https://reddit.com/r/1"},
            {"source": "reddit", "raw_text": "my cat is cute"},
        ]
    )
    out = ingest(spark, df)
    assert out.signals.count() == 2 and out.services.count() == 1 and out.offers.count() == 1
    offer = out.offers.first()
    assert (offer["amount"], offer["currency"], offer["url"]) == (300.0, "USD", "https://freemodel.dev")
    counters = I.pipeline_counters(df).first().asDict()
    assert counters["dup"] == 1 and counters["prefiltered_out"] == 1 and counters["seen"] == 4
    assert counters["offers_created"] == 1 and counters["offers_updated"] == 1


def test_blocked_and_implausible(spark, signals):
    df = signals(
        [
            {"source": "a", "raw_text": "free credits $50", "url": "https://reddit.com/r/x", "source_url": "s1"},
            {"source": "a", "raw_text": "free credits $50", "url": "https://verdent.ai", "source_url": "s2"},
            {"source": "a", "raw_text": "$2500 free trial", "url": "https://hardware-shop.dev", "source_url": "s3"},
        ]
    )
    out = ingest(spark, df)
    assert [r["canonical_domain"] for r in out.services.collect()] == ["verdent.ai"]
    counters = I.pipeline_counters(df).first()
    assert (counters["blocked"], counters["implausible"], counters["offers_created"]) == (1, 1, 1)
    assert out.signals.count() == 2


def test_blocked_row_does_not_make_later_rows_duplicates(spark, signals):
    df = signals(
        [
            {"source": "a", "raw_text": "free credits $50", "url": "https://reddit.com/r/x", "source_url": "s"},
            {"source": "a", "raw_text": "free credits $50", "url": "https://verdent.ai", "source_url": "s"},
            {"source": "a", "raw_text": "free credits $50", "url": "https://reddit.com/r/x", "source_url": "s"},
        ]
    )
    counters = I.pipeline_counters(df).first()
    assert (counters["blocked"], counters["dup"], counters["signals"]) == (1, 1, 1)


def test_candidate_and_alias(spark, signals):
    df = signals(
        [
            {"source": "certstream", "raw_text": "swiftrouter.com", "url": "https://swiftrouter.com", "source_url": "c1", "service_candidate": True, "force_classify": True},
            {"source": "dir", "raw_text": "CoolTool — $50 free credits", "url": "https://app.coolnewtool.ai", "source_url": "l1"},
        ]
    )
    out = ingest(spark, df)
    assert {r["canonical_domain"] for r in out.services.collect()} == {"swiftrouter.com", "coolnewtool.ai"}
    assert [(r["canonical_domain"], r["host"]) for r in out.aliases.collect()] == [("coolnewtool.ai", "app.coolnewtool.ai")]
    assert I.pipeline_counters(df).first()["candidates"] == 1


def test_model_release(spark, signals):
    base = {"source": "huggingface", "model_release": True, "org": "Qwen", "url": "https://huggingface.co/Qwen/m", "model_id": "Qwen/m"}
    cold = signals([{**base, "raw_text": "New model release: Qwen/m", "source_url": "https://huggingface.co/Qwen/m"}])
    assert I.pipeline_counters(cold).first()["prefiltered_out"] == 1
    live = signals([{**base, "raw_text": "New model release: Qwen/m", "source_url": "https://huggingface.co/Qwen/m", "force_classify": True}])
    out = ingest(spark, live)
    service = out.services.first()
    assert (service["canonical_domain"], service["name"], service["status"]) == ("hf/qwen", "qwen", "active")
    assert out.offers.first()["claim_steps"] == "Qwen/m"
    # a live release whose text reads like an offer becomes an ordinary offer of its host
    offer = signals([{**base, "raw_text": "model release with free access", "source_url": "u", "force_classify": True}])
    assert ingest(spark, offer).services.first()["canonical_domain"] == "huggingface.co"


def test_lead_metric(spark, signals):
    rows = [
        {"source": "nodeseek", "raw_text": FREEMODEL, "source_url": "1", "observed_at": "2026-04-30 12:00:00"},
        {"source": "telegram", "raw_text": FREEMODEL, "source_url": "2", "observed_at": "2026-05-13 12:00:00"},
    ]
    assert ingest(spark, signals(rows)).lead_metrics.first()["lead_hours"] == 312.0
    only = ingest(spark, signals(rows[1:])).lead_metrics.first()
    assert only["first_seen_by_us"] is None and only["first_seen_in_aggregator"] is not None and only["lead_hours"] is None


def plain(df):
    return sorted(str(r) for r in df.collect())


def sample(signals):
    texts = [FREEMODEL, "注册送 50刀 https://a.b.ai", "btw zenmux.ai has a free trial", "use code X https://a.b.ai?ref=1", "cats"]
    return signals(
        [
            {"source": f"s{i % 3}", "raw_text": texts[i % 5], "source_url": f"u{i % 7}", "observed_at": f"2026-05-{1 + i % 9:02d} 00:00:00"}
            for i in range(40)
        ]
    )


def test_partitioning_does_not_matter(spark, signals):
    df = sample(signals)
    one, many = ingest(spark, df.coalesce(1)), ingest(spark, df.repartition(7))
    for name in ("signals", "services", "aliases", "offers", "lead_metrics"):
        assert plain(getattr(one, name)) == plain(getattr(many, name)), name


def test_split_runs_equal_one_run(spark, signals, tmp_path):
    """Two runs over a split input give the tables of one run (first_seen and verify times aside)."""
    df = sample(signals)
    job, now = IngestJob(), as_of()
    job.run(df, None, str(tmp_path / "all"), now)
    job.run(df.where("ingest_seq < 20"), None, str(tmp_path / "a"), now)
    stored = spark.read.parquet(str(tmp_path / "a/signals"))
    job.run(df.where("ingest_seq >= 20"), str(tmp_path / "a"), str(tmp_path / "b"), now, stored)
    whole, split = read_snapshot(spark, str(tmp_path / "all")), read_snapshot(spark, str(tmp_path / "b"))
    for name in whole:
        skip = [c for c in ("last_verified_at",) if c in whole[name].columns]
        assert plain(whole[name].drop(*skip)) == plain(split[name].drop(*skip)), name
    # the same input again changes nothing but the verify time
    job.run(df, str(tmp_path / "all"), str(tmp_path / "again"), now, spark.read.parquet(str(tmp_path / "all/signals")))
    again = read_snapshot(spark, str(tmp_path / "again"))
    for name in whole:
        assert plain(whole[name]) == plain(again[name]), name


def test_cross_source_score(spark):
    now = dt.datetime(2026, 5, 20)
    services = spark.createDataFrame([(1, 0.5), (2, 0.5)], "id bigint, reliability double")
    offers = spark.createDataFrame(
        [(i, i, "saas_trial", 100.0, False, now - dt.timedelta(hours=1)) for i in (1, 2)],
        "id bigint, service_id bigint, type string, amount double, referral_required boolean, first_seen_at timestamp",
    )
    rows = [(1, "reddit", "en"), (2, "reddit", "en"), (2, "github", None), (2, "hackernews", None)]
    signals = spark.createDataFrame(rows, "service_id bigint, source string, lang string")
    got = {r["id"]: r["score"] for r in scoring.rescore(offers, services, signals, F.lit(str(now)).cast("timestamp")).collect()}
    assert got[2] / got[1] == pytest.approx(1.30, abs=0.02)
    assert all(0 <= v <= 1 for v in got.values())


def test_score_order_and_early_bonus(spark):
    now = dt.datetime(2026, 5, 20)
    services = spark.createDataFrame([(1, 0.5)], "id bigint, reliability double")
    offers = spark.createDataFrame(
        [(1, 1, "saas_trial", 200.0, False, now), (2, 1, "grant", 10.0, True, now - dt.timedelta(hours=72)), (3, 9, "other", None, None, None)],
        "id bigint, service_id bigint, type string, amount double, referral_required boolean, first_seen_at timestamp",
    )
    zh = spark.createDataFrame([(1, "nodeseek", None)], "service_id bigint, source string, lang string")
    en = spark.createDataFrame([(1, "reddit", None)], "service_id bigint, source string, lang string")
    at = F.lit(str(now)).cast("timestamp")
    early = {r["id"]: r["score"] for r in scoring.rescore(offers, services, zh, at).collect()}
    late = {r["id"]: r["score"] for r in scoring.rescore(offers, services, en, at).collect()}
    assert early[1] > early[2] and early[2] == pytest.approx(late[2] + 0.1, abs=1e-9)
    assert early[3] == late[3]  # an offer without a service still gets a score


def test_feed_fixture(spark):
    services = schemas.new_rows(
        spark.createDataFrame(
            [(1, "freemodel.dev", "FreeModel", "relay", "active", "new-api"), (2, "tiny.ai", "tiny", "saas_trial", "dead", None)],
            "id bigint, canonical_domain string, name string, type string, status string, engine string",
        ),
        "services",
    )
    offers = schemas.new_rows(
        spark.createDataFrame(
            [(1, 1, "relay", 300.0, ["gpt", "claude"], 0.82), (2, 2, "saas_trial", 5.0, None, 0.1)],
            "id bigint, service_id bigint, type string, amount double, models array<string>, score double",
        ),
        "offers",
    )
    signals = spark.createDataFrame([], "signal_id bigint, offer_id bigint, source string, source_url string, observed_at timestamp")
    for request in ({"min_amount": 100.0}, {"type": "relay"}, {"status": "dead"}, {"model": "CLAUDE"}, {"q": "FreeModel"}):
        assert FD.feed(offers, services, signals, FD.FeedFilter(**request)).count() == 1, request
    assert [r["domain"] for r in FD.feed(offers, services, signals).collect()] == ["freemodel.dev", "tiny.ai"]


def test_external_classifier_runs_in_batches(spark, signals):
    """A model takes the place of the rules through mapInPandas; what it returns is coerced to the label type."""
    from leadlens.operators.relabel import coerce_label

    def model(frames):
        for frame in frames:
            labels = [{"is_offer": True, "offer_type": "gift", "amount": float(len(t)), "confidence": 0.9} for t in frame["raw_text"]]
            yield frame[["ingest_seq"]].assign(is_offer=True, offer_type=[v["offer_type"] for v in labels], amount=[v["amount"] for v in labels])

    def classifier(df):
        out = df.select("ingest_seq", "raw_text").mapInPandas(model, "ingest_seq bigint, is_offer boolean, offer_type string, amount double")
        names = "service_name currency claim_steps requirements effort unit topic".split()
        blank = [F.lit(None).cast("string").alias(n) for n in names]
        raw = F.struct(
            "is_offer", "offer_type", "amount", *blank, F.lit(None).cast("array<string>").alias("models"),
            F.lit(None).cast("boolean").alias("referral_required"), F.lit(None).cast(I.X.CONDITIONS_TYPE).alias("conditions"),
            F.lit(0.9).alias("confidence"),
        )
        return df.join(out.select("ingest_seq", coerce_label(raw).alias("label")), "ingest_seq")

    df = signals([{"source": "a", "raw_text": "free credits https://a.ai", "source_url": "1"}])
    row = I.label_signals(df, classifier=classifier).first()
    assert (row["label"]["offer_type"], row["label"]["amount"], row["route"]) == ("other", 25.0, "offer")


# ------------------------------------------------------------------ arrival order
def _code_payloads(spark):
    """Two payloads of one item with 90 fragments, the first with 1,500 URLs: beyond any packed position."""
    def body(p):
        many = " ".join(f"https://u{p}x{n}.ai" for n in range(1_500))
        fragments = [{"fragment": many}] + [{"fragment": f"words {p} {n}"} for n in range(90)]
        return json.dumps({"items": [{"html_url": None, "text_matches": fragments}]})

    return spark.createDataFrame([(p, body(p)) for p in (1, 2)], "payload_id bigint, body string")


def test_rows_beyond_any_packed_position_are_kept(spark):
    rows = json_hits.parse_code_hits(_code_payloads(spark))
    assert rows.count() == 2 * 1_590 == rows.select("ingest_seq", "place").distinct().count()
    assert I.first_per_key(rows).count() == 2 * 1_590


def test_merges_do_not_depend_on_partitions_or_row_order(spark, signals):
    texts = [f"free trial {n} days, no credit card required, sign up" for n in range(40)]
    rows = signals([
        {"source": f"s{n % 3}", "raw_text": t, "url": f"https://a{n % 4}.example.org/p{n}", "source_url": f"https://x/{n % 25}"}
        for n, t in enumerate(texts)
    ]).withColumn("ingest_seq", F.lit(7).cast("bigint")).withColumn("place", F.array(F.lit(1).cast("bigint")))  # ties everywhere
    now = F.lit("2026-01-01").cast("timestamp")
    results = []
    for frame in (rows.coalesce(1), rows.orderBy(F.desc("url")).repartition(5), rows.repartition(3, "raw_text")):
        stored = I.storable(I.label_signals(frame))
        offers = I.merge_offers(schemas.empty(spark, "offers"), stored, now)
        services = I.merge_services(schemas.empty(spark, "services"), stored, now)
        results.append([sorted(map(str, df.collect())) for df in (offers, services, I.stored_signals(stored))])
    assert results[0] == results[1] == results[2] and results[0][0]


def test_every_link_of_a_listing_is_stored(spark):
    page = "<a href='https://one.ai'>One</a><a href='https://two.ai'>Two</a><a href='https://one.ai'>One again</a>"
    pages = spark.createDataFrame([(1, page, "https://list.example/x")], "payload_id bigint, body string, page_url string")
    rows = html_links.parse_listing(pages)
    assert {r["url"] for r in I.first_per_key(rows).collect()} == {"https://one.ai", "https://two.ai"}
    stored = I.stored_signals(I.storable(I.label_signals(rows.withColumn("meta", meta(force_classify=True)))))
    assert stored.count() == 2
    again = I.storable(I.label_signals(rows.withColumn("meta", meta(force_classify=True))), stored)
    assert again.count() == 0


def test_outcomes_of_keys_with_blocked_and_stored_rows(spark):
    def row(seq, key, blocked, route="offer"):
        return ("s", key, f"https://u/{seq}", "t", seq, [seq], None, blocked, route, False, (True,))

    rows = [
        row(1, "k", True), row(2, "k", False), row(3, "k", True), row(4, "k", False),  # blocked, stored, dup, dup
        row(5, "b", True), row(6, "b", True),  # both blocked
        row(7, None, False, "candidate"), row(8, None, True), row(9, "old", False),
    ]
    ddl = (
        "source string, source_url string, url string, raw_text string, ingest_seq bigint, place array<bigint>, "
        "row_key string, blocked boolean, route string, implausible boolean, label struct<is_offer:boolean>"
    )
    routed = spark.createDataFrame(rows, ddl)
    old = spark.createDataFrame([("s", "old")], "source string, source_url string")
    got = I.outcome_counts(routed, old).first().asDict()
    assert got == {
        "classified": 9, "offers": 9, "dup": 3, "blocked": 4, "signals": 2, "implausible": 0, "offer_observations": 1,
        "candidates": 1,
    }
