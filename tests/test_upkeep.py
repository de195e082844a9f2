"""Relabel and purge jobs over written snapshots."""

from pyspark.sql import functions as F

from leadlens.functions.text import CONDITIONS_TYPE
from leadlens.plans import batch as B

ROWS = [
    {"source": "reddit", "raw_text": "apples.dev $40 free credits, register at https://apples.dev", "source_url": "https://r.example/1"},
    {"source": "reddit", "raw_text": "pears.dev $70 free credits, register at https://pears.dev", "source_url": "https://r.example/2"},
]


def now():
    return F.lit("2026-05-20 00:00:00").cast("timestamp")


def landed(spark, signals, tmp_path):
    folder = str(tmp_path / "first")
    B.IngestJob().run(signals(ROWS), None, folder, now())
    return folder, spark.read.parquet(f"{folder}/signals")


def by_domain(spark, folder):
    return {r["canonical_domain"]: r for r in B.read_snapshot(spark, folder)["offers"].collect()}


def test_relabel_writes_new_labels_and_scores(spark, signals, tmp_path):
    first, stored = landed(spark, signals, tmp_path)
    before = by_domain(spark, first)
    assert set(before) == {"apples.dev", "pears.dev"}
    raw = (
        "struct<is_offer:boolean,service_name:string,offer_type:string,amount:double,currency:string,models:array<string>,"
        "claim_steps:string,requirements:string,referral_required:boolean,effort:string,unit:string,topic:string,"
        f"conditions:{CONDITIONS_TYPE},confidence:double>"
    )
    label = (True, None, "no such type", 400.0, "USD", ["qwen"], None, None, True, None, None, None, None, 0.9)
    external = spark.createDataFrame([(before["apples.dev"]["id"], label)], f"id bigint, raw {raw}")
    second = str(tmp_path / "second")
    B.relabel(spark, first, second, stored, now(), external)
    after = by_domain(spark, second)
    changed = after["apples.dev"]
    assert (changed["amount"], changed["type"], changed["models"], changed["referral_required"]) == (400.0, "other", ["qwen"], True)
    assert changed["score"] != before["apples.dev"]["score"]
    assert after["pears.dev"]["amount"] == 70.0
    for name in ("services", "service_aliases", "lead_metrics", "candidates"):
        one, two = (B.read_snapshot(spark, f)[name] for f in (first, second))
        assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty(), name


def test_purge_removes_a_blocked_service_everywhere(spark, signals, tmp_path):
    first, stored = landed(spark, signals, tmp_path)
    second = str(tmp_path / "second")
    B.purge(spark, first, second, stored, blocked=("apples.dev",))
    assert set(by_domain(spark, second)) == {"pears.dev"}
    tables = B.read_snapshot(spark, second)
    service = tables["services"].first()
    assert tables["services"].count() == 1 and service["canonical_domain"] == "pears.dev"
    assert {r["service_id"] for r in tables["service_aliases"].collect()} <= {service["id"]}
    left = spark.read.parquet(f"{second}/signals").collect()
    assert [r["service_id"] for r in left] == [service["id"]]
    assert spark.read.parquet(f"{second}/counters").first().asDict() == {"services": 1, "offers": 1, "signals": 1}


def test_jobs_over_an_empty_snapshot(spark, signals, tmp_path):
    first = str(tmp_path / "none")
    B.IngestJob().run(signals([]), None, first, now())
    stored = spark.read.parquet(f"{first}/signals")
    B.relabel(spark, first, str(tmp_path / "a"), stored, now())
    B.purge(spark, first, str(tmp_path / "b"), stored)
    assert all(t.isEmpty() for f in ("a", "b") for t in B.read_snapshot(spark, str(tmp_path / f)).values())
