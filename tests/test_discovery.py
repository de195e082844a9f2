"""Page facts, promotion and the batch steps around them."""

from pyspark.sql import functions as F

from leadlens import lexicon as lx
from leadlens import schemas
from leadlens.operators import candidates as C
from leadlens.operators import enrich as E
from leadlens.operators import ingest as I
from leadlens.operators import notify as N
from leadlens.plans import batch as B

DDL = "domain string, path string, status int, content_type string, headers map<string,string>, body string"


def now():
    return F.lit("2026-05-20 00:00:00").cast("timestamp")


def site(spark, *pages):
    """(domain, path, body[, status])."""
    rows = [(d, p, s[0] if s else 200, "application/json" if b.startswith("{") else "text/html", None, b) for d, p, b, *s in pages]
    return spark.createDataFrame(rows, DDL)


def facts(spark, *pages):
    return {r["domain"]: r for r in E.page_facts(site(spark, *pages)).collect()}


def test_every_offer_page_counts(spark):
    got = facts(
        spark,
        ("a.ai", "/", "<title>Alpha</title><p>Claude for everyone, one two three four five six seven</p>"),
        ("a.ai", "/pricing", "<p>Get $50 free credits</p>"), ("a.ai", "/plans", "<p>$900 free credits</p>"),
        ("b.ai", "/", "<title>Beta</title>"), ("b.ai", "/billing", "free trial $20"), ("b.ai", "/redeem", "free trial $800"),
        ("c.ai", "/", "down", 503),
        ("d.ai", "/", "hello", 404),
    )
    # all offer pages are read, whatever others say, and the largest amount stays
    assert (got["a.ai"]["amount"], got["a.ai"]["pricing_triggers"], got["a.ai"]["title"]) == (900.0, True, "Alpha")
    assert got["a.ai"]["models"] == ["claude"]
    assert (got["b.ai"]["amount"], got["b.ai"]["has_pricing"]) == (800.0, True)
    assert got["c.ai"]["alive"] is False and got["d.ai"]["alive"] is True and got["d.ai"]["title"] is None


def test_gateway_endpoints_and_notice(spark):
    got = facts(
        spark,
        ("r.ai", "/", "<p>welcome</p>"), ("r.ai", "/v1/models", '{"data": [{"id": "qwen-max"}, {"id": "local"}]}'),
        ("r.ai", "/api/notice", "注册送 100 额度"),
        ("s.ai", "/", "<p>x</p>"), ("s.ai", "/api/status", '{"data": {"version": "1"}}'),
        ("t.ai", "/", "<p>x</p>"), ("t.ai", "/api/status", '{"ok": true}'),
    )
    r = got["r.ai"]
    assert (r["is_relay"], r["engine"], r["models"], r["amount"], r["pricing_triggers"], r["notice"]) == (
        True, "relay", ["qwen"], 100.0, True, "注册送 100 额度",
    )
    assert (got["s.ai"]["is_relay"], got["t.ai"]["is_relay"]) == (True, False)


def test_listed_pages_count_with_and_without_known_ones(spark):
    pages = [
        ("m.ai", "/", "<p>x</p>"), ("m.ai", "/pricing", "<p>nothing yet</p>"),
        ("m.ai", "/sitemap.xml", "<loc>https://m.ai/about</loc><loc>https://m.ai/free-stuff</loc>"),
        ("m.ai", "/free-stuff", "<p>a free trial worth $30</p>"),
    ]
    got = facts(spark, *pages)["m.ai"]
    assert (got["pricing_triggers"], got["amount"]) == (True, 30.0)
    without = facts(spark, *[p for p in pages if p[1] != "/pricing"])["m.ai"]
    assert (without["pricing_triggers"], without["amount"]) == (True, 30.0)


def test_discovery_run(spark, signals):
    mentions = signals(
        [
            {"source": "forum", "raw_text": "btw zenmux.ai has a free trial of the api"},
            {"source": "forum", "raw_text": "getmerlin.in gives llm access"},
            {"source": "forum", "raw_text": "band.ai is an ai thing"},
            {"source": "forum", "raw_text": "my soup from cooking-blog.com was great"},
        ]
    )
    queue = C.merge_candidates(schemas.empty(spark, "candidates"), I.harvest_candidates(I.normalize(mentions)), now())
    assert {(r["domain"], r["priority"]) for r in queue.collect()} == {("zenmux.ai", "high"), ("getmerlin.in", "normal"), ("band.ai", "normal")}
    assert C.dequeue(queue, 1).first()["domain"] == "zenmux.ai"
    pages = site(
        spark,
        ("zenmux.ai", "/", "<title>ZenMux</title> GPT-4 and Claude, partner https://next-ai.dev"), ("zenmux.ai", "/pricing", "free trial"),
        ("getmerlin.in", "/", "<title>Merlin</title> gemini"), ("getmerlin.in", "/pricing", "credits"),
        ("band.ai", "/", "<title>Band</title> music"),
    )
    tables = {"services": schemas.empty(spark, "services"), "candidates": queue}
    out = B.discovery_step(tables, pages, now())
    assert {(r["canonical_domain"], r["name"], r["status"]) for r in out["services"].collect()} == {("zenmux.ai", "ZenMux", "new"), ("getmerlin.in", "Merlin", "new")}
    status = {r["domain"]: (r["status"], r["attempts"]) for r in out["candidates"].collect()}
    assert status == {"zenmux.ai": ("promoted", 1), "getmerlin.in": ("promoted", 1), "band.ai": ("rejected", 1), "next-ai.dev": ("pending", 0)}
    assert out["counters"].first().asDict() == {
        "probed": 3, "promoted": 2, "rejected": 1, "skipped": 0, "linkgraph_added": 1, "retired": 0,
    }


def test_retire(spark):
    c = schemas.new_rows(spark.createDataFrame([(1, "a.ai", 3), (2, "b.ai", 2)], "id bigint, domain string, attempts int"), "candidates")
    assert [r["status"] for r in C.retire_exhausted(c).orderBy("id").collect()] == ["rejected", "pending"]


def test_maintenance_over_a_snapshot(spark, signals, tmp_path):
    rows = [
        {"source": "nodeseek", "raw_text": "freemodel.dev $150 free credits https://freemodel.dev claude", "source_url": "1", "observed_at": "2026-05-19 23:00:00"},
        {"source": "telegram", "raw_text": "free trial https://chan.dev", "source_url": "https://t.me/chan/7", "observed_at": "2026-05-19 22:00:00"},
    ]
    first, second = str(tmp_path / "1"), str(tmp_path / "2")
    B.IngestJob().run(signals(rows), None, first, now())
    stored = spark.read.schema(schemas.schema("signals")).parquet(f"{first}/signals")
    pages = site(spark, ("freemodel.dev", "/", "<title>New API</title><p>plain</p>"), ("freemodel.dev", "/pricing", "free trial"))
    B.maintenance(spark, first, second, pages, stored, now())
    services = {r["canonical_domain"]: r for r in spark.read.parquet(f"{second}/services").collect()}
    assert (services["freemodel.dev"]["status"], services["freemodel.dev"]["engine"]) == ("active", "new-api")
    assert services["freemodel.dev"]["reliability"] == 0.8 and services["chan.dev"]["last_checked"] is None
    outbox = {r["topic"]: r["text"] for r in spark.read.parquet(f"{second}/outbox").collect()}
    assert set(outbox) == {lx.TOPIC_FORWARDED, lx.TOPIC_AI} and outbox[lx.TOPIC_FORWARDED].startswith("📡 из @chan")
    offers = spark.read.parquet(f"{second}/offers")
    assert offers.where("notified_at IS NULL").count() == 0
    # nothing is announced twice
    assert N.group_batch(offers, spark.read.parquet(f"{second}/services"), stored.withColumn("signal_id", F.col("id"))).count() == 0


def test_single_mode_threshold(spark):
    services = spark.createDataFrame([(1, "a.ai")], "id bigint, canonical_domain string")
    offers = schemas.new_rows(spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.2)], "id bigint, service_id bigint, score double"), "offers")
    box = N.single_batch(offers, services)
    assert [r["offer_id"] for r in box.collect()] == [1]
    assert N.single_batch(N.mark_notified(offers, box, now()), services).count() == 0


def test_newest_landing_counts_and_all_listed_pages_are_read(spark):
    from leadlens.operators import enrich

    robots = "\n".join(f"Sitemap: https://a.example/map{n}.txt" for n in range(6))
    listed = "".join(f"<loc>https://a.example/x{n}/pricing</loc>" for n in range(9))
    rows = [
        ("a.example", "/", 500, "text/html", None, "<title>old</title>", "2024-01-01"),
        ("a.example", "/", 200, "text/html", None, "<title>new</title>", "2024-02-01"),
        ("a.example", "/pricing", 200, "text/html", None, "<p>our plans</p>", "2024-01-01"),
        ("a.example", "/robots.txt", 200, "text/plain", None, robots, "2024-01-01"),
        ("a.example", "/map5.txt", 200, "text/xml", None, listed, "2024-01-01"),
        ("a.example", "/x8/pricing", 200, "text/html", None, "<p>" + "word " * 2000 + "gpt-4o free trial</p>", "2024-01-01"),
    ]
    ddl = "domain string, path string, status int, content_type string, headers map<string,string>, body string, landed_at string"
    facts = enrich.page_facts(spark.createDataFrame(rows, ddl)).collect()
    assert [(f.title, f.alive, f.status) for f in facts] == [("new", True, 200)]
    assert facts[0].pricing_triggers and "gpt" in facts[0].models
