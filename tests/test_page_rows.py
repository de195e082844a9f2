"""Page rows are read once, and again only for pages that changed."""

from pyspark.sql import functions as F

from leadlens.functions import html as H
from leadlens.operators import enrich as E
from tests.test_discovery import DDL



def bodies(spark, rows, at="2026-05-01 00:00:00"):
    frame = spark.createDataFrame([(d, p, s, "text/html", None, b) for d, p, b, s in rows], DDL)
    return frame.withColumn("landed_at", F.lit(at).cast("timestamp"))


ROWS = [
    ("a.ai", "/", "<title>A</title><p>claude and more words for a description of this page</p>", 200),
    ("a.ai", "/pricing", "<p>free trial with $30 credits</p>", 200), ("b.ai", "/", "<title>B</title>", 200),
    ("b.ai", "/robots.txt", "Sitemap: https://b.ai/map", 200), ("b.ai", "/map", "<loc>https://b.ai/offer-x</loc><LOC> https://b.ai/free </LOC>", 200),
    ("b.ai", "/free", "<p>free credits: $70</p>", 200), ("c.ai", "/", "gone", 503),
]


def facts(frame):
    return sorted(map(str, frame.collect()))


def test_unchanged_pages_are_not_read(spark):
    first = bodies(spark, ROWS)
    rows = E.page_rows(first).cache()
    again = bodies(spark, ROWS, "2026-05-02 00:00:00")
    assert E.changed_pages(first, rows).count() == 0 == E.changed_pages(first.union(again), rows).count()
    assert facts(E.facts_of(E.page_rows(again, rows))) == facts(E.facts_of(rows)) == facts(E.page_facts(first))


def test_changed_new_and_missing_pages(spark):
    first = bodies(spark, ROWS)
    rows = E.page_rows(first).cache()
    news = [("a.ai", "/pricing", "<p>free trial with $45 credits</p>", 200), ("d.ai", "/", "<title>D</title>", 200), ("c.ai", "/", "gone", 200)]
    later = bodies(spark, news, "2026-05-03 00:00:00")
    changed = {(r["domain"], r["path"]) for r in E.changed_pages(later, rows).collect()}
    assert changed == {("a.ai", "/pricing"), ("d.ai", "/"), ("c.ai", "/")}
    updated = E.page_rows(later, rows)  # pages that did not land again stay
    assert facts(E.facts_of(updated)) == facts(E.page_facts(first.union(later)))
    got = {r["domain"]: r["amount"] for r in E.facts_of(updated).collect()}
    assert got == {"a.ai": 45.0, "b.ai": 70.0, "c.ai": None, "d.ai": None}
    # an older landing changes nothing
    old = bodies(spark, news, "2020-01-01 00:00:00")
    assert E.changed_pages(first.union(old), rows).select("domain").distinct().count() == 1  # d.ai is new


def test_bodies_are_scanned_once(spark, tmp_path):
    bodies(spark, ROWS).write.parquet(str(tmp_path / "bodies"))
    rows = E.page_rows(spark.read.parquet(str(tmp_path / "bodies")))
    assert rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan") == 1


def test_whole_pages_go_by_rows(spark):
    """An Arrow batch holds ten thousand whole pages with all their links; by rows a worker holds a hundred."""
    from leadlens.sources import html_links as HL

    rows = [(i, f"<div class='server-card'><a href='/x{i}'>free trial {i}</a></div>", "https://a.example/") for i in range(3)] + [(3, None, None)]
    pages = spark.createDataFrame(rows, "payload_id bigint, body string, page_url string")
    read = {
        "links": pages.select(H.links(F.col("body"), F.col("page_url")).alias("x")),
        "cards": pages.select(H.cards(F.col("body"), F.col("page_url")).alias("x")),
        "contexts": pages.select(H.links_in_context(F.col("body"), HL.DEAL_PATTERN.replace("U", "", 1)).alias("x")),
    }
    for name, frame in read.items():
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan, name
    found = HL.page_links(pages).select("payload_id", "item.href", "item.text").collect()
    assert sorted(map(tuple, found)) == [(i, f"https://a.example/x{i}", f"free trial {i}") for i in range(3)]
    assert [len(r["x"]["links"]) for r in read["contexts"].collect()] == [1, 1, 1, 0]
