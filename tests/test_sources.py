"""Payload fixtures: one small payload per parser."""

import json

from pyspark.sql import functions as F

from leadlens.operators import admin as A
from leadlens.sources import channel as CH
from leadlens.sources import feeds as FE
from leadlens.sources import html_links as HL
from leadlens.sources import json_hits as J
from leadlens.sources import markdown as MD
from leadlens.sources import redact as R
from leadlens.sources import registry as RG


def payload(spark, *bodies, **columns):
    rows = [(i, b if isinstance(b, str) else json.dumps(b), *columns.values()) for i, b in enumerate(bodies)]
    ddl = "payload_id bigint, body string" + "".join(f", {c} string" for c in columns)
    return spark.createDataFrame(rows, ddl)


def rows(df):
    return df.orderBy("ingest_seq", "place").collect()


def test_feed_and_unreadable(spark):
    rss = "<rss><channel><item><title>新中转站上线 注册送 $20 额度</title><link>https://nodeseek.com/1</link></item></channel></rss>"
    p = payload(spark, rss, "<rss><item>", source="nodeseek")
    got = rows(FE.parse_feed(p))
    assert len(got) == 1 and got[0]["source_url"] == "https://nodeseek.com/1" and "注册送" in got[0]["raw_text"]
    assert [r["payload_id"] for r in FE.unreadable(p).collect()] == [1]


def test_launch_feed(spark):
    rss = "<rss><channel><item><title>Foo</title><description>&lt;b&gt;Launch&lt;/b&gt; with free trial credits</description><link>l</link></item></channel></rss>"
    got = rows(FE.parse_feed(payload(spark, rss), FE.LAUNCHES))
    assert [(r["source"], r["raw_text"]) for r in got] == [("producthunt", "Foo. Launch  with free trial credits")]


def test_listing(spark):
    html = (
        '<a href="/inner">in</a><a href="https://twitter.com/x">t</a>'
        '<a href="https://coolnewtool.ai">CoolTool — $50 free credits</a><a href="https://empty.ai"></a>'
    )
    got = rows(HL.parse_listing(payload(spark, html, page_url="https://betalist.com/"), "betalist"))
    assert [(r["url"], r["raw_text"]) for r in got] == [("https://coolnewtool.ai", "CoolTool — $50 free credits")]


def test_deal_page_reads_raw_links_only(spark):
    html = '<p>Gumloop 20% off <a href="https://gumloop.com/x">go</a> <a href="//other.com/y">o</a></p><p><a href="https://no.com">plain</a></p>'
    got = rows(HL.parse_deal_page(payload(spark, html, page_url="https://appsumo.com/b", aggregator="appsumo")))
    assert [(r["url"], r["source"]) for r in got] == [("https://gumloop.com", "appsumo")]


def test_json_parsers(spark):
    repo = rows(J.parse_repo_hits(payload(spark, {"items": [{"full_name": "a/b", "homepage": "https://h.dev", "html_url": "g"}, {"full_name": "c/d"}]})))
    assert [r["url"] for r in repo] == ["https://h.dev"]
    web = rows(J.parse_web_hits(payload(spark, {"items": [{"title": "t", "link": "https://w"}, {"title": "no link"}]})))
    assert len(web) == 1
    video = rows(J.parse_video_hits(payload(spark, {"items": [{"id": {"videoId": "abc123"}, "snippet": {"title": "t"}}, {"id": {"channelId": "c"}}]})))
    assert [r["url"] for r in video] == ["https://youtu.be/abc123"]
    news = rows(J.parse_news_hits(payload(spark, *[{"hits": [{"title": "Free", "url": "https://a.ai", "objectID": "1"}]}] * 2)))
    assert [r["url"] for r in news] == ["https://a.ai"] * 2
    models = rows(J.parse_model_catalogue(payload(spark, {"data": [{"id": "deepseek/chat"}, {"id": "mistralai/m", "name": "M"}]})))
    assert [r["meta"]["extra"]["provider"] for r in models] == ["deepseek", "mistralai"]
    hub = [{"id": "zai-org/GLM"}, {"id": "Qwen/Q", "inference": "warm"}, {"id": "user/x"}, {"id": "noslash"}]
    got = rows(J.hub_signals(J.hub_models(payload(spark, hub))))
    assert [(r["meta"]["org"], r["meta"]["force_classify"]) for r in got] == [("zai-org", None), ("qwen", True)]
    assert "free access" in got[1]["raw_text"]
    chart = {"feed": {"results": [{"name": "AI Chat", "url": "u1"}, {"name": "GPT", "url": "u2"}, {"name": "Clock", "url": "u3"}]}}
    assert {r["url"] for r in J.distinct_apps(J.parse_app_chart(payload(spark, chart, chart, chart))).collect()} == {"u1", "u2"}
    prices = rows(J.parse_price_catalogue(payload(spark, {"sample_spec": {}, "OpenAI/x": {"litellm_provider": "openai"}, "m": {"litellm_provider": "Groq"}})))
    assert [r["raw_text"] for r in prices] == ["LLM provider listed: OpenAI", "LLM provider listed: Groq"]
    assert rows(J.parse_news_hits(payload(spark, "not json", {"other": 1}))) == []


def test_redaction_leaves_no_token(spark):
    text = "base_url=https://relay.example.net/v1\napi_key = abcdefghijkl1234 https://other.example.net\nBearer abcdefghijklmnop"
    df = payload(spark, text)
    out = R.host_candidates(df).collect()
    assert [r["url"] for r in out] == ["https://relay.example.net"]
    assert "abcdefgh" not in str(out)
    assert "abcdefgh" not in str(df.select(R.redacted(F.col("body"))).collect())


def test_markdown(spark):
    text = "| [A](https://a.ai) | x |\n* https://github.com/x\n* again https://www.a.ai/2\n"
    got = rows(MD.parse_list(payload(spark, text, source="ghlist", repo="o/r")))
    assert [(r["url"], r["source_url"]) for r in got] == [("https://a.ai", "https://github.com/o/r")]


def test_channel_message(spark):
    message = {"channel": "chan", "msg_id": 412, "date": "2026-05-01 00:00:00", "text": "free $50 api credits", "forward": {"title": "Up"}}
    df = spark.createDataFrame([(json.dumps(message),)], "j string").select(F.from_json("j", CH.MESSAGE_TYPE).alias("m")).select("m.*")
    row = CH.message_signals(df).first()
    assert row["source_url"] == "https://t.me/chan/412" and row["meta"]["channel"] == "chan"
    assert row["meta"]["forward_from"] == "Up"
    config = spark.createDataFrame([("chan", 5)], "channel string, topic_id bigint")
    assert CH.on_topic(df, config).count() == 0 and CH.on_topic(df, config.limit(0)).count() == 1


def test_landed_files_have_stable_ids(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"hits": [{"title": "x", "url": "https://a.ai"}]}))
    first = RG.read_payload_files(spark, str(tmp_path)).collect()
    again = RG.read_payload_files(spark, str(tmp_path)).collect()
    assert first == again and first[0]["landed_at"] is not None
    (tmp_path / "export").mkdir()
    (tmp_path / "export" / "m.jsonl").write_text('{"text": "t", "links": ["https://l"]}\n{"text": "u", "links": []}\n')
    assert [r["url"] for r in RG.read_export(spark, str(tmp_path / "export")).orderBy("text").collect()] == ["https://l", None]


def test_registry_rejects_a_second_source_of_one_name():
    import pytest

    with pytest.raises(ValueError):
        RG.register(RG.Source("reddit", FE.parse_feed))


def test_signals_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "t", "2026-05-01 10:00:00")], "id bigint, source string, raw_text string, observed_at string")
    A.append_signals(df, str(tmp_path / "signals"))
    A.append_signals(df, str(tmp_path / "signals"))
    assert A.read_signals(spark, str(tmp_path / "signals")).count() == 2
    assert (tmp_path / "signals" / "dt=2026-05-01").exists()


def test_a_page_of_many_links_is_parsed_in_linear_space(spark):
    import re

    from leadlens.functions import html as H
    from leadlens.sources import html_links

    links = " ".join(f"<a href='https://s{n % 700}.ai/x'>tool {n} is here</a>" for n in range(2_000))
    page = f"<div><p>{links} and at the very end a free trial</p></div>"
    pages = spark.createDataFrame(
        [(1, page, "https://deals.example/x", "deals")], "payload_id bigint, body string, page_url string, aggregator string"
    )
    deals = html_links.parse_deal_page(pages).collect()
    assert len(deals) == 700  # the wording far behind the links counts, each host once
    found = H._contexts_of(page, re.compile(html_links.DEAL_PATTERN.replace("U", "", 1)))
    assert sum(map(len, found["texts"])) + sum(len(x["own"]) for x in found["links"]) <= 2 * len(page)
    assert all(r["raw_text"].endswith("and at the very end a free trial") for r in deals)
    first = min(deals, key=lambda r: r["place"])
    assert first["url"] == "https://s0.ai" and first["raw_text"].startswith("tool 0 is here")
    listed = html_links.parse_listing(pages)
    assert listed.count() == 700 and "Exchange" not in listed._jdf.queryExecution().executedPlan().toString()


def test_every_registered_parser_gives_signals(spark):
    from leadlens import schemas
    from leadlens.plans.landed import ATTRIBUTES

    ddl = "payload_id bigint, body string, " + ", ".join(f"{n} {t}" for n, t in ATTRIBUTES.items())
    nothing = spark.createDataFrame([], ddl)
    wanted = [(f.name, f.dataType) for f in schemas.schema("signals_in").fields]
    for name, source in RG.registry().items():
        got = source.parse(nothing).schema
        assert [(f.name, f.dataType) for f in got.fields] == wanted, name


def test_landed_payloads_reach_the_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    from leadlens.plans.landed import ingest_landed

    def land(collector, name, body):
        folder = tmp_path / "landed" / f"collector={collector}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(body if isinstance(body, str) else json.dumps(body))

    land("hackernews", "a.json", {"hits": [{"title": "freemodel.dev $300 free credits, register", "url": "https://freemodel.dev", "objectID": "1"}]})
    land("huggingface", "list.json", [{"id": "Qwen/m1", "inference": None}, {"id": "Qwen/m2", "inference": None}])
    land("huggingface", "one.json", {"id": "Qwen/m1", "inference": "warm"})
    land("certstream", "m.json", {"message_type": "certificate_update", "data": {"leaf_cert": {"all_domains": ["*.llm-x.com"]}}})
    land("twitter", "t.json", {"data": [{"id": "5", "text": "free trial credits at off.ai sign up"}]})
    land("telegram", "c.json", {"channel": "deals", "msg_id": 7, "date": "2026-05-01T00:00:00Z", "text": "b.ai free trial, no credit card"})
    off = spark.createDataFrame([("twitter", False)], "name string, enabled boolean")
    payloads = RG.read_payload_files(spark, str(tmp_path / "landed"))
    target = str(tmp_path / "run")
    names = ["hackernews", "huggingface", "certstream", "telegram"]
    from leadlens.plans.landed import enabled_names
    assert set(names) < set(enabled_names(payloads, off)) and "twitter" not in enabled_names(payloads, off)
    ingest_landed(payloads, None, target, F.lit("2026-05-20").cast("timestamp"), off, names=names)
    stored = {r["source_url"]: r for r in spark.read.parquet(f"{target}/signals").collect()}
    assert len(stored) == 4 and {r["source"] for r in stored.values()} == set(names)  # m2 is not served: not labelled
    assert "status=warm" in stored["https://huggingface.co/Qwen/m1"]["raw_text"]
