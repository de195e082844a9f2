"""Streaming equals batch; repeats within the horizon are dropped."""

import json

from pyspark.sql import functions as F

from leadlens.sources import certificates as CT
from leadlens.streaming import streams as ST


def message(kind, *names):
    return json.dumps({"message_type": kind, "data": {"leaf_cert": {"all_domains": list(names)}}})


def test_certificate_messages(spark):
    df = spark.createDataFrame(
        [(message("certificate_update", "*.llm.foo.com", "api.bar.net", "brand.ai", "plain.com"),), (message("heartbeat", "gpt.x"),), ("broken",)],
        "body string",
    )
    got = {(r["target"], r["kind"]) for r in CT.message_hosts(df).collect()}
    assert got == {("llm.foo.com", "force"), ("bar.net", "candidate"), ("brand.ai", "candidate")}


def test_certificate_messages_are_parsed_once(spark):
    """Also where Spark derives filters from what is exploded, and where kind and target share a test."""
    rows = [
        (1, message("certificate_update", "*.LLM.Foo.com", "", "API.Bar.net", "plain.com", "gpt.googleapis.com", "Brand.ai", None)),
        (2, message("certificate_update")), (3, message("heartbeat", "gpt.x")), (4, "broken"), (5, None), (6, '{"message_type": "certificate_update"}'),
    ]
    df = spark.createDataFrame(rows, "id long, body string")
    hosts = CT.message_hosts(df)
    assert sorted((r["id"], r["pos"][0], r["kind"], r["target"]) for r in hosts.collect()) == [
        (1, 0, "force", "LLM.Foo.com"), (1, 2, "candidate", "bar.net"), (1, 5, "candidate", "brand.ai"),
    ]
    plan = hosts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("deepseek") == 1


def test_stream_drops_repeats_within_horizon(spark, tmp_path):
    source = tmp_path / "in"
    schema = "body string, received_at timestamp"
    for minute in (0, 5):
        body = message("certificate_update", "gpt.foo.com", f"new{minute}.ai")
        df = spark.createDataFrame([(body, minute)], "body string, m int")
        df.select("body", F.timestamp_seconds(F.col("m") * 60 + 1700000000).alias("received_at")).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    query = ST.certificate_signals(stream, "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
    query.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["raw_text"] for r in spark.read.parquet(out).collect()) == ["gpt.foo.com", "new0.ai", "new5.ai"]


def test_channel_stream_with_topics(spark, tmp_path):
    from leadlens.sources import channel as CH

    rows = [{"channel": c, "msg_id": i, "date": "2026-05-01 00:00:00", "text": "t", "reply_to": {"top_id": i}} for i, c in enumerate(["a", "a", "b"], 5)]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", CH.MESSAGE_TYPE).alias("m")).select("m.*")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(source)
    config = spark.createDataFrame([("a", 6)], "channel string, topic_id bigint")
    stream = ST.channel_signals(spark.readStream.schema(df.schema).parquet(source), config)
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["source_url"] for r in spark.read.parquet(out).collect()) == ["https://t.me/a/6", "https://t.me/b/7"]


def test_stream_reads_a_table_kept_as_a_folder(spark, tmp_path):
    from checks import sources as SC
    from checks import upkeep as U

    rows = [(c, t, "user", f"text {c} {t}") for c in range(12) for t in range(6)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    table.repartition(5).write.parquet(f"{tmp_path}/folder/conversations.parquet")
    (tmp_path / "file").mkdir()
    table.toPandas().to_parquet(f"{tmp_path}/file/conversations.parquet", index=False)
    for kind in ("folder", "file"):
        want = sorted(map(tuple, SC.channel_messages(spark, f"{tmp_path}/{kind}").collect()))
        assert len(want) > 10 and sorted(map(tuple, U.channel_stream(spark, f"{tmp_path}/{kind}").collect())) == want
