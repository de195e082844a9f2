"""Rows are appended once, whatever tasks, jobs and batches are lost or repeated."""

import os

import pytest
from pyspark.sql import functions as F

from leadlens.plans import sink


def rows(frame):
    return sorted(r["id"] for r in frame.collect())


def table(spark, path, frame):
    return rows(sink.read_appended(spark, path, frame.schema))


def test_append_and_repeat(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(20).repartition(4)
    assert table(spark, path, df) == []
    sink.append(df, path, "run-1")
    sink.append(df, path, "run-1")  # repeated
    sink.append(df.where("id < 3"), path)
    sink.append(df.limit(0), path)
    assert table(spark, path, df) == sorted([*range(20), 0, 1, 2])


def test_a_failing_task_leaves_no_row(spark, tmp_path):
    path = str(tmp_path / "t")
    sink.append(spark.range(5), path)

    def fail(batches):
        for batch in batches:
            if (batch["id"] == 77).any():
                raise RuntimeError("killed")
            yield batch

    broken = spark.range(100).repartition(8).mapInPandas(fail, "id long")
    with pytest.raises(Exception, match="killed"):
        sink.append(broken, path)
    assert table(spark, path, broken) == list(range(5))
    with pytest.raises(Exception, match="only grows"):
        spark.range(3).write.format(sink.NAME).mode("overwrite").option("path", path).save()


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(6).coalesce(2)
    sink.append(df, path)
    some = sink.committed_files(path)[0]
    os.system(f"cp {some} {path}/data/lost-attempt.parquet")
    assert table(spark, path, df) == list(range(6))


def test_a_repeated_micro_batch_counts_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    df = spark.range(30).coalesce(1)
    for k in range(3):
        df.where(F.col("id") % 3 == k).write.mode("append").parquet(source)
    sink.register(spark)

    def run(checkpoint):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        writer = stream.writeStream.format(sink.NAME).option("path", path).option("checkpointLocation", str(tmp_path / checkpoint))
        writer.trigger(availableNow=True).start().awaitTermination()

    run("one")
    assert table(spark, path, df) == list(range(30))
    run("two")  # the same batches again, as after a lost checkpoint
    assert table(spark, path, df) == list(range(30))


def test_link_and_card_rows(spark):
    from leadlens.functions import html as H
    from leadlens.sources import html_links as HL

    card = "<div class='server-card'><b class='server-name'>n{k}</b><i class='server-description'>d</i><a href='/x{k}'>x</a></div>"
    many = "".join(f"<p><a href='/l{k}' title='t'> link  {k} </a></p>" for k in range(20_000))
    pages = spark.createDataFrame(
        [(1, many, "https://a.ai/p"), (2, "".join(card.format(k=k) for k in range(3)), "https://b.ai"), (3, None, None), (4, "none", "https://c.ai")],
        "payload_id bigint, body string, page_url string",
    )
    links = HL.page_link_rows(pages).collect()
    want = [(p, i, x["href"], x["text"], x["title"]) for p, b, u in [(1, many, "https://a.ai/p"), (2, pages.collect()[1]["body"], "https://b.ai")] for i, x in enumerate(H._links_of(b, u))]
    assert sorted((r["payload_id"], r["pos"], r["href"], r["text"], r["title"]) for r in links) == sorted(want) and len(links) == 20_003
    cards = HL.server_card_rows(pages).collect()
    assert sorted((r["payload_id"], r["pos"], r["name"], r["hrefs"]) for r in cards) == [(2, k, f"n{k}", [f"https://b.ai/x{k}"]) for k in range(3)]
