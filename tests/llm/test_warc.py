import gzip
import hashlib

import pytest

from leadlens.llm import warc

PAGES = "page_id long, url string, html string"


def brute(rows, least=1000):
    newest = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least and page is not None:
            newest[data] = max(newest.get(data, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        refers = newest.get(data)
        refers = None if refers == page else refers
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/1", "é" * 700), (5, "http://a/5", "é" * 700), (3, None, "é" * 700), (2, "http://b\r\nX: y", "small"),
    (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "WARC/1.1\r\n\r\n" * 40_000), (9, "u", "z" * 1000),
    (10, "u", "z" * 999), (None, "u", "z" * 1000), (9, "u", "z" * 1000), (11, "u", "q" * 64), (12, "u", "q" * 128),
]


@pytest.mark.parametrize("chunk", [64, 1 << 18])
def test_round_trip(spark, chunk):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(3)
    manifest = warc.write_archives(pages, chunk=chunk)
    table = warc.read_archives(manifest, chunk=chunk).collect()
    got = sorted([(r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in table if r["last"]], key=str)
    assert got == brute(ROWS)
    payload = b"".join(bytes(r["data"]) for r in sorted(table, key=lambda r: r.chunk) if r.page_id == 8)
    assert payload.decode() == ROWS[7][2]
    assert max(len(r["data"]) for r in table) <= chunk
    text = gzip.open(manifest.first()["path"].removeprefix("file:")).read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"\nX: y" not in text


def test_damage_is_seen(spark):
    manifest = warc.write_archives(spark.createDataFrame(ROWS[:2], PAGES).coalesce(1))
    path = manifest.first()["path"].removeprefix("file:")
    data = gzip.open(path).read().replace("é".encode() * 3, "è".encode() * 3)
    with gzip.open(path, "wb") as file:
        file.write(data)
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archives(manifest).collect()


def test_empty_table_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGES))).count() == 0
    pages = spark.createDataFrame(ROWS[:3], PAGES).withColumn("sha1", F.lit(1)).withColumn("payload", F.lit(2))
    assert warc.read_archives(warc.write_archives(pages)).where("last").count() == 3
