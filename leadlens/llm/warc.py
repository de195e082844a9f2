"""WARC archives from pages, by way of a chunked record table.

A payload is cut into chunk rows (record, chunk number, at most ``CHUNK`` bytes) before it leaves the JVM; a record is
never one Python object.  The writer streams chunk rows into gzip members, one for each record, and carries the digest
of the payload from chunk to chunk; at the last chunk it must equal the digest in the record's header.  The reader
streams an archive back into chunk rows, each with the digest so far.

Equal payloads: one record is the response, the others refer to it (identical-payload-digest profile) and hold HTTP
headers only.  Payloads are told apart by SHA-1, SHA-256 and length together, from a narrow table; pages of one payload
are aggregated, never collected.

An archive counts only if its task ended: its name comes back as a row of the checkpointed manifest.  Archives of lost
attempts are never named.

Nulls: null html is an empty payload; a null url is an empty target; a null page_id refers and is referred to only if no
page of the payload has an id.  Rows that repeat page_id and html become records of the same kind.  Empty table: no file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.kit import cut, run_folder, text_hash

CHUNK = 1 << 18
LEAST = 1000  # bytes from which equal payloads are written once
ARCHIVE = 256 << 20  # bytes after which a task begins another archive
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
MANIFEST = "path string, records long, bytes long"
CHUNKS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, chunk int, data binary, "
    "digest string, last boolean"
)


def record_plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """One row for each different (page_id, html): page_id, html_hash, refers_to (null: a response)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    narrow = cut(pages.select(
        "page_id", text_hash("html").alias("html_hash"), F.sha1(payload).alias("sha1"),
        F.sha2(payload, 256).alias("sha256"), F.octet_length(payload).cast("long").alias("payload_bytes"),
    ).distinct())
    key = ["sha1", "sha256", "payload_bytes"]
    newest = narrow.where(F.col("payload_bytes") >= least).groupBy(*key).agg(F.max("page_id").alias("response_id"))
    return narrow.join(newest, key, "left").select(
        "page_id", "html_hash", "sha1", "payload_bytes",
        F.when(F.col("page_id").eqNullSafe(F.col("response_id")), F.lit(None)).otherwise(F.col("response_id")).alias("refers_to"),
    )


def chunk_table(pages: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """page_id, url, sha1, payload_bytes, refers_to, chunk, chunks, data; the chunks of a record follow each other."""
    plan = record_plan(pages, least).toDF("plan_id", "plan_hash", "sha1", "payload_bytes", "refers_to")
    rows = pages.select("page_id", "url", "html", text_hash("html").alias("html_hash"))
    same = rows["page_id"].eqNullSafe(plan["plan_id"]) & (rows["html_hash"] == plan["plan_hash"])
    payload = F.when(F.col("refers_to").isNull(), F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("payload") / chunk).cast("int") - 1)
    cutting = F.transform(
        F.sequence(F.lit(0), F.coalesce(last, F.lit(0))),
        lambda k: F.substring(F.col("payload"), k * chunk + 1, F.lit(chunk)),
    )
    return (
        rows.join(plan, same).withColumn("payload", payload).withColumn("parts", cutting)
        .select(
            F.col("page_id").cast("string").alias("page_id"), "url", "sha1", "payload_bytes",
            F.col("refers_to").cast("string").alias("refers_to"), F.size("parts").alias("chunks"),
            F.posexplode("parts").alias("chunk", "data"),
        )
    )


def _header(page_id: str | None, url: str | None, sha1: str, size: int, refers_to: str | None) -> bytes:
    """WARC header and HTTP header of a record; the HTTP header tells the size of the whole payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(),
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    fields["Content-Length"] = str(len(http) + (size if refers_to is None else 0))
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), "\r\n"]).encode() + http


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """Writes a record for each page and returns the manifest."""
    folder = folder or run_folder(pages.sparkSession, "warc")

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _open(folder)
        sink, done = None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.chunk == 0:
                    if sink is not None and sink.tell() > ARCHIVE:
                        done[-1]["bytes"] = sink.tell()
                        sink.close()
                        sink = None
                    if sink is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        system.create_dir(base, recursive=True)
                        sink = system.open_output_stream(f"{base}/{name}", compression=None)
                        done.append({"path": f"{folder}/{name}", "records": 0, "bytes": 0})
                    page, refers = (None if pd.isna(x) else x for x in (row.page_id, row.refers_to))
                    member, digest = zlib.compressobj(4, zlib.DEFLATED, 31), hashlib.sha1(usedforsecurity=False)
                    url = None if pd.isna(row.url) else row.url
                    sink.write(member.compress(_header(page, url, row.sha1, int(row.payload_bytes), refers)))
                if refers is None:
                    digest.update(row.data)
                    sink.write(member.compress(row.data))
                if row.chunk == row.chunks - 1:
                    if refers is None and digest.hexdigest() != row.sha1:
                        raise ValueError(f"page {page}: the chunks are not the payload of the header")
                    sink.write(member.compress(b"\r\n\r\n") + member.flush())
                    done[-1]["records"] += 1
        if sink is not None:
            done[-1]["bytes"] = sink.tell()
            sink.close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return cut(chunk_table(pages, least, chunk).mapInPandas(archive, MANIFEST))


def _page(urn: str | None) -> int | None:
    value = urn and urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value in (None, "None") else int(value)


def read_archives(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives, ``CHUNKS``: ``digest`` is the payload's SHA-1 up to and with the chunk;
    for a revisit it is that of its header.  ``payload_bytes`` is that of the whole payload."""

    def fields(file) -> dict[str, str]:
        out = {}
        while (line := file.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            out[name.decode().lower()] = value.strip().decode()
        return out

    def records(path: str) -> Iterator[tuple]:
        system, at = _open(path)
        with system.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as file:
            while file.readline().startswith(b"WARC/"):
                head = fields(file)
                file.readline()  # HTTP status
                size = int(fields(file)["content-length"])
                kind = head["warc-type"]
                common = (_page(head["warc-record-id"]), head["warc-target-uri"], kind, _page(head.get("warc-refers-to")), size)
                digest = hashlib.sha1(usedforsecurity=False)
                left, k = (size if kind == "response" else 0), 0
                while True:
                    data = file.read(min(left, chunk)) if left else b""
                    if left and not data:
                        raise ValueError(f"{path} ends inside a record")
                    digest.update(data)
                    left -= len(data)
                    stated = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    so_far = digest.hexdigest() if kind == "response" else stated
                    if not left and so_far != stated:
                        raise ValueError(f"{path}: a payload differs from its digest")
                    yield (*common, k, data if with_data else None, so_far, not left)
                    k += 1
                    if not left:
                        break
                file.read(4)  # the two line ends after a record

    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def table(held: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(held, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

        for batch in batches:
            for path in batch["path"]:
                held, size = [], 0
                for row in records(path):
                    held.append(row)
                    size += 200 + len(row[6] or b"")
                    if size > 16 * chunk:
                        yield table(held)
                        held, size = [], 0
                if held:
                    yield table(held)

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInPandas(rows, CHUNKS)
