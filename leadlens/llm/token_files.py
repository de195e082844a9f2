"""Token ids in length-delimited binary record files, with an offset index beside each.

A record is: length of the payload (8 bytes), masked CRC-32C of these 8 bytes, payload, masked CRC-32C of the payload.
The payload is the width of an id (2 bytes), 1 for a doc_id or 0 for a null one (2 bytes), the doc_id (8 bytes), and the
ids (2 bytes each where the vocabulary allows it, else 4); all little endian, unsigned but for the doc_id.  The index has ``INDEX`` for each record, so that a shuffled reader can fetch any.

Documents are range-sorted by doc_id; every partition streams its shard to the shared folder under a name of its own
attempt.  A shard counts only if its task ended: its name comes back as a row of the manifest, which is checkpointed.
Files of lost attempts are never named.

Nulls: a null text has only the end id; a null doc_id is sorted first.  Repeated rows are written each.  An empty table
writes no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens.llm.crc32c import crc32c, masked
from leadlens.llm.encode import encoder
from leadlens.llm.kit import cut, run_folder, text_hash

END = 2
HEAD = "<HHq"  # bytes of an id, has a doc_id, doc_id
INDEX = "<Iqqqq"  # has a doc_id, doc_id, place of the record in bytes, bytes of the record, ids
HEAD_SIZE = struct.calcsize(HEAD)
BATCH = 8 << 20  # bytes framed or read at a time
MANIFEST = "path string, index_path string, part int, records long, tokens long, bytes long"


def frame(payloads: list[bytes]) -> list[bytes]:
    """The records of the payloads."""
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    of_length = masked(crc32c(lengths)).astype("<u4").tobytes()
    of_data = masked(crc32c(payloads)).astype("<u4").tobytes()
    return [
        b"".join((n, of_length[4 * k : 4 * k + 4], p, of_data[4 * k : 4 * k + 4]))
        for k, (n, p) in enumerate(zip(lengths, payloads, strict=True))
    ]


def unframe(records: list[bytes]) -> list[bytes]:
    """The payloads of the records; a wrong checksum is an error."""
    payloads = [r[12:-4] for r in records]
    if frame(payloads) != records:
        raise ValueError("a record's checksum or length is wrong")
    return payloads


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids (unsigned, 32 bits) of a payload."""
    width, known, doc = struct.unpack(HEAD, payload[:HEAD_SIZE])
    return (doc if known else None), np.frombuffer(payload[HEAD_SIZE:], f"<u{width}").astype("<u4")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = END) -> DataFrame:
    """Writes the shards and returns the manifest."""
    folder = folder or run_folder(docs.sparkSession, "token-files")
    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _open(folder)
        ids_of, own = encoder(tokenizer).ids, None
        records = tokens = place = 0

        def put(waiting: list[tuple[bool, int, int, bytes]]) -> None:
            nonlocal place, records, tokens
            entries = []
            for (known, doc, n, _), record in zip(waiting, frame([w[3] for w in waiting]), strict=True):
                entries.append(struct.pack(INDEX, known, doc, place, len(record), n))
                data.write(record)
                place, records, tokens = place + len(record), records + 1, tokens + n
            index.write(b"".join(entries))

        for batch in batches:
            if own is None:
                system.create_dir(base, recursive=True)
                own = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                data, index = system.open_output_stream(f"{base}/{own}.rec"), system.open_output_stream(f"{base}/{own}.idx")
            waiting, held = [], 0
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                known = not pd.isna(doc)
                doc, ids = int(doc) if known else 0, ids_of(text)
                ids = np.append(ids, ids.dtype.type(end))
                width = ids.dtype.itemsize
                waiting.append((known, doc, len(ids), struct.pack(HEAD, width, known, doc) + ids.astype(f"<u{width}").tobytes()))
                held += len(waiting[-1][3])
                if held > BATCH:
                    put(waiting)
                    waiting, held = [], 0
            if waiting:
                put(waiting)
        if own is not None:
            data.close()
            index.close()
            yield pd.DataFrame([{
                "path": f"{folder}/{own}.rec", "index_path": f"{folder}/{own}.idx", "part": TaskContext.get().partitionId(),
                "records": records, "tokens": tokens, "bytes": place,
            }])

    order = [F.col("doc_id"), text_hash()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(_wide("doc_id"), "text").mapInPandas(shard, MANIFEST))


def _wide(name: str):
    """A long that pandas would turn into a double where it has nulls goes as text."""
    return F.col(name).cast("string").alias(name)


def entries(index: bytes) -> Iterator[tuple[int | None, int, int, int]]:
    """doc_id, place, bytes, ids of each record of an index."""
    for known, doc, place, size, ids in struct.iter_unpack(INDEX, index):
        yield (doc if known else None), place, size, ids


def read(manifest: DataFrame) -> DataFrame:
    """Reads every shard of a manifest back through its index: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, and where the record is: path, place, size.  All checksums are verified."""
    # one row for each shard
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.withColumn("start", F.coalesce(before, F.lit(0))).select("path", "index_path", "start")

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, index_path, start in zip(batch["path"], batch["index_path"], batch["start"], strict=True):
                system, at = _open(path)
                with system.open_input_stream(_open(index_path)[1]) as file:
                    listed = list(entries(file.read()))
                with system.open_input_stream(at) as file:
                    while listed:
                        n = held = 0
                        while n < len(listed) and (not n or held + listed[n][2] <= BATCH):
                            held, n = held + listed[n][2], n + 1
                        now, listed = listed[:n], listed[n:]
                        payloads = unframe([bytes(file.read(size)) for _, _, size, _ in now])
                        tokens = np.array([ids for *_, ids in now], np.int64)
                        yield pd.DataFrame({
                            "doc_id": pd.array([doc for doc, *_ in now], "Int64"),
                            "start": start + np.cumsum(tokens) - tokens,
                            "n_tokens": tokens,
                            "ids_crc32": [zlib.crc32(unpack(p)[1]) for p in payloads],
                            "path": path, "place": [place for _, place, *_ in now], "size": [size for _, _, size, _ in now],
                        })
                        start += int(tokens.sum())

    n = max(1, manifest.count())
    return shards.repartition(n, "path").mapInPandas(
        records, "doc_id long, start long, n_tokens long, ids_crc32 long, path string, place long, size long"
    )


def fetch(path: str, place: int, size: int) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of one record, for shuffled reads."""
    system, at = _open(path)
    with system.open_input_file(at) as file:
        file.seek(place)
        payload = unframe([bytes(file.read(size))])[0]
    return unpack(payload)
