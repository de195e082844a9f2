"""Secret scans that weigh how widely a credential is copied.

Candidates come from three patterns over whole texts.  Their values are hashed, and for each hash the corpus gives the
number of distinct repositories and owners.  A value with ``OWNERS`` owners, or with several and ``REPOSITORIES``
repositories, is a published ``example``; a value that one owner alone holds and that looks random is ``live``, in however
many places; the rest is left alone.  Candidates of both kinds add a span around their value.

Counting is in two steps, distinct (value, owner, repository) first, so that a value in a third of all rows is spread and
pre-aggregated; the verdicts join back by value, one row for each.  Spans are gathered for each row of the table, bounded
by its text.

In the test tables a source is an owner, and a text stands for a repository: copies of one text with one owner count once.

Nulls: a null text is empty; a null owner or repository counts as one of its own.  Repeated rows count as one repository.
Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.kit import cut

KINDS = ("assign", "access", "hex", "live", "example")  # order of equal starts
OWNERS, REPOSITORIES = 3, 5  # from so many on, a value is an example; repositories count for values of several owners
ENTROPY = 2.5  # bits a character that a live value has at least
LIVE_LENGTH = 16

# Fixed patterns of the data contract.  The keyword's letters match in either case, ASCII only.
_KEY = "|".join("".join(f"[{c}{c.upper()}]" for c in word) for word in ("password", "passwd", "secret", "token"))
ASSIGN = re.compile(rf"""({_KEY}|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
LEAST = {"assign": 6, "access": 20}
_HINTS = ("passw", "secret", "token", "api")

FOUND = pa.list_(pa.struct([
    ("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("from", pa.int64()), ("value", pa.string()),
    ("random", pa.bool_()),
]))


def candidates(text: str | None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value), by start and kind."""
    text = text or ""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [
            ("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST["assign"]
        ]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda c: (c[1], KINDS.index(c[0])))


def looks_random(value: str) -> bool:
    n = len(value)
    if n < LIVE_LENGTH:
        return False
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= ENTROPY


def scan(docs: DataFrame, owner: str = "source", repository: str | None = None) -> DataFrame:
    """Candidates of each row, before the corpus is asked: row_id, doc_id, owner, repository, counts, base_sha256, found.

    Without a column for it, the digest of the text stands for the repository.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS[:3]}
            digests, found = [], []
            for text in batch.column("text").to_pylist():
                own = candidates(text)
                kinds = Counter(c[0] for c in own)
                for kind, values in counts.items():
                    values.append(kinds[kind])
                joined = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in own)
                digests.append(hashlib.sha256(joined.encode()).hexdigest())
                found.append([
                    {"kind": k, "first": a, "last": b, "from": v, "random": looks_random(text[v:b]),
                     "value": hashlib.sha256(text[v:b].encode()).hexdigest()} for k, a, b, v in own
                ])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row_id", "doc_id", "owner", "repository")),
                 *(pa.array(v, pa.int64()) for v in counts.values()), pa.array(digests, pa.string()), pa.array(found, FOUND)],
                ["row_id", "doc_id", "owner", "repository", *(f"n_{k}" for k in counts), "base_sha256", "found"],
            )

    source = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col(owner).cast("string").alias("owner"),
        (F.sha2("text", 256) if repository is None else F.col(repository).cast("string")).alias("repository"), "text",
    )
    return source.mapInArrow(rows, (
        "row_id long, doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, "
        "base_sha256 string, found array<struct<kind: string, first: long, last: long, from: long, value: string, random: boolean>>"
    ))


def ownership(found: DataFrame) -> DataFrame:
    """value, owners, repositories, verdict (example, live or null) for ``found(value, owner, repository, random)``."""
    places = found.groupBy("value", "owner", "repository").agg(F.max("random").alias("random"))
    by_owner = places.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.max("random").alias("random"))
    counted = by_owner.groupBy("value").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.max("random").alias("random")
    )
    wide = (F.col("owners") >= OWNERS) | ((F.col("owners") > 1) & (F.col("repositories") >= REPOSITORIES))
    live = (F.col("owners") == 1) & F.col("random")
    return counted.withColumn("verdict", F.when(wide, "example").when(live, "live"))


def secret_spans(docs: DataFrame, owner: str = "source", repository: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = cut(scan(docs, owner, repository))
    found = rows.where(F.size("found") > 0).select(
        "row_id", "owner", "repository", F.explode("found").alias("c")
    ).select("row_id", "owner", "repository", "c.*")
    verdicts = ownership(found).where("verdict is not null").select(F.col("value").alias("judged"), "verdict")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    base = found.select("row_id", F.col("first").alias("at"), order.alias("place"), "last", "kind")
    added = (
        found.join(verdicts, F.col("value") == F.col("judged")).withColumn("kind", F.col("verdict"))
        .select("row_id", F.col("from").alias("at"), order.alias("place"), "last", "kind").distinct()
    )
    spans = base.union(added).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("at", "place", "last", "kind"))).alias("all"))
    text = F.array_join(F.transform("all", lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["last"].cast("string"))), ",")
    named = spans.select(F.col("row_id").alias("span_row"), text.alias("spans"))
    return rows.join(named, F.col("row_id") == F.col("span_row"), "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans")
    )
