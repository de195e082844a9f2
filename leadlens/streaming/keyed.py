"""Ingest as keyed streaming state: what a micro-batch changes is written, not what it leaves alone.

A batch goes through three steps:

* ``FirstOfKey``, the stateful operator, keeps a digest of each stored (source, key); of the rows of a batch that share a key the
  first in arrival order passes, of later batches none; of the mentions of a domain one passes that stands for those of a group;
* what passes is labelled, so that repeats never are, and written as the batch's rows (``root/rows/batch=n``);
* the merges of the batch job make the batch's own tables of these rows and mentions (``root/changes/batch=n``).

The digests lie in RocksDB with changelogs.  Keys and domains are dealt to a fixed number of groups, and a group's rows
are handled in one call, since a call, its answer and each question to the state cost far more than a row.  Digests lie in
slots, each read and written whole: a batch of n rows touches at most n slots, each a ``GROUPS * SLOTS``-th of the keys.
Python sees rows as frames: of a row its key, its order and one JSON text that it doesn't read.  A repeated batch rewrites its
folders.  The state of a table is the last compacted snapshot merged with the tables of the batches after it
(``read_state``), earlier batches first.  ``compact`` writes the next snapshot from time to time and removes the folders that it replaces.

Rows of an earlier micro-batch are earlier observations.  The columns that other jobs own (scores, states of offers and
candidates, enrichment) are not changed here: a snapshot's values stay.
"""

from __future__ import annotations

import json
import sys
from collections import namedtuple
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from leadlens import lexicon as lx
from leadlens import schemas
from leadlens.functions.score import lead_hours
from leadlens.functions.text import LABEL_TYPE
from leadlens.functions.words import truthy_array, truthy_number, truthy_text
from leadlens.operators import ingest as I
from leadlens.plans.batch import IngestJob, staged
from leadlens.streaming import state as ST

# Ship this module inside the pickled processors, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


_AT = "struct<ingest_seq bigint, place array<bigint>, pos int, source string, tie bigint>"
# A row before it is labelled, or with the label of a classifier of the caller's own.
_ROW = (
    "struct<source string, source_url string, row_key string, url string, raw_text string, lang string, domains array<string>, "
    "observed_at bigint, ingest_seq bigint, place array<bigint>, matched boolean, "
    f"meta struct<service_candidate boolean, model_release boolean, org string, model_id string>, label {LABEL_TYPE}>"
)
# A row on its way: ``at`` is its order, ``body`` what it says; of signals the rows to be stored.
_EVENT = {"part": "int", "domain": "string", "kind": "string", "as_of": "bigint", "at": "string", "body": "string"}
# What comes in: rows with the digest of their key, and mentions, which have none.
_INPUT = "struct<part int, digest binary, named boolean, domain string, as_of bigint, at string, body string, signal string>"
_WHOLE = {"maxStringLen": str(2**31 - 1)}  # texts of any length come back from JSON
GROUPS = 1024  # of keys, and of domains; fixed once a state exists
SLOTS = 32  # of digests in a group
_WIDTH = 16  # bytes of a digest
_LIST = 1 << 20  # characters after which a list of signals ends


def _order(at: str) -> tuple:
    """Arrival order; nulls come first, as in Spark."""
    values = json.loads(at)
    return tuple((False,) if values.get(name) is None else (True, values[name]) for name in ("ingest_seq", "place", "pos", "source", "tie"))


def _digests(value: bytes) -> set[bytes]:
    return {value[i:i + _WIDTH] for i in range(0, len(value), _WIDTH)}


def _lists(texts: Iterable[str]) -> Iterator[str]:
    """JSON texts as lists of bounded length."""
    out, length = [], 0
    for text in texts:
        out.append(text)
        length += len(text)
        if length > _LIST:
            yield f"[{','.join(out)}]"
            out, length = [], 0
    if out:
        yield f"[{','.join(out)}]"


_Out = Row(*_EVENT)
_In = namedtuple("_In", "part digest named domain as_of at body signal")  # the fields of _INPUT


class FirstOfKey(StatefulProcessor):
    """Passes the first row of a (source, key) ever stored: as the stored signal, in lists, and, if it names its service, once more
    without its text.  What a row without a service has for a body are its mentions, which pass in lists, whether the row does or
    not.  Mentions that come by themselves come in the group of their domain: the first goes on, high if one is high."""

    def init(self, handle):
        self.stored = handle.getMapState("stored", "slot int", "digests binary")

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        first, slots, mentions, said = {}, {}, {}, []
        for row in rows:
            if row.domain is None and row.body is not None:
                said.append(row.body)
            if row.digest is None:
                if row.domain is None:
                    continue
                order, body = _order(row.at), json.loads(row.body)
                known = mentions.get(row.domain)
                if known is None:
                    mentions[row.domain] = [order, row, body]
                else:
                    high = body["high"] or known[2]["high"]
                    if order < known[0]:
                        known[:] = order, row, body
                    known[2]["high"] = high
                continue
            digest = bytes(row.digest)
            known = first.get(digest)
            if known is None or _order(row.at) < _order(known.at):
                first[digest] = row
            if row.named:  # rows without a locator have keys of their own, which never come again
                slots.setdefault(digest[0] % SLOTS, set()).add(digest)
        for slot, digests in slots.items():
            known = bytes(self.stored.getValue((slot,))[0]) if self.stored.containsKey((slot,)) else b""
            old = digests & _digests(known)
            for digest in old:
                del first[digest]
            if len(old) < len(digests):
                self.stored.updateValue((slot,), (known + b"".join(sorted(digests - old)),))
        for domain, (_, row, body) in mentions.items():
            yield _Out(key[0], domain, "mention", row.as_of, row.at, json.dumps(body))
        for row in first.values():
            if row.domain is not None:
                yield _Out(key[0], row.domain, "row", row.as_of, row.at, row.body)
        for kind, texts in (("signals", (r.signal for r in first.values())), ("mentions", said)):
            for text in _lists(texts):
                yield _Out(key[0], None, kind, row.as_of, None, text)

    def handleInitialState(self, key, row, timers) -> None:
        self.stored.updateValue((row.slot,), (b"".join(map(bytes, row.digests)),))

    def close(self) -> None:
        pass


class FramesOfKeys(FirstOfKey):
    """The same on frames, which Spark hands over some twenty times as fast as rows."""

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        each = chain.from_iterable(map(_In, *(frame[c].tolist() for c in _In._fields)) for frame in rows)
        out = list(super().handleInputRows(key, each, timers))
        if out:
            yield pd.DataFrame(out, columns=list(_EVENT))

    def handleInitialState(self, key, rows: pd.DataFrame, timers) -> None:
        for row in rows.itertuples(index=False):
            super().handleInitialState(key, row, timers)


# ------------------------------------------------------------------ events
def _micros(value: Column) -> Column:
    return F.unix_micros(value.cast("timestamp"))


def _group(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int")


def _digest(source: Column, key: Column) -> Column:
    named = F.to_json(F.struct(source.alias("s"), key.alias("k")), {"ignoreNullFields": "false"})
    return F.substring(F.unhex(F.sha2(named, 256)), 1, _WIDTH)


def _row_event(as_of: Column, label: Column, stored: Column | None = None, mentions: Column | None = None) -> Column:
    """A row as the event of the key that it is stored under; needs ``_key`` and ``_digest``.  A row that is not ``stored`` goes on for
    the sake of its ``mentions``."""
    arrival = I.arrival()
    at = F.struct(arrival["ingest_seq"].alias("ingest_seq"), arrival["place"].alias("place"), "source", arrival["tie"].alias("tie"))
    meta = F.struct(*[F.col(f"meta.{n}").alias(n) for n in ("service_candidate", "model_release", "org", "model_id")])
    row = F.struct(
        "source", "source_url", "row_key", "url", "raw_text", "lang", F.slice("domains", 1, 1).alias("domains"),
        _micros(F.col("observed_at")).alias("observed_at"), "ingest_seq", "place", "matched", meta.alias("meta"), label.alias("label"),
    )
    if_stored = lambda value: value if stored is None else F.when(stored, value)
    none = F.lit(None)
    return F.struct(
        _group(F.col("_digest")).alias("part"),
        if_stored(F.col("_digest")).alias("digest"),
        F.col("_key").startswith("=").alias("named"),
        none.alias("domain"),
        _micros(as_of).alias("as_of"),
        if_stored(F.to_json(at)).alias("at"),
        (none if mentions is None else F.when(F.size(mentions) > 0, F.to_json(_said(mentions)))).alias("body"),
        if_stored(F.to_json(row)).alias("signal"),
    ).cast(_INPUT)


def _said(mentions: Column) -> Column:
    return F.struct("source", "ingest_seq", "place", mentions.alias("mentions"))


def _mention_event(mention: Column, as_of: Column) -> Column:
    """A mention of a domain in an offer context."""
    at = F.struct("ingest_seq", "place", mention["pos"].alias("pos"), "source")
    return F.struct(
        _group(mention["domain"]).alias("part"),
        F.lit(None).alias("digest"),
        F.lit(None).alias("named"),
        mention["domain"].alias("domain"),
        _micros(as_of).alias("as_of"),
        F.to_json(at).alias("at"),
        F.to_json(F.struct(mention["is_high"].alias("high"))).alias("body"),
        F.lit(None).alias("signal"),
    ).cast(_INPUT)


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_key", I.locator_key()).withColumn("_digest", _digest(F.col("source"), F.col("_key")))


def row_events(classified: DataFrame, as_of: Column) -> DataFrame:
    """Rows with a label of the caller's own that may be stored, as events."""
    rows = _keyed(classified.where(~I.blocked_host()))
    if "matched" not in rows.columns:
        rows = rows.withColumn("matched", F.lit(None).cast("boolean"))
    return rows.select(_row_event(as_of, F.col("label")).alias("_event")).select("_event.*")


def mention_events(normalized: DataFrame, as_of: Column, lex: lx.Lexicon = lx.Lexicon()) -> DataFrame:
    """Mentions of domains in an offer context, as events."""
    mention = F.struct("pos", "domain", "is_high")
    return I.harvest_mentions(normalized, lex).select(_mention_event(mention, as_of).alias("_event")).select("_event.*")


def rule_events(normalized: DataFrame, as_of: Column, lex: lx.Lexicon = lx.Lexicon()) -> DataFrame:
    """Rows that the word rules will label, with their mentions, in one pass: a union would read the stream twice, with all that
    comes before, states included."""
    rows = _keyed(I.read_texts(normalized, lex).withColumn("raw_text", F.when(F.col("kept"), F.col("raw_text"))))
    mentions = F.coalesce("mentions", F.array().cast("array<struct<pos int, domain string, is_high boolean>>"))
    stored = F.col("kept") & ~I.blocked_host()
    event = _row_event(as_of, F.lit(None).cast(LABEL_TYPE), F.col("_stored"), F.col("mentions"))
    rows = rows.withColumn("mentions", mentions).withColumn("_stored", stored)
    events = F.when(F.col("_stored") | (F.size("mentions") > 0), F.array(event))
    return rows.select(F.inline_outer(events)).where(F.col("part").isNotNull())


def _stored_digests(stored: DataFrame) -> DataFrame:
    """Stored keys as the slots of the state."""
    rows = I.stored_keys(stored).select(_digest(F.col("source"), F.col("_key")).alias("digest")).distinct()
    slot = F.pmod(F.conv(F.hex(F.substring("digest", 1, 1)), 16, 10).cast("int"), F.lit(SLOTS)).alias("slot")
    return rows.groupBy(_group(F.col("digest")).alias("part"), slot).agg(F.collect_list("digest").alias("digests"))


# ------------------------------------------------------------------ the query
def passed(signals: DataFrame, as_of: Column | None = None, job: IngestJob = IngestJob(), stored: DataFrame | None = None) -> DataFrame:
    """Stream of the rows to be stored (``rows``, lists of them as JSON) and of mentions (``said``, lists too, or by themselves as
    ``domain``, ``at``, ``body``).  ``stored`` are the signals that the state begins with."""
    now = F.current_timestamp() if as_of is None else as_of
    normalized = I.normalize(schemas.with_schema(signals, "signals_in"))
    if job.classifier is None:
        events = rule_events(normalized, now, job.lex)
    else:  # it may expect kept rows only, and drop some before they count as the first of their key
        events = row_events(job.classifier(I.keep_matched(normalized, job.lex)), now).unionByName(mention_events(normalized, now, job.lex))
    keys = None if stored is None else _stored_digests(stored).groupBy("part")
    first = events.groupBy("part").transformWithStateInPandas(FramesOfKeys(), _ddl(_EVENT), "Append", "None", keys)
    of_kind = lambda kind, column: F.when(F.col("kind") == kind, F.col(column))
    return first.select(
        "as_of", *[of_kind("mention", c).alias(c) for c in ("domain", "at", "body")],
        of_kind("signals", "body").alias("rows"), of_kind("mentions", "body").alias("said"),
    )


_PASSED = "as_of bigint, domain string, at string, body string, rows string, said string"
_SAID = "struct<source string, ingest_seq bigint, place array<bigint>, mentions array<struct<pos int, domain string, is_high boolean>>>"
_STORED = (
    "source", "source_url", "row_key", "url", "raw_text", "lang", "domains", "observed_at", "ingest_seq", "place", "meta", "label",
    "route", "service_key", "offer_type",
)


def labelled(lists: DataFrame, job: IngestJob = IngestJob()) -> DataFrame:
    """The rows of a batch that are stored, labelled and routed."""
    each = lists.where("rows IS NOT NULL").select(F.explode(F.from_json("rows", f"array<{_ROW}>", _WHOLE)).alias("_row")).select("_row.*")
    rows = each.withColumn("observed_at", F.timestamp_micros("observed_at"))
    if job.classifier is None:
        rows = I.rule_classifier(rows.drop("label"), job.lex)
    return I.route(rows, job.min_confidence).select(*_STORED)


def mentioned(events: DataFrame) -> DataFrame:
    """The mentions of a batch."""
    alone = events.where("domain IS NOT NULL").select("domain", F.from_json("at", _AT).alias("at"), F.from_json("body", "high boolean").alias("body"))
    lists = events.where("said IS NOT NULL").select(F.explode(F.from_json("said", f"array<{_SAID}>", _WHOLE)).alias("_said")).select("_said.*")
    return lists.select("source", "ingest_seq", "place", F.inline("mentions")).unionByName(
        alone.select("domain", "at.source", "at.ingest_seq", "at.place", "at.pos", F.col("body.high").alias("is_high"))
    )


def start_ingest(
    signals: DataFrame, root: str, as_of: Column | None = None, job: IngestJob = IngestJob(),
    tables: dict[str, DataFrame] | None = None, stored: DataFrame | None = None, partitions: int | None = None, **trigger,
) -> StreamingQuery:
    """Ingest every micro-batch: its rows go to ``root/rows/batch=n``, its own tables to ``root/changes/batch=n``.  Read with
    :func:`read_state`.  ``tables`` and ``stored`` are what a new query begins with, ``partitions`` those of its state.  Use ``availableNow=True`` or
    ``processingTime='60 seconds'``."""
    spark = signals.sparkSession
    if tables is not None:
        begin = {**tables, "signals": schemas.empty(spark, "signals") if stored is None else stored}
        ST.write_snapshot(spark, {n: schemas.with_schema(f, n) for n, f in begin.items()}, root, -1)
    empty = {n: schemas.empty(spark, n) for n in KEYS}

    def on_batch(batch: DataFrame, epoch: int) -> None:
        arrived = f"{root}/passed/batch={epoch}"
        batch.write.mode("overwrite").parquet(arrived)
        events = spark.read.schema(_PASSED).parquet(arrived)
        rows = staged(labelled(events, job), f"{root}/rows/batch={epoch}")
        now = F.timestamp_micros(F.lit(events.agg(F.max("as_of")).first()[0]).cast("bigint"))
        merged = job.merge(empty, rows, I.candidates_of(mentioned(events)), now)
        ST.write_changes(_together({n: merged[n] for n in KEYS}), root, epoch, "table")
        ST.remove(spark, [arrived])

    with ST.rocksdb_state(spark, partitions):
        writer = passed(signals, as_of, job, stored).writeStream.foreachBatch(on_batch)
        return writer.option("checkpointLocation", f"{root}/_checkpoint").trigger(**(trigger or {"availableNow": True})).start()


# ------------------------------------------------------------------ reading and compacting
KEYS = {
    "services": ["canonical_domain"], "service_aliases": ["canonical_domain", "host"], "offers": ["id", "canonical_domain", "type"],
    "lead_metrics": ["offer_id"], "candidates": ["domain"],
}


def _together(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables in one frame, each with the columns that it has."""
    out = None
    for name, frame in tables.items():
        frame = frame.withColumn("table", F.lit(name))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def _first_of(rows: DataFrame, table: str) -> DataFrame:
    """The earliest row of each key."""
    keys = KEYS[table]
    values = [c for c in schemas.schema(table).names if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*values), "batch").alias("_row")).select(*keys, "_row.*")


def _offers(rows: DataFrame) -> DataFrame:
    """Offers seen in several batches: each column takes the first usable value; who sees an offer again verifies it."""
    release = F.col("id") != I.offer_id(F.col("canonical_domain"), F.col("type"))
    usable = {
        "amount": truthy_number(F.col("amount")).isNotNull(), "models": truthy_array(F.col("models")).isNotNull(),
        **{c: truthy_text(F.col(c)).isNotNull() for c in ("currency", "claim_steps", "requirements", "url")},
        **{c: F.col(c).isNotNull() for c in ("effort", "unit", "topic")},
    }
    new = F.col("batch") >= 0
    kept = [c for c in schemas.schema("offers").names if c not in KEYS["offers"]]
    merged = rows.withColumn("_release_url", F.when(release, F.col("url"))).groupBy(*KEYS["offers"], "_release_url").agg(
        F.min_by(F.struct(*kept), "batch").alias("_row"), F.count_if(new).alias("_new"), F.count("*").alias("_all"),
        F.max(F.when(new, F.col("last_verified_at"))).alias("_again"), F.max_by("first_seen_at", F.when(new, F.col("batch"))).alias("_last"),
        *[F.min_by(c, F.when(test, F.col("batch"))).alias(f"_{c}") for c, test in usable.items()],
    )
    again = F.col("_release_url").isNull() & (F.col("_new") > 0) & ((F.col("_all") > 1) | F.col("_again").isNotNull())
    values = {c: F.when(F.col("_new") > 0, F.col(f"_{c}")).otherwise(F.col(f"_row.{c}")) for c in usable}
    values["last_verified_at"] = F.when(again, F.col("_last")).otherwise(F.col("_row.last_verified_at"))
    return merged.select(*KEYS["offers"], *[values.get(c, F.col(f"_row.{c}")).alias(c) for c in kept])


def _merged(rows: DataFrame, table: str) -> DataFrame:
    """Rows of a table of several batches, as one row for each key."""
    if table == "offers":
        return _offers(rows)
    if table == "service_aliases":
        return rows.groupBy("service_id", *KEYS[table]).agg(F.min("first_seq").alias("first_seq"))
    if table == "lead_metrics":
        us, aggregator = "first_seen_by_us", "first_seen_in_aggregator"
        firsts = rows.groupBy(*KEYS[table]).agg(F.min(us).alias(us), F.min(aggregator).alias(aggregator))
        return firsts.withColumn("lead_hours", lead_hours(F.col(us), F.col(aggregator)))
    if table == "candidates":
        high = rows.groupBy(*KEYS[table]).agg(F.max(F.col("priority") == "high").alias("_high"))
        first = _first_of(rows, table).join(high, KEYS[table])
        return first.withColumn("priority", F.when(F.col("_high"), "high").otherwise(F.col("priority"))).drop("_high")
    return _first_of(rows, table)


def read_state(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table after the last written batch: the last snapshot and the tables of the batches after it, merged."""
    epoch, path = ST.snapshot_of(spark, root)
    after = [n for n in ST.finished(spark, f"{root}/changes", "batch") if n > epoch]
    old = schemas.empty(spark, table) if path is None else spark.read.schema(schemas.schema(table)).parquet(f"{path}/{table}")
    if not after:
        return old
    if table == "signals":
        rows = spark.read.parquet(*[f"{root}/rows/batch={n}" for n in after])
        return old.unionByName(I.stored_signals(rows))
    rows = ST.changes_after(spark, root, epoch, f"table string, {schemas.TABLES[table]}").where(F.col("table") == table).drop("table")
    both = rows if path is None else rows.unionByName(old.withColumn("batch", F.lit(-1)))
    return schemas.with_schema(_merged(both, table), table)


def compact(spark: SparkSession, root: str) -> int:
    """Writes the state as a snapshot and removes the snapshots, rows and changes that it replaces.  Returns its epoch.  Run it
    between batches and away from readers; a run that fails leaves the old state as it was."""
    before, _ = ST.snapshot_of(spark, root)
    epoch = max(ST.finished(spark, f"{root}/changes", "batch"), default=before)
    if epoch > before:
        ST.write_snapshot(spark, {name: read_state(spark, root, name) for name in (*KEYS, "signals")}, root, epoch)
        ST.drop_replaced(spark, root, epoch)
        ST.remove(spark, [p for n, p in ST.finished(spark, f"{root}/rows", "batch").items() if n <= epoch])
    return epoch
