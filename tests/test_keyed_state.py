"""Ingest as keyed state: equal to one batch, and a batch's cost follows the batch."""

import os

import pytest
from pyspark.sql import functions as F

from leadlens.operators import ingest as I
from leadlens.plans.batch import IngestJob, read_snapshot
from leadlens.streaming import keyed as KY
from leadlens.streaming import newest as NW
from leadlens.streaming import state as KS

AS_OF = "2026-05-20 00:00:00"
TEXTS = (
    "grab ${n} of free credits at https://alpha{d}.ai with opus", "注册送 {n}刀 中转站 https://hub{d}.dev 新用户",
    "btw node{d}.io has a free trial for {n} days, use code NEW{n}", "nothing to see here {n}",
    "free trial, no credit card: https://alpha{d}.ai/?ref=x{n}", "hub{d}.dev gives away a promo code and gemini tokens",
)


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def posts(signals, n, domains=40):
    rows = [
        {
            "source": f"s{i % 3}" if i % 5 else "telegram", "raw_text": TEXTS[i % len(TEXTS)].format(n=i % 97 + 1, d=i * 7 % domains),
            "source_url": None if i % 11 == 0 else f"u{i * 3 // 4}", "observed_at": f"2026-05-{1 + i % 19:02d} 0{i % 9}:00:00",
        }
        for i in range(n)
    ]
    rows += [
        {"source": "hub", "raw_text": f"New model release: Org/m{i % 4}", "url": f"https://huggingface.co/Org/m{i % 4}", "model_release": True,
         "org": "Org", "model_id": f"Org/m{i % 4}", "force_classify": True, "observed_at": "2026-05-02 00:00:00"}
        for i in range(8)
    ]
    return signals(rows)


def landed(df, path, parts):
    """One file for each part, in order of arrival."""
    total = df.count()
    for part in range(parts):
        df.where(F.floor(F.col("ingest_seq") * parts / total) == part).coalesce(1).write.mode("append").parquet(path)
        (name,) = [f for f in os.listdir(path) if f.endswith(".parquet") and not os.path.exists(f"{path}/.{f}.seen")]
        os.utime(f"{path}/{name}", (1_700_000_000 + part, 1_700_000_000 + part))
        open(f"{path}/.{name}.seen", "w").close()


def stream_of(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows_of(frame):
    return sorted(str(r) for r in frame.collect())


def same(spark, root, batch):
    whole = read_snapshot(spark, batch)
    for name in KY.KEYS:
        assert rows_of(KY.read_state(spark, root, name)) == rows_of(whole[name]), name
    stored = spark.read.parquet(f"{batch}/signals")
    assert rows_of(KY.read_state(spark, root, "signals").select(*stored.columns)) == rows_of(stored)


def written(root):
    """Rows and files by batch."""
    import pyarrow.parquet as pq

    out = {}
    for folder in os.listdir(f"{root}/changes"):
        files = [os.path.join(d, f) for d, _, names in os.walk(f"{root}/changes/{folder}") for f in names if f.endswith(".parquet")]
        out[int(folder.split("=")[1])] = sum(pq.ParquetFile(f).metadata.num_rows for f in files)
    return out


def test_twenty_batches_equal_one(spark, signals, tmp_path):
    df = posts(signals, 392)
    source, root, batch = (str(tmp_path / n) for n in ("in", "stream", "batch"))
    landed(df, source, 20)
    query = KY.start_ingest(stream_of(spark, df, source), root, as_of())
    query.awaitTermination()
    IngestJob().run(df, None, batch, as_of())
    same(spark, root, batch)
    rows = written(root)
    assert len(rows) == 20
    # a batch of 20 rows writes no more than its rows, its mentions and what they change, however much is stored
    assert max(rows.values()) <= 5 * 20
    updated = [[o["numRowsUpdated"] for o in p["stateOperators"]] for p in query.recentProgress if p["numInputRows"]]
    kept = [[o["numRowsTotal"] for o in p["stateOperators"]] for p in query.recentProgress if p["numInputRows"]]
    assert kept[-1][0] > 3 * kept[2][0] / 2 and max(max(u) for u in updated) <= 5 * 20
    # compaction: one snapshot, no changes, the same tables
    assert KY.compact(spark, root) == 19
    assert os.listdir(f"{root}/changes") == [] and os.listdir(f"{root}/snapshot") == ["epoch=19"]
    same(spark, root, batch)
    assert KY.compact(spark, root) == 19


def test_goes_on_after_a_stop_and_a_compaction(spark, signals, tmp_path):
    df = posts(signals, 120)
    source, root, batch = (str(tmp_path / n) for n in ("in", "stream", "batch"))
    half = df.count() // 2
    landed(df.where(F.col("ingest_seq") < half), source, 1)
    KY.start_ingest(stream_of(spark, df, source), root, as_of()).awaitTermination()
    KY.compact(spark, root)
    late = str(tmp_path / "late")
    landed(df.where(F.col("ingest_seq") >= half).withColumn("ingest_seq", F.col("ingest_seq") - half), late, 1)
    rest = spark.read.schema(df.schema).parquet(late).withColumn("ingest_seq", F.col("ingest_seq") + half)
    rest.coalesce(1).write.mode("append").parquet(source)
    KY.start_ingest(stream_of(spark, df, source), root, as_of()).awaitTermination()
    IngestJob().run(df, None, batch, as_of())
    same(spark, root, batch)
    assert KY.compact(spark, root) == 1 and os.listdir(f"{root}/snapshot") == ["epoch=1"]
    same(spark, root, batch)


def test_a_repeated_batch_rewrites_its_folder(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    KS.write_changes(rows, root, 0)
    KS.write_changes(rows.where("k = 1"), root, 1)
    KS.write_changes(rows.where("k = 2").withColumn("v", F.lit("c")), root, 1)
    os.makedirs(f"{root}/changes/batch=2")  # never finished
    assert rows_of(KS.read_latest(spark, root, ["k"], rows.schema)) == ["Row(k=1, v='a')", "Row(k=2, v='c')"]
    assert KS.compact_latest(spark, root, ["k"], rows.schema) == 1
    assert rows_of(KS.read_latest(spark, root, ["k"], rows.schema)) == ["Row(k=1, v='a')", "Row(k=2, v='c')"]
    assert KS.read_latest(spark, f"{root}/none", ["k"], rows.schema).count() == 0


def test_begins_with_a_snapshot(spark, signals, tmp_path):
    """Rows after a batch run: known keys stay out, columns of other jobs stay, offers go on from their values."""
    df = posts(signals, 150)
    half = df.count() // 2
    first, second = df.where(F.col("ingest_seq") < half), df.where(F.col("ingest_seq") >= half)
    source, root, one, two = (str(tmp_path / n) for n in ("in", "stream", "one", "two"))
    IngestJob().run(first, None, one, as_of())
    tables, stored = read_snapshot(spark, one), spark.read.parquet(f"{one}/signals")
    tables["offers"] = tables["offers"].withColumn("score", F.lit(0.5))
    again = second.unionByName(first.where(F.col("source_url").isNotNull()))  # stored rows that arrive once more
    again.coalesce(1).write.parquet(source)
    KY.start_ingest(stream_of(spark, df, source), root, as_of(), tables=tables, stored=stored).awaitTermination()
    IngestJob().run(again, one, two, as_of(), stored)
    whole = read_snapshot(spark, two)
    for name in ("services", "service_aliases", "lead_metrics", "candidates"):
        skip = ["first_seq"] if name == "service_aliases" else []
        assert rows_of(KY.read_state(spark, root, name).drop(*skip)) == rows_of(whole[name].drop(*skip)), name
    offers = KY.read_state(spark, root, "offers")
    assert rows_of(offers.drop("score")) == rows_of(whole["offers"].drop("score"))
    old = tables["offers"].select("id")
    assert offers.join(old, "id").where("score <> 0.5").count() == 0 and offers.where("score = 0.0").count() > 0
    assert KY.read_state(spark, root, "signals").count() == stored.count() + spark.read.parquet(f"{two}/signals").count()


@pytest.mark.parametrize("n", [1, 3])
def test_newest_signals(spark, tmp_path, n):
    rows = [(i, 1 + i * i % 4 if i % 7 else None, f"s{i}", f"u{i}", "t" * i, f"2026-05-{1 + i * 5 % 9:02d} 00:00:00" if i % 4 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "signal_id long, service_id long, source string, source_url string, raw_text string, observed_at string")
    df = df.withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    landed(df.withColumn("ingest_seq", F.col("signal_id")), source, 4)
    newest = NW.newest_signals(stream_of(spark, df.withColumn("ingest_seq", F.lit(0).cast("long")), source), n)
    KS.latest_to_table(newest, root, f"{root}/_checkpoint", "append").awaitTermination()
    got = NW.as_rows(KS.read_latest(spark, root, ["service_id"], newest.schema)).select("service_id", "position", "signal_id")
    want = {}
    for i, service, *_, at in sorted(rows, key=lambda r: (r[5] is not None, r[5] or "", r[0]), reverse=True):
        if service is not None and len(want.setdefault(service, [])) < n:
            want[service].append(i)
    assert sorted(map(tuple, got.collect())) == sorted((s, k + 1, i) for s, ids in want.items() for k, i in enumerate(ids))


def test_only_changed_keys_are_written(spark, tmp_path):
    from leadlens.streaming import streams as ST

    df = spark.createDataFrame(
        [(0, 1, "a", "2026-05-01"), (1, 2, "a", "2026-05-01"), (2, 1, "telegram", "2026-05-03"), (3, 3, "a", "2026-05-01")],
        "ingest_seq long, offer_id long, source string, day string",
    ).withColumn("observed_at", F.col("day").cast("timestamp"))
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    landed(df, source, 2)
    leads = ST.running_leads(stream_of(spark, df, source), ("telegram",))
    KS.latest_to_table(leads, root, f"{root}/_checkpoint").awaitTermination()
    assert written(root) == {0: 2, 1: 2}
    got = {r["offer_id"]: r["lead_hours"] for r in KS.read_latest(spark, root, ["offer_id"], leads.schema).collect()}
    assert got == {1: 48.0, 2: None, 3: None}


def test_a_stream_is_read_once(spark, tmp_path):
    """What stands before ingest, with its state, runs once for rows and mentions together."""
    import json

    from leadlens.streaming import streams as ST

    names = [["*.llm-a.com", f"api.shop{i % 3}.net", "brand.ai", "free.token.dev"] for i in range(40)]
    body = [json.dumps({"message_type": "certificate_update", "data": {"leaf_cert": {"all_domains": n}}}) for n in names]
    df = spark.createDataFrame(list(enumerate(body)), "ingest_seq long, body string")
    df = df.withColumn("received_at", F.timestamp_seconds(F.col("ingest_seq") * 7200 + 1_700_000_000))
    source, root = str(tmp_path / "in"), str(tmp_path / "stream")
    landed(df, source, 2)
    query = KY.start_ingest(ST.certificate_signals(stream_of(spark, df, source)), root, as_of(), partitions=2)
    query.awaitTermination()
    assert sum(p["numInputRows"] for p in query.recentProgress) == 40
    assert [o["operatorName"] for o in query.recentProgress[0]["stateOperators"]].count("dedupeWithinWatermark") == 1
    got = {r["raw_text"] for r in KY.read_state(spark, root, "signals").collect()}
    assert got == {"llm-a.com", "free.token.dev"}


def test_a_classifier_sees_kept_rows_only(spark, signals, tmp_path):
    """A classifier of the caller's own may drop rows; their mentions stay, as they do in a batch."""
    def classifier(rows):
        return I.rule_classifier(rows.where("raw_text NOT LIKE '%promo%'"))

    df = posts(signals, 90)
    source, root, batch = (str(tmp_path / n) for n in ("in", "stream", "batch"))
    landed(df, source, 2)
    job = IngestJob(classifier=classifier)
    KY.start_ingest(stream_of(spark, df, source), root, as_of(), job).awaitTermination()
    job.run(df, None, batch, as_of())
    same(spark, root, batch)


def test_mentions_of_a_domain_pass_as_one():
    import json

    from pyspark.sql import Row

    def mention(domain, n, high):
        at = json.dumps({"ingest_seq": n, "place": None, "pos": 0, "source": f"s{n}", "tie": None})
        body = json.dumps({"high": high, "source": f"s{n}"})
        return Row(digest=None, named=None, domain=domain, to=7, as_of=0, at=at, body=body, signal=None)

    first = KY.FirstOfKey()
    first.init(_Handle())
    rows = [mention("a.ai", 2, True), mention("a.ai", 1, False), mention("b.ai", 4, False), mention("a.ai", 3, False)]
    out = {row["domain"]: (row["kind"], row["part"], json.loads(row["body"])) for row in first.handleInputRows((7,), iter(rows), None)}
    assert out == {"a.ai": ("mention", 7, {"high": True, "source": "s1"}), "b.ai": ("mention", 7, {"high": False, "source": "s4"})}


def test_landed_files_can_be_split(spark, tmp_path):
    import pyarrow.parquet as pq

    from checks import streams as S

    orders = spark.range(0, 600_000, 1, 1).select(
        F.col("id").alias("o_orderkey"), F.xxhash64("id").alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
        F.rand(1).alias("o_totalprice"), F.timestamp_seconds("id").alias("o_orderdate"), F.lit("1").alias("o_orderpriority"),
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    S._landed(spark, str(tmp_path), str(tmp_path), 1)
    files = [f for f in os.listdir(f"{tmp_path}/landed") if f.endswith(".parquet")]
    kept = [pq.ParquetFile(f"{tmp_path}/landed/{f}").metadata for f in files]
    assert sum(m.num_rows for m in kept) == 600_000 and max(m.num_row_groups for m in kept) > 2


class _Map:
    """A map state that counts what it is asked."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def containsKey(self, key):
        self.asked += 1
        return key in self.held

    def getValue(self, key):
        self.asked += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.asked += 1
        self.held[key] = value


class _Handle:
    def __init__(self):
        self.maps = []

    def getMapState(self, *_):
        self.maps.append(_Map())
        return self.maps[-1]


def test_rows_of_a_group_share_questions_to_the_state():
    """A question to the state costs as much as many rows: 20,000 keys of one group ask for each slot, not for each key."""
    import hashlib
    import json

    from pyspark.sql import Row

    at = lambda n: json.dumps({"ingest_seq": n, "place": None, "pos": None, "source": "s", "tie": n})
    rows = [
        Row(digest=hashlib.sha256(b"%d" % (i // 2)).digest()[:16], named=True, domain=f"d{i % 50}.ai", to=1, as_of=0, at=at(i), body="{}", signal=f'{{"id": {i}}}')
        for i in range(40_000)
    ]
    handle, first = _Handle(), KY.FirstOfKey()
    first.init(handle)
    out = list(first.handleInputRows((7,), iter(reversed(rows)), None))
    ids = sorted(signal["id"] for row in out if row["kind"] == "signals" for signal in json.loads(row["body"]))
    assert ids == list(range(0, 40_000, 2)) and sum(row["kind"] == "row" for row in out) == 20_000
    assert handle.maps[0].asked <= 3 * KY.SLOTS
    assert list(first.handleInputRows((7,), iter(rows), None)) == []
    assert handle.maps[0].asked <= 6 * KY.SLOTS


def test_long_texts_pass_whole(spark, signals, tmp_path):
    """Texts beyond the length that JSON readers take by default."""
    df = signals([{"source": "s", "raw_text": "free credits at https://alpha1.ai " + c * 21_000_000, "source_url": c} for c in "ab"])
    source, root = str(tmp_path / "in"), str(tmp_path / "stream")
    df.write.parquet(source)
    KY.start_ingest(spark.readStream.schema(df.schema).parquet(source), root, as_of(), partitions=1).awaitTermination()
    got = KY.read_state(spark, root, "signals").select(F.sha2("raw_text", 256).alias("h"))
    assert rows_of(got) == rows_of(df.select(F.sha2("raw_text", 256).alias("h")))


def test_repeats_are_not_labelled(spark, signals, tmp_path, monkeypatch):
    """Nothing is labelled before the state has told repeats apart; their mentions count all the same."""
    streams, rules = [], I.rule_classifier
    monkeypatch.setattr(I, "rule_classifier", lambda rows, lex: streams.append(rows.isStreaming) or rules(rows, lex))
    rows = [
        {"source": "s", "raw_text": f"free trial at https://{d}.ai with opus", "source_url": "u", "observed_at": "2026-05-01 00:00:00"}
        for d in ("alpha1", "alpha2", "alpha3", "alpha4")
    ]
    df, source, root = signals(rows), str(tmp_path / "in"), str(tmp_path / "stream")
    landed(df, source, 2)
    KY.start_ingest(stream_of(spark, df, source), root, as_of(), partitions=2).awaitTermination()
    assert streams == [False, False]
    assert [r["canonical_domain"] for r in KY.read_state(spark, root, "services").collect()] == ["alpha1.ai"]
    assert KY.read_state(spark, root, "signals").count() == 1 and KY.read_state(spark, root, "candidates").count() == 4


def test_frames_pass_as_rows_do():
    import hashlib
    import json

    import pandas as pd

    at = lambda n: json.dumps({"ingest_seq": n, "source": "s", "tie": n})
    rows = [
        (7, hashlib.sha256(b"%d" % (i // 2)).digest()[:16], True, None, 0, at(i), f'{{"said": {i}}}' if i % 3 else None, f'{{"id": {i}}}')
        for i in range(100)
    ] + [(7, None, False, None, 0, None, '{"said": 100}', None)]
    first = KY.FramesOfKeys()
    first.init(_Handle())
    frames = [pd.DataFrame(rows[k::2], columns=KY._In._fields) for k in (1, 0)]
    out = pd.concat(first.handleInputRows((7,), iter(frames), None))
    texts = {kind: sorted(v for t in part["body"] for e in json.loads(t) for v in e.values()) for kind, part in out.groupby("kind")}
    assert texts == {"signals": list(range(0, 100, 2)), "mentions": [i for i in range(100) if i % 3] + [100]}


def test_a_mention_is_looked_for_once(spark, signals):
    """Where a host stands is found once, in a text that is lower-cased once, and only for hosts that may be candidates."""
    df = I.normalize(signals([{"source": "s", "raw_text": "Free trial at https://Alpha1.ai and https://x.com, or Beta22.dev " + "x " * 90 + "tail9.io"}]))
    found = df.select(F.explode(I.mention_array()).alias("m")).select("m.*")
    assert [tuple(r) for r in found.collect()] == [(0, "alpha1.ai", True), (2, "beta22.dev", True), (3, "tail9.io", False)]
    plan = df.select(I.mention_array().alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("instr(") == 1
