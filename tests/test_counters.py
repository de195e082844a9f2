"""Counters taken while ingest writes equal those of the operators over the whole input."""

import random

import pytest
from pyspark.sql import functions as F

from leadlens.operators import ingest as I
from leadlens.plans.batch import IngestJob, read_snapshot

TEXTS = (
    "grab ${n} of free credits at https://alpha{d}.ai", "$9000 free credits at https://beta{d}.ai, sign up", "free trial: see https://old.reddit.com/r/x{d}",
    "注册送 {n}刀 https://hub{d}.dev", "nothing {n}", "free stuff of node{d}.io and gamma{d}.com", "free credits https://www.reddit.com and https://alpha{d}.ai",
)


def posts(signals, seed, n=120):
    draw = random.Random(seed)
    return signals([
        {
            "source": draw.choice(["a", "b"]), "raw_text": draw.choice(TEXTS).format(n=draw.randrange(200), d=draw.randrange(9)),
            "source_url": draw.choice([None, "", *(f"u{k}" for k in range(25))]), "service_candidate": draw.random() < 0.2,
            "force_classify": draw.random() < 0.2, "observed_at": "2026-05-01 00:00:00",
        }
        for _ in range(n)
    ])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_counters(spark, signals, tmp_path, seed):
    first, second = posts(signals, seed), posts(signals, seed + 10)
    now, one, two = F.lit("2026-05-20 00:00:00").cast("timestamp"), str(tmp_path / "one"), str(tmp_path / "two")
    IngestJob().run(first, None, one, now)
    stored, offers = spark.read.parquet(f"{one}/signals"), read_snapshot(spark, one)["offers"]
    IngestJob().run(second, one, two, now, stored)
    for frame, path, known, before in ((first, one, None, None), (second, two, stored, offers)):
        want = I.pipeline_counters(frame, stored=known, offers=before).first().asDict()
        got = spark.read.parquet(f"{path}/counters").first().asDict()
        assert got == want and got["blocked"] > 0 and (known is None or got["dup"] > 0)
    assert not (tmp_path / "one" / "_passed").exists() and not (tmp_path / "two" / "_rows").exists()


def test_nothing_arrives(spark, signals, tmp_path):
    IngestJob().run(posts(signals, 1).limit(0), None, str(tmp_path / "t"), F.current_timestamp())
    assert set(spark.read.parquet(str(tmp_path / "t" / "counters")).first().asDict().values()) == {0}


def test_candidates_of_one_pass(spark, signals, tmp_path):
    df = posts(signals, 5)
    IngestJob().run(df, None, str(tmp_path / "t"), F.lit("2026-05-20 00:00:00").cast("timestamp"))
    want = I.harvest_candidates(I.normalize(df)).select("domain", "first_source", "priority")
    got = spark.read.parquet(str(tmp_path / "t" / "candidates")).select("domain", "first_source", "priority")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
