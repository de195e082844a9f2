"""Pages by a rank without a time equal pages of offers that were all rescored."""

import random

import pytest
from pyspark.sql import functions as F

from leadlens import schemas
from leadlens.lexicon import ScoreWeights
from leadlens.operators import scoring


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(8)
    days = ["2026-05-01", "2026-05-02", "2026-05-20", "2026-06-30", "2024-01-01", "2010-01-01", None]
    offers = [
        (i, draw.randrange(30) or None, draw.choice(["relay", "saas_trial", "grant"]), draw.choice([None, 0.0, 20.0, 80.0, 5000.0]),
         draw.random() < 0.3, draw.choice(days) and f"{draw.choice(days[:-1])} {draw.randrange(24):02d}:00:00")
        for i in range(600)
    ]
    services = [(i, draw.choice([0.0, 0.4, 1.0, None])) for i in range(1, 25)]
    signals = [(draw.randrange(1, 30), draw.choice(["nodeseek", "telegram", "reddit", "x"]), draw.choice(["zh", "ru", "en", None])) for _ in range(70)]
    o = spark.createDataFrame(offers, "id long, service_id long, type string, amount double, referral_required boolean, seen string")
    o = schemas.with_schema(o.withColumn("first_seen_at", F.col("seen").cast("timestamp")), "offers")
    return o, spark.createDataFrame(services, "id long, reliability double"), spark.createDataFrame(signals, "service_id long, source string, lang string")


@pytest.mark.parametrize("as_of", ["2026-05-20 13:00:00", "2026-05-02 00:00:00", "2012-01-01 00:00:00", "2090-01-01 00:00:00"])
@pytest.mark.parametrize("limit, offset, half_life", [(10, 0, 48.0), (40, 25, 2000.0), (700, 0, 48.0), (5, 598, 48.0)])
def test_pages(spark, tables, as_of, limit, offset, half_life):
    weights, now = ScoreWeights(half_life_hours=half_life), F.lit(as_of).cast("timestamp")
    ranked = scoring.ranked(*tables, weights)
    assert ranked.where("early").count() > 0
    got = scoring.top_by_score(ranked, now, limit, offset, weights).select("id", "score").collect()
    whole = scoring.rescore(*tables, now, weights).orderBy(F.desc("score"), F.desc("first_seen_at"), F.asc("id"))
    want = whole.select("id", "score").collect()[offset : offset + limit]
    assert list(map(tuple, got)) == list(map(tuple, want))


def test_few_offers_are_scored(spark, tables):
    offers, services, signals = tables
    weights, now = ScoreWeights(half_life_hours=48.0), F.lit("2026-05-20 13:00:00").cast("timestamp")
    page = scoring.top_by_score(scoring.ranked(offers, services, signals, weights), now, 10, 0, weights)
    assert "rank" in page.columns and page.count() == 10
    empty = scoring.ranked(offers.limit(0), services, signals, weights)
    assert scoring.top_by_score(empty, now, 10).count() == 0
