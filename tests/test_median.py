"""The exact median by histogram selection, against a sort."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from leadlens.operators import leads as L


def medians(spark, groups, **options):
    out = []
    for values in groups:
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(3)
        out.append(L.exact_median(L.value_counts(df, "x"), **options).first()["median"])
    return out


DRAW = random.Random(4)
GROUPS = [
    [], [5], [1, 2], [2, 2, 2], [1, 1, 9, 9], [-3, 0, 0, 4, 1e12], [DRAW.gauss(0, 1) for _ in range(501)],
    [DRAW.choice([1e-9, 1, 1e9]) * DRAW.random() for _ in range(200)], [0.1 * k for k in range(40)] * 3 + [1e300, -1e300],
    [7] * 50 + [8] * 50, list(range(1000)),
]


@pytest.mark.parametrize("options", [{}, {"cells": 2, "rounds": 2}, {"cells": 8, "rounds": 0}])
def test_against_a_sort(spark, options):
    assert medians(spark, GROUPS, **options) == [statistics.median(map(float, g)) if g else None for g in GROUPS]


def test_no_window_and_no_early_job(spark):
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    before = jobs()
    rows = spark.range(1000).select((F.col("id") % 97).cast("double").alias("lead_hours"))
    frame = L.lead_summary(rows)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert jobs() == before and "Window" not in plan and "Cartesian" not in plan
    assert frame.first()["median_hours"] == statistics.median(k % 97 for k in range(1000))
