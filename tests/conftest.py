import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leadlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one row with column ``x``."""

    def run(expression, value, kind="string"):
        return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("v")).first()["v"]

    return run


META_FLAGS = ("force_classify", "service_candidate", "model_release", "org", "model_id")


@pytest.fixture
def signals(spark):
    """Raw signals from dicts; missing fields NULL, arrival order as given."""
    from pyspark.sql import functions as F

    from leadlens.schemas import with_schema
    from leadlens.sources.common import meta

    def make(rows):
        columns = ("source", "raw_text", "url", "source_url", "lang", "observed_at", *META_FLAGS)
        data = [tuple(r.get(c) for c in columns) + (i,) for i, r in enumerate(rows)]
        ddl = (
            "source string, raw_text string, url string, source_url string, lang string, observed_at string, "
            "force_classify boolean, service_candidate boolean, model_release boolean, org string, model_id string, "
            "ingest_seq bigint"
        )
        df = spark.createDataFrame(data, ddl).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
        flags = meta(**{c: F.col(c) for c in META_FLAGS})
        return with_schema(df.withColumn("meta", flags).drop(*META_FLAGS), "signals_in")

    return make
