import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text, source) as documents."""

    def make(rows, extra=None):
        frame = spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in extra:
                frame = frame.withColumn(name, F.lit("x"))
        return frame

    return make


def prose(seed: int, words: int, vocabulary: int = 500) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture
def odd_rows():
    """Null and empty values, ties, repeated rows, a long text, copies that differ in white space."""
    long = prose(1, 6000)
    return [
        (5, "a b\tc", "s1"), (3, "abc", "s2"), (9, "a b c ", "s1"), (9, "a b c ", "s1"), (None, "ab c", None),
        (4, None, "s1"), (6, "", None), (7, " \n\x0b", "s3"), (8, long, "s1"), (2, long + " x", "s2"), (1, long, "s1"),
        (None, None, None), (10, "ünï \U0001f600 codé", "s4"), (11, "a b", "s1"), (12, "a b", "s1"),
    ]
