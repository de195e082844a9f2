import hashlib
import re

import pytest
from pyspark.sql import functions as F

from leadlens.llm import exact_dedup
from leadlens.llm.kit import text_hash


def brute(rows):
    groups = {}
    for doc, text, _ in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((doc, text or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(d, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for d, _ in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("salts", [1, 7])
def test_every_row_gets_its_group(docs, odd_rows, salts):
    out = exact_dedup.exact_duplicates(docs(odd_rows, ["kept", "content", "salt", "rank"]).repartition(5), salts)
    got = sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out.collect()], key=str)
    assert got == brute(odd_rows)


def test_one_row_of_each_text_stays_whole(docs, odd_rows):
    out = exact_dedup.dedup(docs(odd_rows, ["kept_id", "kept_hash"]))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept_id", "kept_hash"]
    assert len(out.collect()) == len({re.sub("[\x20\x09-\x0d]", "", t or "") for _, t, _ in odd_rows})


def test_texts_of_one_digest_are_told_apart(docs, spark, monkeypatch):
    """With a digest that always collides the texts themselves decide."""
    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda column, bits: real(F.lit("same"), bits))
    rows = [(1, "a b", "s"), (2, "ab", "s"), (3, "c", "s"), (4, "c ", "s"), (5, "d", "s")]
    out = exact_dedup.exact_duplicates(docs(rows)).collect()
    assert sorted((r.doc_id, r.keep_id) for r in out) == [(1, 1), (2, 1), (3, 4), (4, 4), (5, 5)]


def test_empty_table(docs):
    assert exact_dedup.exact_duplicates(docs([])).count() == 0
    assert exact_dedup.dedup(docs([])).count() == 0


def test_no_python_in_the_plan(docs, odd_rows):
    plan = exact_dedup.exact_duplicates(docs(odd_rows).withColumn("text", text_hash().cast("string")))
    assert "Python" not in plan._jdf.queryExecution().toString()
