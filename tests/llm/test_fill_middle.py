import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadlens.llm import fill_middle

PLAIN_UNITS = re.compile(r"[^\n]*\n|[^\n]+")


def expected(doc_id, text, rate=100, spm=50):
    """By plain steps: a list of units, joined again."""
    text = text or ""
    units = PLAIN_UNITS.findall(text)
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, form, len(prefix), len(middle), out


def got(frame, **options):
    out = fill_middle.fill_in_middle(frame, **options).withColumn("restored", fill_middle.restored())
    return [(r.doc_id, r.text_hash, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.restored) for r in out.collect()]


def held(docs, rows, extra=None, **options):
    frame = docs(rows, extra)
    texts = {(r.doc_id, r.h): r.text or "" for r in frame.select("doc_id", "text", fill_middle.text_hash().alias("h")).collect()}
    found = got(frame, **options)
    assert len(found) == len(rows)
    for doc_id, mark, values, restored in found:
        assert values == expected(doc_id, texts[doc_id, mark], **{{"suffix_first": "spm"}.get(k, k): v for k, v in options.items()})
        assert restored == texts[doc_id, mark]
    return found


def test_against_plain_steps(docs, odd_rows):
    draw = random.Random(5)
    rows = odd_rows + [
        (100 + k, "".join(draw.choice(["a b", "\n", "\r\n", "ü\U0001f600", "x y", "<", "P>", "\x00"]) for _ in range(draw.randrange(12))), "s")
        for k in range(300)
    ]
    forms = {values[1] for _, _, values, _ in held(docs, rows, ["n", "form", "output", "h1"])}
    assert forms == {"plain", "psm", "spm"}


def test_sentinels_and_rates(docs):
    rows = [(1, "a<P>b\nc", "s"), (2, "<M>", "s"), (3, "<S", "s"), (4, "P>\n<", "s"), (5, "\n", "s"), (6, "\n\n\n", "s"), (7, None, "s")]
    found = {doc: values for doc, _, values, _ in held(docs, rows)}
    assert found[1][1] == found[2][1] == found[7][1] == "plain" and found[7][0] == 0 and found[6][0] == 3
    assert {v[1] for _, _, v, _ in held(docs, [(k, "a\nb\nc", "s") for k in range(60)], rate=50, suffix_first=100)} == {"plain", "spm"}


def test_empty_table(docs):
    assert got(docs([])) == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\n\r\x0b\u0085é", max_size=30), st.integers(1, 9))
def test_unit_ends_in_stretches(text, stretch):
    whole, at = [], 0
    for unit in PLAIN_UNITS.findall(text):
        at += len(unit)
        whole.append(at)
    assert fill_middle.unit_ends(text).tolist() == whole
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fill_middle, "STRETCH", stretch)
        assert fill_middle.unit_ends(text).tolist() == whole


def test_very_long_texts(docs):
    # more lines than the regex library keeps repetitions of one group
    assert len(fill_middle.unit_ends("\n" * 6_000_000)) == 6_000_000
    rows = [(k, ("word " * 9 + "\n") * 60_000, "s") for k in range(3)]
    assert len(held(docs, rows)) == 3


def test_output_in_batches(docs, monkeypatch):
    monkeypatch.setattr(fill_middle, "BATCH", 10)
    held(docs, [(k, "line\n" * k, "s") for k in range(20)])


def test_digest_of_the_id(spark):
    row = spark.createDataFrame([(12,)], "doc_id long").select(*fill_middle.draws()).first()
    x = hashlib.sha256(b"7:12").hexdigest()
    assert list(row) == [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    assert spark.createDataFrame([(None,)], "doc_id long").select(*fill_middle.draws()).where(F.col("h1").isNull()).count() == 0
