"""Word lists of thousands of words give what short ones give."""

import random
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadlens import lexicon as lx
from leadlens.functions import text as X
from leadlens.functions import words as W

WORD = st.text(alphabet="abß免", max_size=4)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORD, max_size=8), st.none() | st.text(alphabet="abß免 ", max_size=20))
def test_automaton(words, text):
    automaton = W.Automaton(words)
    want = [w for w in words if text is not None and w in text]
    assert automaton.hits(text) == want and automaton.any(text) == bool(want)


@pytest.fixture
def texts(spark):
    draw = random.Random(2)
    words = ["free", "trial", "credits", "免费", "额度", "注册送", "триал", "sign up", "$5", "x", "filler7", "filler3999", "opus", "gpt"]
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(8)))) for i in range(400)] + [(400, None), (401, "")]
    return spark.createDataFrame(rows, "id int, t string").repartition(3)


def longer(lex, n=4000):
    filler = tuple(f"zz{k}zz" for k in range(n))
    return replace(
        lex, zh_strong=lex.zh_strong + filler, zh_weak=lex.zh_weak + filler, ru=lex.ru + filler, en_strong=lex.en_strong + filler,
        en_weak=lex.en_weak + filler, models=lex.models + filler,
    )


def test_long_lists_decide_as_short_ones(texts):
    lex = lx.Lexicon()
    t = F.col("t")
    got = texts.select(
        X.prefilter(t, lex).alias("a"), X.prefilter(t, longer(lex)).alias("b"), X.passes_prefilter(t, lex).alias("c"),
        X.passes_prefilter(t, longer(lex)).alias("d"), X.find_models(t, lex.models).alias("e"), X.find_models(t, longer(lex).models).alias("f"),
        W.has_any(t, ["x", "opus"]).alias("g"), W.has_any(t, ["x", "opus", *(f"q{k}q" for k in range(1000))]).alias("h"),
    ).collect()
    assert any(r["a"]["ok"] for r in got) and not all(r["a"]["ok"] for r in got)
    for r in got:
        assert (r["a"], r["c"], sorted(r["e"]), r["g"]) == (r["b"], r["d"], sorted(r["f"]), r["h"])


def test_a_long_list_in_the_whole_pipeline(spark, signals):
    from leadlens.operators import ingest as I

    df = signals([{"source": "a", "raw_text": f"free trial of the api https://a{i}.ai {i % 3 * 'promo '}" if i % 2 else f"filler{i}"} for i in range(40)])
    lex = lx.Lexicon()
    pick = lambda l: sorted(map(str, I.label_signals(df, l).select("ingest_seq", "route", "label").collect()))
    assert pick(lex) == pick(longer(lex)) != []
