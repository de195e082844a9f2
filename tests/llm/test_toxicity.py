import math
import random
import zlib

import numpy as np

from leadlens.llm import toxicity
from tests.llm.conftest import prose

BAD = {"en": ["vilenesk", "grobbich"], "xx": ["schlurmp", "quandorf"]}


def corpus(n):
    draw = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        lang = draw.choice(["en", "xx"])
        words = [("" if lang == "en" else "x") + w for w in prose(k, draw.randint(20, 200), 3000).split()]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(draw.randrange(len(words)), draw.choice(BAD[lang]).upper() + draw.choice([",", "!", ""]))
        rows.append((k, " ".join(words), lang, "s", 0))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_accuracy_and_edge_cases(spark):
    rows, labels = corpus(900)
    odd = [(None, None, None, None, None), (5000, "", None, None, None), (5001, prose(77, 20_000, 3000), "en", "s", 0), (5001, prose(77, 20_000, 3000), "en", "s", 0)]
    docs, marks = frames(spark, rows + odd, labels + [(None, 1, 1), (17, 0, None), (10**12, 0, 1)])
    out = toxicity.toxicity(docs.repartition(3), marks).collect()
    assert len(out) == len(rows) + len(odd)
    truth = {d: t for d, _, t in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    assert right >= 0.97
    assert all(not r.predicted for r in out if r.doc_id in (None, 5000, 5001))
    kept = toxicity.acceptable(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in out)


def test_only_the_text_is_scored(spark):
    rows, labels = corpus(200)
    docs, marks = frames(spark, rows, labels)
    model = toxicity.fit(docs, marks)
    again = toxicity.fit(docs.repartition(7), marks.repartition(3))
    assert [model.score(r[1]) for r in rows[:50]] == [again.score(r[1]) for r in rows[:50]]


def test_labels_of_the_held_out_third_are_not_learned(spark):
    rows, labels = corpus(200)
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, q, t in labels]
    one, two = (toxicity.fit(*frames(spark, rows, ls)) for ls in (labels, flipped))
    assert [one.score(r[1]) for r in rows[:40]] == [two.score(r[1]) for r in rows[:40]]


def test_nothing_to_learn(spark):
    docs, marks = frames(spark, [(1, "a", "en", "s", 0)], [(1, 1, 0)])
    assert [r.score for r in toxicity.toxicity(docs, marks).collect()] == [0.0]
    docs, marks = frames(spark, [], [])
    assert toxicity.toxicity(docs, marks).count() == 0


def plain_pool(model, text):
    """Every filter at every place of the text, by sums over words, hashes and letters of an embedding."""
    ids = toxicity.buckets(text)
    vectors = [sum(model.embed[h][ids[h, i]].astype(float) for h in range(toxicity.HASHES)) for i in range(ids.shape[1])]
    out = []
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = 0.0
            for i in range(len(vectors) - width + 1):
                total = sum(float(vectors[i + j] @ model.filters[k][j][:, f]) for j in range(width))
                best = max(best, total + float(model.bias[k * toxicity.FILTERS + f]))
            out.append(best)
    return out


def test_scores_against_a_plain_convolution(spark, monkeypatch):
    rows, labels = corpus(160)
    model = toxicity.fit(*frames(spark, rows, labels))
    texts = [r[1] for r in rows[:25]] + ["", None, "one", "two words", prose(5, 400, 40)]

    def plain(text):
        ids = toxicity.buckets(text)
        odds = float(np.dot(plain_pool(model, text), model.weights) + model.constant) - model.thresholds[model.language(ids)]
        return 1 / (1 + math.exp(-max(-30, min(30, odds + toxicity._odds(toxicity.ACCEPT)))))

    for text in texts:
        assert np.allclose(model.pooled(toxicity.buckets(text)), plain_pool(model, text), atol=1e-4)
    want = [plain(t) for t in texts]
    assert np.allclose([model.score(t) for t in texts], want, atol=1e-4)
    # blocks, and a memory that is full again and again
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    monkeypatch.setattr(toxicity, "REMEMBER", 12)
    model.__dict__.pop("memory")
    assert np.allclose([model.score(t) for t in texts], want, atol=1e-4) and len(model.memory.places) <= 12


def test_the_greater_of_contradicting_labels_counts(spark):
    rows, labels = corpus(120)
    docs, marks = frames(spark, rows, labels)
    _, twice = frames(spark, rows, labels + [(d, q, 0) for d, q, _ in labels])
    one, two = toxicity.fit(docs, marks), toxicity.fit(docs, twice)
    assert [one.score(r[1]) for r in rows[:30]] == [two.score(r[1]) for r in rows[:30]]
