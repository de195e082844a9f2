import random
import re

import numpy as np
import pytest

from leadlens.llm import repetition
from tests.llm.conftest import prose


def slow_longest(words):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            n = 0
            while i != j and i + n < len(words) and j + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


def slow(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen = {w for w in windows if windows.count(w) > 1}
    covered = {k + d for k, w in enumerate(windows) if w in seen for d in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:k] for k, x in enumerate(lines)),
        len(covered), failed,
    )


@pytest.mark.parametrize("seed", range(15))
def test_longest_repeats(seed):
    draw = random.Random(seed)
    texts = [[draw.randrange(draw.choice([1, 2, 3, 50])) for _ in range(draw.randrange(60))] for _ in range(6)]
    flat = np.array([w for t in texts for w in t], np.int64)
    stops = np.cumsum([len(t) for t in texts])
    ends = np.repeat(stops, [len(t) for t in texts])
    assert repetition.longest_repeats(flat, ends).tolist() == [n for t in texts for n in slow_longest(t)]


def test_rules_against_brute_force(docs, odd_rows, monkeypatch):
    passage = prose(3, 12)
    texts = [
        prose(5, 200), f"{prose(6, 150)} {passage} {prose(7, 150)} {passage}", "la " * 300, "a b\na b\n\na b\nc | $ é x #", "x " * 9, "one\r\none\r\n" * 3,
        "\n".join([prose(8, 20)] * 3), None,
    ]
    rows = [(100 + k, t, "s") for k, t in enumerate(texts)] + [r for r in odd_rows if len(r[1] or "") < 2000]
    out = repetition.quality(docs(rows, ["kept", "n_words"])).collect()
    got = sorted([(str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out])
    assert got == sorted([(str(d), *slow(t)) for d, t, _ in rows])
    kept = {r.doc_id: r.kept for r in out}
    assert kept[100] and kept[101] and not kept[102] and not kept[106] and not kept[107]
    monkeypatch.setattr(repetition, "WORDS", 1)
    assert repetition.measure(texts, [1] * 8) == repetition.measure(texts, [1] * 8)
    assert repetition.quality(docs([])).count() == 0


def test_a_long_repeat_is_rejected():
    passage = prose(11, repetition.LONGEST + 1, 10**6)
    other = prose(12, 3000, 10**6)
    out = repetition.measure([f"{other} {passage} {prose(13, 3000, 10**6)} {passage}", other], [1, 2])
    assert out["base_failed"] == [False, False] and out["kept"] == [False, True]
    assert out["longest_repeat"][0] == repetition.LONGEST + 1 and out["n_maximal"][0] >= 1


def strings(words):
    """Every repeated string of LEAST words and more with its places, and whether it is a maximal repeat."""
    places = {}
    for i in range(len(words)):
        for j in range(i + repetition.LEAST, len(words) + 1):
            places.setdefault(tuple(words[i:j]), []).append(i)
    for string, at in places.items():
        if len(at) > 1:
            left = {words[p - 1] if p else None for p in at}
            right = {words[p + len(string)] if p + len(string) < len(words) else None for p in at}
            yield string, at, len(left) > 1 and len(right) > 1


@pytest.mark.parametrize("seed", range(20))
def test_maximal_repeats_against_brute_force(seed, monkeypatch):
    draw = random.Random(seed)
    monkeypatch.setattr(repetition, "LONGEST", 9)
    monkeypatch.setattr(repetition, "MOST_REPEATED", 60)
    texts = [[f"w{draw.randrange(draw.choice([1, 2, 3, 9])):03d}" for _ in range(draw.randrange(70))] for _ in range(8)]
    passage = [f"p{draw.randrange(9)}" for _ in range(8)]
    texts += [["x", *passage, "y", *passage, "z", *passage[:5], "u", *passage[2:]], passage * 3, []]
    out = repetition.measure([" ".join(t) for t in texts], list(range(len(texts))))
    for k, words in enumerate(texts):
        found = list(strings(words))
        covered = {p + d for string, at, maximal in found if maximal for p in at for d in range(len(string))}
        fraction = sum(len(words[p]) for p in covered) / max(1, sum(map(len, words)))
        most = max(slow_longest(words), default=0)
        failed = len(words) < repetition.FEWEST or 100 * len(covered) > repetition.MOST_REPEATED * len(words)
        assert out["n_maximal"][k] == sum(maximal for *_, maximal in found)
        assert out["n_repeat_words"][k] == len(covered) and out["covered_fraction"][k] == pytest.approx(fraction)
        assert (out["longest_repeat"][k], out["base_failed"][k]) == (most, failed)
        assert out["kept"][k] == (not failed and fraction <= repetition.COVERED and most <= repetition.LONGEST)


def test_strings_are_counted_not_places():
    words = "a b c d e f g h i j"
    out = repetition.measure([f"{words} x {words} y {words[:9]} z {words[:9]}"], [1])
    assert (out["n_maximal"], out["longest_repeat"]) == ([2], [10])


def test_intervals_nest():
    tree = repetition.Intervals(np.array([0, 5, 7, 7, 6, 0, 9, 3, 8], np.int32))
    assert list(zip(tree.first.tolist(), tree.last.tolist(), tree.length.tolist(), tree.parent.tolist())) == [
        (0, 4, 5, -1), (1, 3, 7, 2), (1, 4, 6, 0), (5, 6, 9, -1), (7, 8, 8, -1),
    ]


def test_long_texts_through_spark(docs):
    rows = [(1, prose(21, 60_000, 10**7), "s"), (2, "la " * 200_000, "s"), (3, prose(22, 500), "s"), (4, " ".join([prose(23, 150, 10**6)] * 400), "s")]
    got = {r.doc_id: r for r in repetition.quality(docs(rows)).collect()}
    assert got[1].n_repeat_words == 0 and got[1].kept
    assert (got[2].longest_repeat, got[2].n_repeat_words, got[2].kept) == (199_999, 200_000, False)
    assert (got[4].longest_repeat, got[4].covered_fraction, got[4].kept) == (150 * 399, 1.0, False)
    assert got[3].n_words == 500
