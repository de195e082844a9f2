"""Statements with changed and inserted words are candidates, and are aligned as far as they drift."""

from leadlens.llm import licenses
from tests.llm.conftest import prose


def names(text):
    return [m[0] for m in licenses.scan_text(licenses.Index(), f"{prose(1, 30)} {text} {prose(2, 30)}")]


def test_one_changed_word_in_any_place_of_a_short_line():
    index = licenses.Index()
    for t, own in enumerate(index.texts):
        if len(own) > licenses.SHORT:
            continue
        marks = {k for phrase in index.phrases[t] for k in phrase}
        for k in set(range(len(own))) - marks:
            assert names(" ".join([*own[:k], "changed", *own[k + 1 :]])) == [index.names[t]], (index.names[t], k)


def test_two_licenses_of_one_sentence():
    assert names("Licensed under the MIT License or the Apache License, Version 2.0.") == ["apache-2.0-line", "mit-line"]


def test_short_statements_in_a_row_are_all_found():
    assert names("Released under the MIT License. " * 4) == ["mit-line"] * 4


def test_drift_beyond_the_band_is_aligned():
    words = licenses.words(licenses.TEMPLATES["apache-2.0-notice"])
    wordy = " ".join(w + " inserted" * (k % 8 == 7) for k, w in enumerate(words))
    match = licenses.scan_text(licenses.Index(), wordy)
    assert [(m[0], m[1]) for m in match] == [("apache-2.0-notice", 1.0)]
    assert sum(k % 8 == 7 for k in range(len(words))) > licenses.BAND


def test_ranges():
    assert licenses.ranges([0, 5, 10, 30], 6, 50) == [(0, 10), (30, 30)]
    assert licenses.ranges([0, 5, 10, 15], 6, 10) == [(0, 10), (10, 15)]
    assert licenses.ranges([0, 5], 2, 2) == [(0, 0), (5, 5)]
