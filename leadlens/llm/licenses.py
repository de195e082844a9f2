"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates are cut into word ``GRAM``-grams; in each window of ``WINDOW`` grams the smallest hash is a fingerprint.  Any
common run of ``GRAM + WINDOW - 1`` words shares a fingerprint, so no template with that many matching words in a row is
missed.  Of templates with at most ``SHORT`` words every gram is a fingerprint, and under ``2 * GRAM`` words also the pairs
with an identifying word: with a fifth of the words changed one is always left.  The fingerprints of all templates form an
inverted index: hash to (template, position).  The index has the size of the templates, whatever the corpus, and is broadcast.

A hit gives a diagonal; hits of a template on near diagonals, over at most half its length, are one candidate.  The
candidate's stretch of the text is aligned with the template inside a band around all these diagonals, so that inserted, lost
and changed words are tolerated.
A match has the share of template words matched in order, and the character span from the first to the last of them.

Coverage alone does not tell the AGPL from the GPL, nor a version from the next: the words that identify a license (its
name and version) must be among the matched ones, and of matches that rest on the same words the best is reported.

Nulls: a null text has no words and no match.  A license that a text states several times is matched several times;
repeated rows match each.  Empty table: empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3
WINDOW = 3
BAND = 6  # words that a match may drift from its diagonals
SHORT = 24  # words of a template up to which no gram is left out
COVERAGE = 0.8
MATCHES = "doc_id long, license string, coverage double, matched_words long, first_char long, last_char long"
_WORD = re.compile(r"[0-9a-z]+")

# Published license statements.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"'
_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_ADVERTISING = (
    "All advertising materials mentioning features or use of this software must display the following acknowledgement: "
    "This product includes software developed by the organization."
)
_GNU = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the "
    "Free Software Foundation, either version {2} of the License, or (at your option) any later version."
)
# name: what is licensed, the license's name, its version
_GNU_LICENSES = {
    "gpl-2.0": ("program", "General Public License", "2"),
    "gpl-3.0": ("program", "General Public License", "3"),
    "lgpl-2.0": ("library", "Library General Public License", "2"),
    "lgpl-2.1": ("library", "Lesser General Public License", "2.1"),
    "lgpl-3.0": ("program", "Lesser General Public License", "3"),
    "agpl-3.0": ("program", "Affero General Public License", "3"),
}
_CC = {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives",
    "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
    "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
_CC_VERSIONS = {"4.0": "International", "3.0": "Unported"}
TEMPLATES: dict[str, str] = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "mit-line": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."
    ),
    "bsd-conditions": _BSD,
    "bsd-2-clause": f"{_BSD} {_AS_IS}",
    "bsd-3-clause": f"{_BSD} {_NAMES}",
    "bsd-4-clause": f"{_BSD} {_ADVERTISING}",
    "gpl-2.0-only-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License version 2 as published by the Free Software Foundation."
    ),
    "isc-line": "Released under the ISC License.",
    "isc-permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mpl-1.1-notice": (
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use '
        "this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.mozilla.org/MPL/"
    ),
    "mpl-2.0-line": "Licensed under the Mozilla Public License, version 2.0.",
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "epl-1.0-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 "
        "which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"
    ),
    "epl-2.0-line": "Licensed under the Eclipse Public License, version 2.0.",
    "epl-2.0-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "bsd-2-clause-line": "Released under the BSD 2-Clause License.",
    "bsd-3-clause-line": "Released under the BSD 3-Clause License.",
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."
    ),
    "cc0-1.0-line": "Licensed under CC0 1.0.",
    "cc0-1.0-name": "This work is licensed under the Creative Commons CC0 1.0 Universal Public Domain Dedication.",
    **{f"{name}-notice": _GNU.format(*own) for name, own in _GNU_LICENSES.items()},
    **{f"{n}-line": f"This work is licensed under the GNU {own[1]}, version {own[2]}." for n, own in _GNU_LICENSES.items()},
    **{f"cc-{c}-{v}-line": f"Licensed under CC {c.upper()} {v}." for c in _CC for v in _CC_VERSIONS},
    **{
        f"cc-{c}-{v}-name": f"This work is licensed under a Creative Commons {name} {v} {area} License."
        for c, name in _CC.items() for v, area in _CC_VERSIONS.items()
    },
}
# Phrases of a template that tell it from others: name and version.  All of a phrase's words must be matched, and in a row.
IDENTIFYING: dict[str, tuple[str, ...]] = {
    "apache-2.0-line": ("apache", "version 2 0"),
    "apache-2.0-notice": ("apache", "version 2 0"),
    "mit-line": ("mit",),
    "bsd-2-clause": ("this software is provided",),
    "bsd-3-clause": ("neither the name",),
    "bsd-4-clause": ("all advertising materials",),
    "gpl-2.0-only-notice": ("gnu general", "version 2"),
    "isc-line": ("isc",),
    "mpl-1.1-notice": ("mozilla", "version 1 1"),
    "mpl-2.0-line": ("mozilla", "version 2 0"),
    "mpl-2.0-notice": ("mozilla", "v 2 0"),
    "epl-1.0-notice": ("eclipse", "v1 0"),
    "epl-2.0-line": ("eclipse", "version 2 0"),
    "epl-2.0-notice": ("eclipse", "license 2 0"),
    "bsd-2-clause-line": ("bsd 2 clause",),
    "bsd-3-clause-line": ("bsd 3 clause",),
    "cc0-1.0-line": ("cc0 1 0",),
    "cc0-1.0-name": ("cc0 1 0",),
    **{
        f"{name}-{form}": (f"gnu {own[1].split()[0].lower()}", f"version {own[2].replace('.', ' ')}")
        for name, own in _GNU_LICENSES.items() for form in ("notice", "line")
    },
    **{f"cc-{c}-{v}-line": (f"cc {c} {v}",) for c in _CC for v in _CC_VERSIONS},
    **{f"cc-{c}-{v}-name": (f"commons {name} {v}",) for c, name in _CC.items() for v in _CC_VERSIONS},
}


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the fingerprints: in each window the last smallest hash."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    wide = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, wide)
    back = wide - 1 - views[:, ::-1].argmin(axis=1)
    return np.unique(back + np.arange(len(views)))


class Index:
    """The templates and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str] | None = None, gram: int = GRAM, window: int = WINDOW):
        self.names, self.texts = [], []
        for name, text in sorted((templates or TEMPLATES).items()):
            self.names.append(name)
            self.texts.append(words(text))
        self.phrases = [
            [places_of(words(phrase), own) for phrase in IDENTIFYING.get(name, ())] for name, own in zip(self.names, self.texts)
        ]
        self.gram, self.window = gram, window
        self.ids = {w: k for k, w in enumerate(sorted({w for t in self.texts for w in t}))}
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, own in enumerate(self.texts):
            grams, hashes = self.grams([self.ids[w] for w in own])
            for at in winnow(hashes, window).tolist():
                self.postings[int(grams[at])].append((t, at))
        # grams that are looked up wherever they stand: size to number to (template, position)
        self.everywhere: dict[int, dict[int, list[tuple[int, int]]]] = {gram: defaultdict(list), 2: defaultdict(list)}
        for t, own in enumerate(self.texts):
            marks = {k for phrase in self.phrases[t] for k in phrase[:1]}
            for size, most in ((gram, SHORT), (2, 2 * gram - 1)):
                if len(own) <= most:
                    for at, number in enumerate(self.grams([self.ids[w] for w in own], size)[0].tolist()):
                        if size == gram or not marks or {at, at + 1} & marks:
                            self.everywhere[size][number].append((t, at))
        self.numbers = {size: np.array(sorted(own), np.int64) for size, own in self.everywhere.items()}

    def grams(self, ids: list[int], gram: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Grams as exact numbers, and their hashes.  A gram with a word of no template can't match: its hash is the
        greatest, so that it is no fingerprint where a common run fills a window."""
        own, gram = np.asarray(ids, np.int64), gram or self.gram
        n = len(own) - gram + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        number, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(gram):
            part = own[k : k + n]
            known &= part >= 0
            number = number * (len(self.ids) + 1) + part
        hashes = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(crc32(b"license"))
        hashes ^= hashes >> np.uint64(29)
        return np.where(known, number, -1), np.where(known, hashes, np.uint64(2**64 - 1))

    def candidates(self, own: list[str]) -> list[tuple[int, int, int]]:
        """(template, first, last diagonal): the words of the text at which the template would begin."""
        get = self.ids.get
        ids = [get(w, -1) for w in own]
        numbers, hashes = self.grams(ids)
        hits: dict[int, set[int]] = defaultdict(set)
        if (numbers >= 0).any():
            for at in winnow(hashes, self.window).tolist():
                for template, place in self.postings.get(int(numbers[at]), ()):
                    hits[template].add(at - place)
        for size, postings in self.everywhere.items():
            numbers = self.grams(ids, size)[0]
            for at in np.flatnonzero(np.isin(numbers, self.numbers[size])).tolist():
                for template, place in postings[int(numbers[at])]:
                    hits[template].add(at - place)
        out = []
        for template, diagonals in hits.items():
            half = len(self.texts[template]) // 2  # two statements are further apart
            out += [(template, *ends) for ends in ranges(sorted(diagonals), min(BAND, half), half)]
        return sorted(out, key=lambda c: (c[1], c[0]))


def ranges(diagonals: list[int], near: int, most: int) -> list[tuple[int, int]]:
    """First and last of the chains of diagonals at most ``near`` apart; a chain over more than ``most`` is given as
    overlapping ranges that begin more than ``near`` apart."""
    out: list[tuple[int, int]] = []
    to = 0
    for k, d in enumerate(diagonals):
        if out and d - out[-1][0] <= near:
            continue
        to = max(to, k)
        while to + 1 < len(diagonals) and diagonals[to + 1] - diagonals[to] <= near and diagonals[to + 1] - d <= most:
            to += 1
        if not out or diagonals[to] > out[-1][1]:
            out.append((d, diagonals[to]))
    return out


def align(template: list[str], text: list[str], diagonal: int, last: int, band: int = BAND) -> dict[int, int]:
    """Longest common subsequence of the template and the text inside the band around the diagonals, of equally long ones the one that begins
    latest and then ends earliest: the text's word for each matched word of the template."""
    width = last - diagonal + 2 * band + 1
    start = diagonal - band
    # cell k of row i stands for the text's word start + i + k; a cell is a number (matched, first, end before) and a chain
    none = (0xFFFF, None)
    before = [none] * (width + 1)
    for i, word in enumerate(template):
        row = [none] * (width + 1)
        for k in range(width):
            best, left = before[k + 1], row[k - 1] if k else none  # leave out a word of the template, or of the text
            if left[0] > best[0]:
                best = left
            j = start + i + k
            if 0 <= j < len(text) and text[j] == word:
                score, chain = before[k]
                first = score >> 16 & 0xFFFF if chain else i + k
                own = ((score >> 32) + 1) << 32 | first << 16 | 0xFFFF - (i + k)
                if own > best[0]:
                    best = own, (i, j, chain)
            row[k] = best
        before = row
    chain = max(before, key=lambda c: c[0])[1]
    out = {}
    while chain:
        out[chain[0]] = chain[1]
        chain = chain[2]
    return out


def places_of(phrase: list[str], own: list[str]) -> list[int]:
    """Places of a phrase in its template."""
    at = next(k for k in range(len(own)) if own[k : k + len(phrase)] == phrase)
    return list(range(at, at + len(phrase)))


def identified(phrases: list[list[int]], matched: dict[int, int]) -> bool:
    """All words of each phrase are matched, in a row."""
    return all(
        k in matched and (k == phrase[0] or matched[k] == matched.get(k - 1, -2) + 1) for phrase in phrases for k in phrase
    )


def without_rivals(index: Index, found: list[tuple[int, dict[int, int]]]) -> list[tuple[int, dict[int, int]]]:
    """The best of the matches that rest on the same words.  A match goes if a better one (more words, then a shorter span)
    has matched all its identifying words, or, where it has none, most of its words.  Two licenses that one sentence names
    rest on names of their own and both stay."""
    span = lambda m: max(m.values()) - min(m.values())
    kept: list[tuple[int, dict[int, int]]] = []
    taken: list[set[int]] = []
    for t, matched in sorted(found, key=lambda x: (-len(x[1]), span(x[1]), x[0], min(x[1].values()))):
        marks = [matched[k] for phrase in index.phrases[t] for k in phrase]
        own, least = (marks, len(marks)) if marks else (list(matched.values()), len(matched) // 2 + 1)
        if not any(sum(j in other for j in own) >= least for other in taken):
            kept.append((t, matched))
            taken.append(set(matched.values()))
    return kept


def scan_text(index: Index, text: str | None, coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched words, first and last character + 1) of each match of a whole text."""
    own = words(text)
    found = []
    for template, diagonal, last in index.candidates(own):
        matched = align(index.texts[template], own, diagonal, last)
        straight = align(index.texts[template], own, diagonal, last, 0)  # of like statements in a row, that of this place
        if len(straight) == len(matched):
            matched = straight
        if len(matched) >= coverage * len(index.texts[template]) and identified(index.phrases[template], matched):
            found.append((template, matched))
    if not found:
        return []
    low = text.lower()
    # lower case may change the number of characters; then places are those of the lower-case text
    places = [m.span() for m in _WORD.finditer(low)]
    rows = [(min(m.values()), t, len(m), max(m.values())) for t, m in without_rivals(index, found)]
    return [
        (index.names[t], n / len(index.texts[t]), n, places[first][0], places[last][1]) for first, t, n, last in sorted(rows)
    ]


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``MATCHES``, one row for each match in ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))
    names = [c.split()[0] for c in MATCHES.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            out = [
                (doc, *match)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for match in scan_text(index, text, coverage)
            ]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, MATCHES)
