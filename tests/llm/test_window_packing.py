import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadlens.llm import queries, window_packing
from leadlens.llm.encode import encoder
from leadlens.llm.window_packing import Packer, Piece, powers

from tests.llm.conftest import prose

VOCABULARY = queries.vocabulary(queries.WORD_VOCABULARY)


def ids_of(text, end=2):
    return np.append(encoder(VOCABULARY).tokenizer.encode(text or "", add_special_tokens=False).ids, end).astype("<u4")


def checked(rows, table, capacity):
    """Every id of every row lies in one piece, sequences are gapless, and only powers of two are short."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in table:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id, r.text_hash, r.doc_tokens].append(r)
    for spans in sequences.values():
        total = 0
        for offset, length in sorted(spans):
            assert offset == total and length > 0
            total += length
        assert total <= capacity and (total == capacity or total & (total - 1) == 0)
    # a repeated row has each of its pieces as often, maybe cut elsewhere: tokens at a start cover the document n times
    want = Counter((i, len(ids_of(t))) for i, t, _ in rows)
    tokens = Counter()
    for (doc, _, n), pieces in documents.items():
        tokens[doc, n] += sum(p.length for p in pieces)
    assert {k: n * k[1] for k, n in want.items()} == dict(tokens)
    texts = {(i, len(ids_of(t))): ids_of(t) for i, t, _ in rows}
    for (doc, _, n), pieces in documents.items():
        ids, cover = texts[doc, n], np.zeros(n, int)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            cover[p.start : p.start + p.length] += 1
        assert len(set(cover.tolist())) == 1
    return sequences


@pytest.mark.parametrize("capacity, windows, fan, parts", [(64, 3, 2, 7), (128, 8, 64, 3), (4096, 64, 64, 5)])
def test_whole_job(spark, docs, odd_rows, capacity, windows, fan, parts):
    rows = odd_rows + [(100 + k, prose(k, random.Random(k).randrange(60)), "s") for k in range(120)]
    frame = docs(rows, ["offset", "part", "ids"]).repartition(parts)
    table = window_packing.pack(frame, VOCABULARY, capacity, windows=windows, fan=fan).collect()
    checked(rows, table, capacity)
    again = window_packing.pack(frame, VOCABULARY, capacity, windows=windows, fan=fan).collect()
    assert sorted(map(str, table)) == sorted(map(str, again))


def test_empty_and_single(docs):
    assert window_packing.pack(docs([]), VOCABULARY).count() == 0
    (only,) = window_packing.pack(docs([(None, None, None)]), VOCABULARY).collect()
    assert (only.doc_id, only.start, only.length, only.doc_tokens, only.offset) == (None, 0, 1, 1, 0)
    assert only.ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes())


def piece(k, n):
    return Piece(k, 0, n, 0, np.arange(n, dtype="<u4") + 1000 * k)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=40), st.integers(1, 5))
def test_packer_keeps_few_windows_open(lengths, windows):
    packer, out = Packer(16, windows), []
    for k, n in enumerate(lengths):
        out += packer.add(piece(k, n))
        assert len(packer.open) <= windows and len(packer.gaps) == len(packer.open)
        for gap, window in packer.gaps:
            assert 0 < gap == 16 - sum(len(p.ids) for p in packer.open[window])
    assert all(sum(len(p.ids) for p in w) == 16 for w in out)
    closed = list(packer.close())
    assert all(sum(len(p.ids) for p in w) == 16 for w in closed) and len(packer.open) <= 1
    short = list(powers(packer.leftover()))
    assert sorted({sum(len(p.ids) for p in w) for w in short}) == sorted(sum(len(p.ids) for p in w) for w in short)
    got = sorted((p.doc, p.start, len(p.ids)) for w in out + closed + short for p in w)
    ends = defaultdict(int)
    for doc, start, n in got:
        assert start == ends[doc]
        ends[doc] += n
    assert dict(ends) == dict(enumerate(lengths))


def test_best_fit_before_cutting():
    packer = Packer(10, 2)
    assert list(packer.add(piece(0, 6))) == [] and list(packer.add(piece(1, 7))) == []
    (full,) = packer.add(piece(2, 3))  # gaps 4 and 3: the smaller one that takes it
    assert [p.doc for p in full] == [1, 2]
    assert list(packer.add(piece(3, 8))) == []
    (cut,) = packer.add(piece(4, 5))  # none fits: the fullest takes the head
    assert [(p.doc, p.start, len(p.ids)) for p in cut] == [(3, 0, 8), (4, 0, 2)]
    assert sorted((p.doc, p.start, len(p.ids)) for w in packer.open.values() for p in w) == [(0, 0, 6), (4, 2, 3)]
