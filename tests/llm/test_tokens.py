import bisect
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadlens.llm import packing, queries, token_files
from leadlens.llm.crc32c import crc32c, masked
from leadlens.llm.encode import Encoder

NAMES = [queries.WORD_VOCABULARY, queries.BYTE_VOCABULARY]
ENCODERS = {}


def encoder(name):
    if name not in ENCODERS:
        ENCODERS[name] = Encoder(queries.vocabulary(name))
    return ENCODERS[name]


def whole(name, text):
    return encoder(name).tokenizer.encode(text, add_special_tokens=False).ids


TRICKY = [
    "", " ", "\n", "a", " a", "a  b", "a \n b", "a\n\nb", "Word, word. don't DON'T 'super' it's", "x y z", "é É ́",
    "<|endoftext|> a<|endoftext|>b", "<|startoftext|>", "\x1c\x1d a\x85b", "ß ẞ İ ı ſ K ς Σ ΑΣ", "12345 1a2b", "日本語 テキスト", "\U0001f600!", "tab\tend\t", "\r\na",
    "àb À ÿ Ÿ", "...", "it's.\nBut", "\n word,", "\n\n word", "Ünï? «x»", "a\x0b\x0cb",
]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("text", TRICKY)
def test_pieces_give_the_ids_of_the_whole(name, text):
    assert encoder(name).ids(text).tolist() == whole(name, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "'", "s", " ", "\n", ".", ",", "1", " ", "́", "word", "ß", "<|endoftext|>", "\t", "ſ", "漢"]), max_size=14))
def test_any_mixture(parts):
    for name in NAMES:
        assert encoder(name).ids("".join(parts)).tolist() == whole(name, "".join(parts))


def test_memory_is_bounded(monkeypatch):
    import leadlens.llm.encode as module

    monkeypatch.setattr(module, "REMEMBER", 3)
    own = Encoder(queries.vocabulary(NAMES[0]))
    text = "one two three four five, six one"
    assert own.ids(text).tolist() == whole(NAMES[0], text)
    assert len(own.pieces) == 3 and len(own.stems) == 3


def test_crc32c():
    assert crc32c([b"123456789"]).tolist() == [0xE3069283]
    assert crc32c([]).tolist() == []
    draw = random.Random(3)

    def slow(data):
        crc = 0xFFFFFFFF
        for byte in data:
            crc ^= byte
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    strings = [draw.randbytes(n) for n in (4, 5, 63, 64, 65, 128, 1000, 5000, 8)]
    assert crc32c(strings).tolist() == [slow(s) for s in strings]
    assert masked(np.array([0], np.uint32)).tolist() == [0xA282EAD8]


def expected_ids(name, text, end):
    return np.array(whole(name, text or "") + [end], "<u4")


def test_token_files_round_trip(docs, odd_rows):
    rows = odd_rows + [(-7, "below zero", "s"), (2**60 + 1, "large id", "s")]
    manifest = token_files.write(docs(rows, ["part", "start"]).repartition(4), queries.vocabulary(NAMES[1]))
    table = sorted(token_files.read(manifest).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in table]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in table] == np.concatenate(([0], np.cumsum([r.n_tokens for r in table])[:-1])).tolist()
    want = sorted((str(i), zlib.crc32(expected_ids(NAMES[1], t, 2))) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in table) == want
    row = next(r for r in table if r.doc_id == 10)
    doc, found = token_files.fetch(row.path, row.place, row["size"])
    assert doc == 10 and found.tolist() == expected_ids(NAMES[1], odd_rows[12][1], 2).tolist()
    assert token_files.read(token_files.write(docs([]), queries.vocabulary(NAMES[1]))).count() == 0


def test_token_file_damage_is_seen():
    record = token_files.frame([b"payload one"])[0]
    assert token_files.unframe([record]) == [b"payload one"]
    with pytest.raises(ValueError):
        token_files.unframe([record[:14] + b"X" + record[15:]])


def best_fit_decreasing(lengths, capacity):
    gaps, opened = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        opened += gap == capacity
        if gap - length:
            bisect.insort(gaps, gap - length)
    return opened


@pytest.mark.parametrize("seed", range(12))
def test_sweep_packs_like_best_fit_decreasing(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 64, 257])
    most = draw.choice([capacity - 1, capacity // 2, max(2, capacity // 5)])
    lengths = [draw.randint(1, most) for _ in range(draw.choice([1, 7, 300, 3000]))]
    if seed % 3 == 0:
        lengths += [most] * 500  # a length that many have
    counts = {n: lengths.count(n) for n in set(lengths)}
    claims, opened = packing.sweep(counts, capacity)
    used, taken = {}, {n: [] for n in counts}
    for c in claims:
        for k in range(c.count):
            place = used.setdefault(c.sequence + k // c.each, [])
            place.append((c.offset + k % c.each * c.length, c.length))
            taken[c.length].append(c.rank + k)
    assert all(sorted(r) == list(range(counts[n])) for n, r in taken.items())
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(used) == list(range(opened))
    best = best_fit_decreasing(lengths, capacity)
    assert opened <= best + max(1, best // 50)


def test_pack(docs, odd_rows):
    capacity = 256
    out = packing.pack(docs(odd_rows, ["piece", "length"]).repartition(3), queries.vocabulary(NAMES[0]), capacity, with_ids=True).collect()
    want = []
    for doc, text, _ in odd_rows:
        ids = expected_ids(NAMES[0], text, 0)
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want.append((str(doc), k, at, len(own), zlib.crc32(own), own.tolist()))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in out) == sorted(want)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(sequences) <= best_fit_decreasing([r.length for r in out], capacity)
    assert packing.pack(docs([]), queries.vocabulary(NAMES[0])).count() == 0
