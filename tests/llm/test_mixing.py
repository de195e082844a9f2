import hashlib
import math
import re

import pytest

from leadlens.llm import mixing


def brute(rows, share=1.5):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall("[^\x20\x09-\x0d]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, full = {}, share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        level = (left - sum(2 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for s in order:
        target[s] = 2.0 * sizes[s] if s in full else weight[s] * level
    return sizes, target


def test_targets_and_taken_words(docs, odd_rows):
    rows = odd_rows + [(100 + k, "w " * (1 + k % 40), f"s{1 + k % 3}") for k in range(900)]
    sizes, target = brute(rows)
    out = mixing.mix_copies(docs(rows, ["place", "size"]).repartition(6)).collect()
    assert len(out) == len(rows)
    for source in sizes:
        own = [r for r in out if r.source == source]
        assert own[0].source_size == sizes[source]
        assert own[0].target == pytest.approx(target[source])
        assert abs(sum(r.taken for r in own) - target[source]) <= max(r["size"] for r in own)
        assert all(r.taken <= 2 * r["size"] for r in own)
        # the definition, in one go
        digest = hashlib.md5(f"mix-1|{chr(0) if source is None else source}".encode()).hexdigest()
        u, e = int(digest[:8], 16) / 2**32, (target[source] / sizes[source] if sizes[source] else 0)
        copies = [math.floor(u + (k + 1) * e) - math.floor(u + k * e) for k in range(len(own))]
        assert sum(copies) == sum(r.copies for r in own)


def test_reruns_agree_and_copies_are_rows(docs, odd_rows):
    rows = odd_rows + [(100 + k, f"w{k} " * (1 + k % 7), f"s{1 + k % 3}") for k in range(200)]
    first = mixing.mix_copies(docs(rows)).select("doc_id", "text_hash", "copies")
    again = mixing.mix_copies(docs(rows[::-1]).repartition(9)).select("doc_id", "text_hash", "copies")
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    mixed = mixing.mix(docs(rows, ["mix_id", "copies"]))
    assert mixed.columns[-2:] == ["mix_id", "copies"]
    assert mixed.count() == sum(r.copies for r in first.collect())


def test_empty_and_wordless_tables(docs):
    assert mixing.mix_copies(docs([])).count() == 0
    out = mixing.mix_copies(docs([(1, None, None), (2, " ", "a")])).collect()
    assert [(r["size"], r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 2
