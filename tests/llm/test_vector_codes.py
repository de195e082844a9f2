import hashlib
import math
import random

import numpy as np
import pytest

from leadlens.llm import vector_codes

KIND = "vec_id long, embedding array<float>, label int, code string, own_ string"


def frame(spark, rows, kind=KIND):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], kind)


def plain_lloyd(rows, parts=16, entries=64, rounds=2, scale=256, held=1 << 24):
    """By loops over Python integers."""
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    longest = max(len(v) for _, v, _ in kept)
    width = max(1, -(-longest // parts))
    ints = []
    for i, v, l in kept:
        x = [max(-held, min(held, math.floor(np.float64(np.float32(c)) * scale))) for c in v]
        x += [0] * (width * parts - len(x))
        ints.append([x[p * width : (p + 1) * width] for p in range(parts)])
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [np.float32(c) for c in kept[k][1]]))
    books = [[list(ints[k][p]) for k in order[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for x in ints:
                members[nearest(p, x[p])[1]].append(x[p])
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else e for e, m in zip(books[p], members)]
    out = []
    for (i, _, l), x in zip(kept, ints):
        found = [nearest(p, x[p]) for p in range(parts)]
        out.append([i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), l])
    sums = {}
    for *_, error, l in out:
        sums[l] = sums.get(l, 0) + error
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, code, error, sums[l], sha) for i, code, error, l in out], books


def held(spark, rows, **options):
    got = vector_codes.vector_codes(frame(spark, rows).repartition(3), **options).collect()
    got = [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got]
    want, _ = plain_lloyd(rows, **options)
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def vectors(n, dims, seed=0, spread=0.3, labels=4):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(k, [draw.gauss(c, spread) for c in draw.choice(centres)], draw.choice([None, *range(labels)])) for k in draw.sample(range(10 * n), n)]


@pytest.mark.parametrize("n, dims, spread", [(300, 64, 0.3), (300, 32, 0.01), (200, 16, 2.0), (40, 48, 0.3)])
def test_against_plain_loops(spark, n, dims, spread):
    assert len(held(spark, vectors(n, dims, spread=spread))) == n


def test_odd_rows(spark):
    rows = vectors(150, 64, 3)
    rows += [
        (5, None, 1), (6, [None] * 64, 1), (7, [float("nan")] + [0.0] * 63, 2), (8, [float("-inf")] * 64, 2), (None, [0.5] * 64, None),
        (9, [0.0] * 64, None), (9, [0.0] * 64, None), (9, [1.0] * 64, 3), (10, [0.1] * 20, 1), (11, [], 1), (12, [3e38] * 64, 2),
        (13, [-1e-7] * 64, 2), (None, None, None),
    ]
    held(spark, rows)
    held(spark, rows, parts=8, entries=5, rounds=3)
    held(spark, [(k, [0.25] * 16, None) for k in range(100)])  # all alike
    held(spark, [(k, [float(k % 3)] * 16, k % 2) for k in range(100)], entries=64)  # equal entries, ties
    held(spark, [(1, [0.5] * 7, 1)])


def test_empty(spark):
    assert held(spark, []) == []
    assert held(spark, [(1, None, 1)]) == []
    with pytest.raises(ValueError):
        vector_codes.vector_codes(frame(spark, []), entries=257)


def test_other_types(spark):
    rows = vectors(90, 16, 4)
    plain = {r[0]: r[1] for r in held(spark, rows)}
    other = frame(spark, [(str(i).zfill(9), [float(np.float32(x)) for x in v], str(l)) for i, v, l in rows],
                  "vec_id string, embedding array<double>, label string, code string, own_ string")
    assert {int(r.vec_id): r.code for r in vector_codes.vector_codes(other).collect()} == plain


def test_labels_with_and_without_broadcast(spark, monkeypatch):
    rows = [(k, [float(k % 7)] * 16, k % 50 if k % 3 else 999) for k in range(400)]
    monkeypatch.setattr(vector_codes, "HOT", 4)
    held(spark, rows)


def drawn(n, dims, seed, spread):
    draw = np.random.default_rng(seed)
    return np.floor(256 * (draw.normal(size=(6, dims))[draw.integers(0, 6, n)] + spread * draw.normal(size=(n, dims)))).astype(np.int32)


@pytest.mark.parametrize("n, spread", [(1, 0.1), (31, 0.1), (700, 0.02), (3000, 0.5)])
def test_tree_is_a_cover_tree(n, spread):
    points = drawn(n, 8, n, spread)
    points[n // 2 :: 3] = points[0]
    index, parent, level, nearest = vector_codes.centres(points.astype(float)[None], max(1, n // 32))
    used = np.flatnonzero(level[0] > -2)
    at = points[index[0]].astype(float)
    for k in used[1:]:
        to = np.sqrt(((at[:k] - at[k]) ** 2).sum(axis=1))
        assert to.min() > 2.0 ** level[0, k]  # separation
        p = parent[0, k]
        assert level[0, p] > level[0, k] and to[p] <= 2.0 ** (level[0, k] + 1)  # covering, by a level above
        assert to[p] == to[[j for j in used if level[0, j] > level[0, k] and j < k]].min()
    (tree,) = vector_codes.cover_trees(points[None])
    assert sorted(tree.order.tolist()) == list(range(n)) and (tree.points == points[tree.order]).all()
    assert (tree.begin[0], tree.end[0], tree.skip[0]) == (0, n, len(tree.begin))
    for a, b, c, r, skip, i in zip(tree.begin, tree.end, tree.centre, tree.radius, tree.skip, range(n)):
        own = tree.points[a:b].astype(float)
        assert r == np.sqrt(((own - tree.points[c]) ** 2).sum(axis=1)).max()
        children, j = [], i + 1
        while j < skip:
            children.append((tree.begin[j], tree.end[j]))
            j = tree.skip[j]
        if children:  # the children tile the node
            assert children[0][0] == a and children[-1][1] == b
            assert all(x[1] == y[0] for x, y in zip(children, children[1:]))
    assert (tree.sums[-1] == points.sum(axis=0)).all()


@pytest.mark.parametrize("n, spread, entries", [(3000, 0.01, 6), (3000, 0.5, 64), (500, 0.02, 1)])
def test_subtrees_are_assigned_whole(n, spread, entries):
    points = drawn(n, 4, 2, spread)
    books = points[:entries].astype(np.int64)
    (tree,) = vector_codes.cover_trees(points[None])
    codes, totals, counts, compared = tree.assign(books)
    want = ((tree.points[:, None, :].astype(np.int64) - books[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (codes == want).all() and (counts == np.bincount(want, minlength=entries)).all()
    assert all((totals[j] == tree.points[want == j].sum(axis=0)).all() for j in range(entries))
    assert compared < n if spread < 0.1 else compared <= n


def test_chunks_do_not_show(spark, monkeypatch):
    rows = vectors(300, 32, 9)
    whole = held(spark, rows)
    monkeypatch.setattr(vector_codes, "CHUNK", 32 * 40)
    assert sorted(held(spark, rows), key=str) == sorted(whole, key=str)
