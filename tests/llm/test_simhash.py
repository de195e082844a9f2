import random

import numpy as np
import xxhash

from leadlens.llm import simhash
from tests.llm.conftest import prose


def slow_fingerprint(text):
    import re

    low = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def slow_components(points, radius=2):
    up = list(range(len(points)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(points)):
        for j in range(i):
            if bin(points[i] ^ points[j]).count("1") <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(points))]


def test_fingerprints_match_the_definition(odd_rows):
    texts = [t for _, t, _ in odd_rows] + ["One TWO three", "a", "A b", "É É é", prose(4, 40_000)]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def clustered(seed, n):
    draw = random.Random(seed)
    out = []
    for _ in range(n // 20):
        centre = draw.getrandbits(64)
        for _ in range(20):
            out.append(centre ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(5))))
    return np.unique(np.array([x & (2**64 - 1) for x in out], np.uint64))


def test_tree_loses_no_pair():
    points = clustered(1, 4000)
    nodes = simhash.top_tree(points[::3], 16, 2)
    rows, shard, home = simhash.route(points, nodes, 2)
    assert sorted(rows[home].tolist()) == list(range(len(points)))
    found = set()
    for s in np.unique(shard):
        own = points[rows[shard == s]]
        mine = home[shard == s]
        for a, b in simhash.near_pairs(own[mine], own[~mine], 2):
            found |= {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    want = {(int(points[i]), int(points[j])) for i, j in zip(*np.nonzero(np.triu(close, 1)), strict=True)}
    assert found == want and len(want) > 500


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 300)] + [(-5, 500)]
    out = simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    roots = {r.node: r.root for r in out}
    assert len(out) == len(roots)
    assert {roots[k] for k in range(61)} == {0} and {roots[k] for k in range(100, 300)} == {100} and roots[500] == -5


def test_near_duplicates_against_brute_force(docs, odd_rows):
    base = prose(9, 300).split()
    near = [(200 + k, " ".join(base[:k] + ["x"] + base[k + 1 :]), "s") for k in range(0, 300, 6)]
    rows = odd_rows + near + [(400 + k, prose(50 + k, 30), "s") for k in range(60)]
    out = simhash.near_duplicates(docs(rows, ["fp", "first"]).repartition(4)).collect()
    points = [slow_fingerprint(t) for _, t, _ in rows]
    by_root = {}
    for (doc, _, _), root in zip(rows, slow_components(points), strict=True):
        by_root.setdefault(root, []).append(doc)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in by_root.items()}
    want = [(str(d), f"{p:016x}", least[r]) for (d, _, _), p, r in zip(rows, points, slow_components(points), strict=True)]
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in out) == sorted(want)
    kept = simhash.one_of_each(docs(rows))
    assert kept.count() == len(by_root)
    assert simhash.near_duplicates(docs([])).count() == 0
