"""Link expansion over several hops."""

import random

import pytest

from leadlens.operators import candidates as C


def walk(edges, seeds, hops):
    blocked = {"x.com", "github.com"}
    reached = {s: 0 for s in seeds if s not in blocked}
    frontier, hop = set(reached), 0
    while frontier and (hops is None or hop < hops):
        hop += 1
        frontier = {t for s, t in edges if s in frontier and t not in reached and t not in blocked}
        reached.update(dict.fromkeys(frontier, hop))
    return reached


@pytest.mark.parametrize("seed, hops", [(1, None), (2, None), (3, 2), (4, 0)])
def test_against_a_plain_walk(spark, seed, hops):
    draw = random.Random(seed)
    names = [f"d{k}.ai" for k in range(30)] + ["x.com", "github.com"]
    edges = [(draw.choice(names), draw.choice(names)) for _ in range(45)] + [(f"chain{k}.io", f"chain{k + 1}.io") for k in range(6)]
    seeds = ["d1.ai", "d1.ai", "x.com", "chain0.io", "alone.dev"]
    frame = spark.createDataFrame(edges, "domain string, target string")
    got = C.expand_links(frame, spark.createDataFrame([(s,) for s in seeds], "domain string"), hops).collect()
    assert {r["domain"]: r["hop"] for r in got} == walk(edges, seeds, hops) and len({r["domain"] for r in got}) == len(got)


def test_nothing_to_follow(spark):
    none = spark.createDataFrame([], "domain string, target string")
    assert C.expand_links(none, none.select("domain")).count() == 0
