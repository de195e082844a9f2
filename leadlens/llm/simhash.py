"""SimHash near-duplicates: fingerprints over 3-word shingles, linked at a Hamming distance of at most ``radius``, found
exactly with vantage-point trees.

A fingerprint is computed inside a task from the whole text.  Equal fingerprints are one point.  A top tree over a
sample of about ``SAMPLE`` points, at most twice as many, deals all points to shards: at a node with vantage v and bound m, points at distance
<= m from v go left, others right.  By the triangle inequality a point to the right can have a partner on the left only if
its own distance is <= m + radius; it then visits the left side too, and inside a subtree a visitor follows each branch
that its bounds leave open.  So every linked pair meets in the shard where one of both is at home.  Inside a shard the
same split goes on until few points are left, which are compared in blocks.

A shard hands on a spanning forest of its links, no pairs; components are joined by alternating large and small stars.

The sample only sets bounds of shards; every point is in a shard, and recall is 1.  Nulls: a null text has no words and
the fingerprint 0, which links like any other; a null doc_id is greater than all others, so that it names a component
only if all ids are null.  Repeated rows have the same fingerprint.  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from leadlens.llm.kit import cut, keep_rows, text_hash

RADIUS = 2
SHINGLE = 3
SEED = 42
SAMPLE = 32_768  # points that set the bounds of shards: 256 kB on the driver
SHARD = 4_096  # points aimed at in a shard
SHARDS = (64, 1_024)  # fewest and most shards; larger ones split further inside their task
BLOCK = 1 << 22  # distances computed at a time


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is set if more than half of the shingles' XXH64 have it."""
    import xxhash

    # bytes.lower and bytes.split know A-Z and the six characters 09-0D and 20 only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    wide = min(shingle, len(words)) - 1
    begin, end = starts[: len(words) - wide].tolist(), stops[wide:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(begin), 16_384):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(begin[k : k + 16_384], end[k : k + 16_384], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(begin), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (the 64 bits as a long)."""
    return docs.select("doc_id", text_hash().alias("text_hash"), _fingerprints("text").alias("fp"))


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int64)


def split(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """Vantage and bound that halve the points roughly and leave few within ``radius`` to the right of the bound."""
    best = None
    for k in range(0, len(points), max(1, len(points) // 6)):
        held = np.bincount(distances(points, points[k]), minlength=65)
        left = np.cumsum(held)
        for m in np.flatnonzero((left > 0.3 * len(points)) & (left < 0.7 * len(points))):
            # work left over: both halves, and the visitors of the left one
            cost = left[m] * (left[m] + held[m + 1 : m + 1 + radius].sum()) + (len(points) - left[m]) ** 2
            if best is None or cost < best[0]:
                best = (cost, points[k], int(m))
    return best and best[1:]


def top_tree(sample: np.ndarray, shards: int, radius: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, bound, left, right) with the root first; a child -k - 1 is shard k."""
    nodes: list[list[int]] = []
    leaves = 0

    def grow(points: np.ndarray, want: int) -> int:
        nonlocal leaves
        cutting = split(points, radius) if want > 1 and len(points) > 16 else None
        if cutting is None:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append([int(cutting[0]), cutting[1], 0, 0])
        near = distances(points, cutting[0]) <= cutting[1]
        nodes[at][2] = grow(points[near], want // 2)
        nodes[at][3] = grow(points[~near], want - want // 2)
        return at

    grow(sample, shards)
    return [tuple(n) for n in nodes]


def route(points: np.ndarray, nodes: list, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each visit: position of the point, shard, whether it is at home there."""
    out: list[tuple[np.ndarray, int, bool]] = []
    if not nodes:
        return np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool)
    todo = [(0, np.arange(len(points)), True)]
    while todo:
        at, rows, home = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            out.append((rows, -at - 1, home))
            continue
        vantage, bound, left, right = nodes[at]
        d = distances(points[rows], np.uint64(vantage))
        if home:
            todo += [(left, rows[d <= bound], True), (right, rows[d > bound], True)]
            todo.append((left, rows[(d > bound) & (d <= bound + radius)], False))
        else:
            todo += [(left, rows[d <= bound + radius], False), (right, rows[d > bound - radius], False)]
    return (
        np.concatenate([r for r, _, _ in out]) if out else np.zeros(0, np.int64),
        np.concatenate([np.full(len(r), s) for r, s, _ in out]) if out else np.zeros(0, np.int64),
        np.concatenate([np.full(len(r), h) for r, _, h in out]) if out else np.zeros(0, bool),
    )


def near_pairs(home: np.ndarray, visit: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within ``radius`` among ``home`` and between ``visit`` and ``home``, in blocks."""
    todo = [(home, visit)]
    while todo:
        home, visit = todo.pop()
        cutting = split(home, radius) if len(home) > 2_048 else None
        if cutting is not None:
            d, e = distances(home, cutting[0]), distances(visit, cutting[0])
            m = cutting[1]
            todo.append((home[d <= m], np.concatenate((home[(d > m) & (d <= m + radius)], visit[e <= m + radius]))))
            todo.append((home[d > m], visit[e > m - radius]))
            continue
        others = np.concatenate((home, visit))
        step = max(1, BLOCK // max(1, len(others)))
        for k in range(0, len(home), step):
            close = np.bitwise_count(home[k : k + step, None] ^ others[None, k:]) <= radius
            i, j = np.nonzero(close)
            apart = j > i  # each pair once, and no point with itself
            yield home[k + i[apart]], others[k + j[apart]]


def spanning(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> dict[int, int]:
    """Point to the smallest point it hangs together with, for the points that are no such smallest one."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    for left, right in pairs:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between points ``points(fp)``, all different, that connect what is linked."""
    spark = points.sparkSession
    total = points.count()
    share = min(2**31, -(-SAMPLE * 2**31 // max(1, total)))  # of the hashes: about SAMPLE points, whatever the partitions
    sample = [r[0] for r in points.where(F.pmod(F.xxhash64("fp"), F.lit(2**31)) < share).sort("fp").limit(2 * SAMPLE).collect()]
    shards = min(SHARDS[1], max(SHARDS[0], -(-total // SHARD)))
    nodes = spark.sparkContext.broadcast(top_tree(np.array(sample, np.int64).view(np.uint64), shards, radius))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["fp"].to_numpy(np.int64)
            rows, shard, home = route(own.view(np.uint64), nodes.value, radius)
            yield pd.DataFrame({"fp": own[rows], "shard": shard.astype(np.int64), "home": home})

    def search(group: pd.DataFrame) -> pd.DataFrame:
        own = group["fp"].to_numpy(np.int64).view(np.uint64)
        home = group["home"].to_numpy(bool)
        found = spanning(near_pairs(own[home], own[~home], radius))
        ends = np.array(list(found.items()), np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})

    dealt = points.select("fp").mapInPandas(deal, "fp long, shard long, home boolean")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of ``edges(a, b)``.

    Alternating large and small stars: every node hangs its greater neighbours on its smallest one, then itself and its
    smaller neighbours, until all edges are stars.  Minima are aggregated before the shuffle, and joins on a node with
    most of the edges can be split, as the other side has one row for a node.
    """
    def star(links: DataFrame, large: bool) -> DataFrame:
        ends = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            ends = ends.union(ends.select("v", "u"))
        else:
            ends = ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = ends.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("own"), F.least("low", "u").alias("low"))
        hung = ends.join(low, F.col("u") == F.col("own"))
        if large:
            return hung.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b")).where("a <> b")
        up = hung.select(F.col("v").alias("a"), F.col("low").alias("b"))
        return up.union(low.select(F.col("own").alias("a"), F.col("low").alias("b"))).where("a <> b").distinct()

    seen = None
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        edges = cut(star(star(edges, True), False))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, fp, fingerprint (16 hex digits), component_id, first (whether
    this row stands for its component)."""
    rows = cut(fingerprints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    points = cut(rows.groupBy("fp").agg(first))
    groups = components(links(points, radius)).withColumnRenamed("node", "fp")
    placed = points.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = placed.groupBy("root").agg(F.min("first").alias("head"))
    named = placed.join(heads, "root").select(F.col("fp").alias("point"), "head")
    same = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    return rows.join(named, rows["fp"] == named["point"]).select(
        "doc_id", "text_hash", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("head.doc_id").alias("component_id"), same.alias("first"),
    )


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with all columns."""
    return keep_rows(docs, near_duplicates(docs, radius).where("first").select("doc_id", "text_hash"))
