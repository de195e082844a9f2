"""Compression of vectors to codes: product quantisation, its codebooks fitted by Lloyd's rounds over cover trees.

Components become integers, floor(``SCALE`` x), and all arithmetic that decides is in integers, so that neither the
partitions nor the order of sums show in the result.

* A task cuts its vectors into chunks and builds one cover tree for each part position of a chunk.  Centres are inserted
  farthest first; those that are more than 2^l from all earlier ones form level l, and a centre hangs on the nearest one
  of the levels above it, which is at most 2^(l+1) away.  The points of a node lie next to each other, so that
  cumulative sums give the sum of any subtree.  The trees are built once and written to the shared folder.
* A round goes through the trees from their roots.  By the triangle inequality an entry that is more than the diameter of
  a node farther from its centre than the nearest entry is nearest to none of its points; if one entry is left, the whole
  subtree is assigned by its sum and count.  Other nodes descend, and only the points of ambiguous leaves are
  compared with the entries that are left.  Tasks hand on one sum for each entry and component.
* The driver sees sums by entry, no vectors but the first entries; the codebooks are broadcast.  Both have ``entries`` times
  the number of components, at any number of vectors.

Vectors that are null, or have a null or non-finite component, are dropped.  A shorter vector counts as filled up with
zeros to the longest one, and that to a multiple of ``parts``; components beyond +-``HELD`` are held there, so that an
error fits a long up to 8,191 components.  The first entries are those of the smallest vec_ids; null ids come last, and
rows with one id are ordered by their vectors.  Repeated rows count each.  Fewer rows than entries make fewer entries.
Further columns may have any name.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.llm.kit import cut

# Fixed values of the data contract.
SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2

HELD = 1 << 24
CHUNK = 1 << 18  # components in a chunk: 4,096 vectors of 64
LEAF = 32  # points for one centre, on average
HOT = 1_000  # a label with more than one row in so many is joined by broadcast


class Tree:
    """A cover tree over ``points`` (n rows of integers), as arrays.

    ``order`` says which point stands where; node i covers the places ``begin[i]`` to ``end[i]``, its centre is the point
    at place ``centre[i]``, and no point of it is farther than ``radius[i]``.  Nodes stand in preorder; ``skip[i]`` is the
    next node outside of i, and a leaf has ``skip[i] == i + 1``.
    """

    FIELDS = ("order", "points", "begin", "end", "centre", "radius", "skip")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)
        # cumulative sums: the sum of any run of places by one subtraction
        self.sums = np.concatenate((np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points, axis=0, dtype=np.int64)))

    def distances(self, places: np.ndarray | slice, entries: np.ndarray) -> np.ndarray:
        return ((self.points[places].astype(np.int64)[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest entry of each place (ties to the lower index), sums and counts by entry, and how many points were
        compared one by one."""
        n, k = len(self.points), len(entries)
        codes = np.zeros(n, np.int64)
        totals, counts = np.zeros_like(entries), np.zeros(k, np.int64)
        own, first = np.unique(entries, axis=0, return_index=True)  # an equal entry behind another is never used
        first = np.sort(first)
        own = entries[first]
        exact = self.distances(self.centre, own)
        near = np.sqrt(exact.astype(np.float64))
        bound = near.min(axis=1) + 2 * self.radius
        # the margin is far above what a square root or a sum of two can lose: no possible entry is ruled out
        possible = near <= (bound * (1 + 1e-12) + 1e-9)[:, None]
        alone = (possible.sum(axis=1) == 1) | (self.radius == 0)
        best = first[exact.argmin(axis=1)]
        i = compared = 0
        while i < len(alone):
            a, b = self.begin[i], self.end[i]
            if alone[i]:
                codes[a:b] = best[i]
                totals[best[i]] += self.sums[b] - self.sums[a]
                counts[best[i]] += b - a
                i = self.skip[i]
            elif self.skip[i] == i + 1:
                left = first[possible[i]]
                found = left[self.distances(slice(a, b), entries[left]).argmin(axis=1)]
                codes[a:b] = found
                np.add.at(totals, found, self.points[a:b].astype(np.int64))
                counts += np.bincount(found, minlength=k)
                compared += b - a
                i += 1
            else:
                i += 1
        return codes, totals, counts, int(compared)


def centres(points: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Farthest-first centres for each part of ``points`` (parts, n, width): index, parent (number of a centre) and level
    of each, (parts, k), and the nearest centre of each point, (parts, n).  A centre with level -2 repeats another."""
    parts, n, _ = points.shape
    each = np.arange(parts)
    index, parent = np.zeros((parts, most), np.int64), np.zeros((parts, most), np.int64)
    level = np.full((parts, most), -2, np.int64)
    nearest, above = np.zeros((parts, n), np.int64), np.zeros((parts, n), np.int64)
    away = ((points - points[:, :1]) ** 2).sum(axis=2)
    level[:, 0] = now = np.full(parts, 64)
    for k in range(1, most):
        at = away.argmax(axis=1)
        far = away[each, at]
        if not far.any():
            break
        with np.errstate(divide="ignore"):
            # level l: 2^l < distance <= 2^(l+1); distances are squared here
            lies = np.where(far > 0, np.maximum(np.ceil(np.log2(far) / 2) - 1, -1), -2).astype(np.int64)
        changed = lies < now
        above[changed] = nearest[changed]  # the covering of a level by those above it
        now = lies
        index[:, k], parent[:, k], level[:, k] = at, above[each, at], lies
        new = ((points - points[each, at][:, None]) ** 2).sum(axis=2)
        closer = new < away
        nearest[closer] = k
        np.minimum(away, new, out=away)
    return index, parent, level, nearest


def cover_trees(points: np.ndarray) -> list[Tree]:
    """One tree for each part of ``points`` (parts, n, width)."""
    floats = points.astype(np.float64)
    found = centres(floats, max(1, points.shape[1] // LEAF))
    return [_tree(points[p], *(a[p] for a in found)) for p in range(len(points))]


def _tree(points: np.ndarray, index: np.ndarray, parent: np.ndarray, level: np.ndarray, nearest: np.ndarray) -> Tree:
    held = np.argsort(nearest, kind="stable")
    bounds = np.searchsorted(nearest[held], np.arange(len(index) + 1))
    groups: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # of a centre, by level
    for k in range(1, len(index)):
        if level[k] > -2:
            groups[parent[k]][level[k]].append(k)
    order: list[np.ndarray] = []
    nodes: list[list[int]] = []  # begin, end, centre, skip
    placed = 0

    def grow(k: int, levels: list[int]) -> None:
        """The node of centre k with its children on ``levels`` (ascending), the first child being k without the last."""
        nonlocal placed
        at = len(nodes)
        nodes.append([placed, 0, k, 0])
        if levels:
            grow(k, levels[:-1])
            for child in groups[k][levels[-1]]:
                grow(child, sorted(groups[child]) if child in groups else [])
        else:
            order.append(held[bounds[k] : bounds[k + 1]])
            placed += len(order[-1])
        nodes[at][1], nodes[at][3] = placed, len(nodes)

    grow(0, sorted(groups[0]) if 0 in groups else [])
    order = np.concatenate(order)
    begin, end, centre, skip = np.array(nodes, np.int64).T
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    centre = place[index[centre]]
    laid = points[order]
    radius = np.array([
        ((laid[a:b].astype(np.int64) - laid[c]) ** 2).sum(axis=1).max() for a, b, c in zip(begin, end, centre, strict=True)
    ], np.float64)
    radius = np.sqrt(radius)
    return Tree(order=order, points=laid, begin=begin, end=end, centre=centre, radius=radius, skip=skip)


def _stored(trees: list[Tree]) -> bytes:
    file = io.BytesIO()
    np.savez(file, **{f"{name}_{p}": getattr(t, name).astype(np.float64 if name == "radius" else np.int32) for p, t in enumerate(trees) for name in Tree.FIELDS})
    return file.getvalue()


def _loaded(data: bytes, parts: int) -> list[Tree]:
    with np.load(io.BytesIO(data), allow_pickle=False) as file:
        return [Tree(**{name: file[f"{name}_{p}"] for name in Tree.FIELDS}) for p in range(parts)]


def usable(vector: str = "embedding") -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~bad


def integers(column: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """The vectors of an Arrow list column as rows of ``width`` integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    out = np.zeros((len(column), width), np.int32)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.clip(np.floor(flat * scale), -HELD, HELD)
    return out


def by_part(vectors: np.ndarray, parts: int) -> np.ndarray:
    return vectors.reshape(len(vectors), parts, vectors.shape[1] // parts).transpose(1, 0, 2)


def planted(vectors: DataFrame, width: int, parts: int = PARTS) -> DataFrame:
    """The cover trees of ``vectors(vec_id, label, embedding)``: one row for each chunk with its ids and labels."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    rows = max(LEAF, CHUNK // width)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                own = batch.slice(at, rows)
                trees = cover_trees(by_part(integers(own.column("embedding"), width), parts))
                ends = pa.array([0, len(own)], pa.int32())
                ids, labels = (pa.ListArray.from_arrays(ends, own.column(name)) for name in ("vec_id", "label"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([_stored(trees)], pa.binary())], ["vec_ids", "labels", "trees"])

    return vectors.mapInArrow(plant, f"vec_ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, trees binary")


def lloyd_round(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts, entries, width) after one round."""
    shared = chunks.sparkSession.sparkContext.broadcast(books)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        totals, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for data in batch.column("trees"):
                for p, tree in enumerate(_loaded(data.as_py(), len(books))):
                    _, total, count, _ = tree.assign(books[p])
                    totals[p] += total
                    counts[p] += count
        part, entry = np.nonzero(counts)
        width = books.shape[2]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(v, width)) for v in (part, entry)]
            + [pa.array(np.tile(np.arange(width), len(part))), pa.array(totals[part, entry].ravel()), pa.array(np.repeat(counts[part, entry], width))],
            ["part", "entry", "place", "total", "n"],
        )

    sums = chunks.mapInArrow(gather, "part long, entry long, place long, total long, n long")
    books = books.copy()
    # at most one row for each component of an entry
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def fitted(vectors: DataFrame, parts: int, entries: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """The chunks of all vectors, and their codebooks."""
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    start = integers(first.column(0).combine_chunks(), width) if len(first) else np.zeros((0, width), np.int32)
    books = by_part(start.astype(np.int64), parts).copy()
    chunks = cut(planted(vectors, width, parts))
    for _ in range(rounds):
        if len(start):
            books = lloyd_round(chunks, books)
    return chunks, books


def encoded(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error (sum of the squared distances)."""
    shared = chunks.sparkSession.sparkContext.broadcast(books)
    kinds = {f.name: f.dataType.elementType for f in chunks.schema if f.name != "trees"}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        digits = np.array([f"{k:02x}" for k in range(256)])
        for batch in batches:
            for k in range(len(batch)):
                ids, labels = (batch.column(name).slice(k, 1).flatten() for name in ("vec_ids", "labels"))
                codes, errors = np.zeros((len(ids), len(books)), np.int64), np.zeros(len(ids), np.int64)
                for p, tree in enumerate(_loaded(batch.column("trees")[k].as_py(), len(books))):
                    found = tree.assign(books[p])[0]
                    codes[tree.order, p] = found
                    errors[tree.order] += ((tree.points - books[p][found]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array(["".join(c) for c in digits[codes].tolist()], pa.string()), pa.array(errors)],
                    ["vec_id", "label", "code", "error"],
                )

    return chunks.mapInArrow(
        encode, f"vec_id {kinds['vec_ids'].simpleString()}, label {kinds['labels'].simpleString()}, code string, error long"
    )


def with_label_errors(rows: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels (nulls together; held at the greatest long).  A label with
    more than one row in ``HOT`` is joined by broadcast, of at most ``HOT`` labels; the others by a shuffle, where none
    has more than its share."""
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    labels = cut(rows.groupBy("label").agg(total.alias("label_error"), F.count(F.lit(1)).alias("rows_")).withColumnRenamed("label", "own_"))
    many = (labels.agg(F.sum("rows_")).first()[0] or 0) / HOT
    hot, cold = (labels.where(F.col("rows_") > many), labels.where(F.col("rows_") <= many))
    same = F.col("label").eqNullSafe(F.col("own_"))
    joined = rows.join(F.broadcast(hot), same).union(rows.join(F.broadcast(hot), same, "left_anti").join(cold, same))
    return joined.drop("own_", "rows_")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row for each usable row of ``vectors(vec_id, embedding, label)``: vec_id, label, code, error, label_error and
    codebooks_sha256 (of all components of the final entries, by part, entry and position)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    kept = vectors.select("vec_id", "label", "embedding").where(usable())
    chunks, books = fitted(kept, parts, entries, rounds)
    rows = cut(encoded(chunks, books))
    return with_label_errors(rows).withColumn("codebooks_sha256", F.lit(digest(books)))
