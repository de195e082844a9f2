"""Best-fit packing of tokenized documents into sequences of at most ``capacity`` tokens.

Bulk-synchronous best fit:

* the pieces are range-sorted by length, and each gets its rank among the pieces of its length, from partition offsets
  (a length that most pieces have is spread over many tasks);
* pieces of equal length, and sequences with equal gaps, are interchangeable.  A run of such pieces, or of such
  sequences, is one entry of a sorted run table with fewer than ``capacity`` entries at any size of the corpus;
* in a round every run of pieces, from the longest down, sweeps over the successors of its length among the gaps as they
  stood when the round began.  Where runs compete for a gap the longer one, and inside a run the lower rank, comes first;
  a sequence takes the pieces of one length in a round.  Then the gaps are updated, and the next round begins.  A length
  for which no gap is left opens new sequences;
* the tasks match their own pieces against the sweeps' claims by (length, rank) and so know sequence and offset.

No piece goes through the driver: it sees counts by length only.  The claims, intervals of ranks, are bounded by the
capacity as well and are broadcast.

Nulls: a null text has only the end id; a null doc_id is packed like any other.  Repeated rows are packed each.  An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.encode import encoder
from leadlens.llm.kit import cut, ranked, text_hash

CAPACITY = 2048
END = 0
PIECE = "doc_id long, text_hash long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Claim:
    """Pieces of ``length`` with ranks from ``rank`` on, ``count`` of them: ``each`` go to a sequence, from ``sequence``
    on, the first of them at ``offset``."""

    length: int
    rank: int
    count: int
    sequence: int
    each: int
    offset: int


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Claim], int]:
    """Claims for ``counts`` (pieces by length, each shorter than the capacity), and the number of sequences."""
    left = {length: (0, n) for length, n in sorted(counts.items()) if n}  # next rank, pieces left
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: intervals of sequences (first, count)
    claims: list[Claim] = []
    opened = 0
    while left:
        longest = max(left)
        if not gaps or max(gaps) < longest:
            # nothing takes the longest: it opens sequences, and so do all that can't share one
            for length in [n for n in sorted(left, reverse=True) if n == longest or 2 * n > capacity]:
                rank, n = left[length]
                if length != longest and gaps and max(gaps) >= length:
                    break
                each = capacity // length
                new = -(-n // each)
                gaps.setdefault(capacity, []).append((opened, new))
                opened += new
                rest: dict[int, list[tuple[int, int]]] = defaultdict(list)
                _claim(claims, left, gaps, length, capacity, capacity, rest)
                for gap, runs in rest.items():
                    gaps.setdefault(gap, []).extend(runs)
            continue
        order = sorted(gaps)
        updated: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for length in sorted(left, reverse=True):
            while length in left and (at := bisect_left(order, length)) < len(order):
                _claim(claims, left, gaps, length, order[at], capacity, updated)
                if order[at] not in gaps:
                    order.pop(at)
        for gap, runs in updated.items():
            gaps.setdefault(gap, []).extend(runs)
            runs.sort()
    return claims, opened


def _claim(claims, left, gaps, length, gap, capacity, updated) -> None:
    """The run ``length`` takes what it can of the first interval of ``gap``."""
    rank, n = left[length]
    first, count = gaps[gap].pop(0)
    each = gap // length
    taken = min(n, each * count)
    full, rest = divmod(taken, each)
    claims.append(Claim(length, rank, taken, first, each, capacity - gap))
    if full and gap - each * length:
        updated[gap - each * length].append((first, full))
    if rest:
        updated[gap - rest * length].append((first + full, 1))
    used = full + bool(rest)
    if used < count:
        gaps[gap].insert(0, (first + used, count - used))
    if not gaps[gap]:
        del gaps[gap]
    if taken < n:
        left[length] = (rank + taken, n - taken)
    else:
        del left[length]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text, adds the end id, and cuts documents of more than ``capacity`` ids into pieces: doc_id,
    text_hash, piece, start (ids of the document before it), length, ids_crc32 and, if wanted, ids."""

    schema = pa.schema([
        ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else []),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer).ids
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in schema.names}
            for doc, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.append(ids_of(text), end).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    values = (doc, mark, k, at, len(own), zlib.crc32(own), own)
                    for name, value in zip(schema.names, values, strict=False):
                        rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    return source.mapInArrow(encode, PIECE + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row for each piece: its columns from ``pieces``, sequence_id, and offset, its place in the sequence."""
    rows = cut(pieces(docs, tokenizer, capacity, end, with_ids))  # else the range sort's sampling would encode again
    return place(ranked(rows, ["length"], ["doc_id", "piece", "text_hash"], "place"), capacity)


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Packs ``rows(length, place, ...)``, place being the rank among the pieces of equal length."""
    rows = cut(rows)
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    counts.pop(capacity, 0)  # a full piece is a sequence by itself, numbered after the others by its rank
    claims, opened = sweep(counts, capacity)
    table = np.array(
        sorted((c.length, c.rank, c.sequence, c.each, c.offset) for c in claims), np.int64
    ).reshape(-1, 5)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, sequence, each, offset = shared.value.T
        keys = length << 44 | rank
        for batch in batches:
            own, at = (batch.column(n).to_numpy().astype(np.int64) for n in ("length", "place"))
            ids, places = opened + at, np.zeros(len(at), np.int64)
            part = np.flatnonzero(own < capacity)
            own, at = own[part], at[part]
            claim = np.searchsorted(keys, own << 44 | at, "right") - 1
            ahead = at - rank[claim]
            ids[part] = sequence[claim] + ahead // each[claim]
            places[part] = offset[claim] + ahead % each[claim] * own
            kept = [n for n in batch.schema.names if n != "place"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(ids), pa.array(places)], [*kept, "sequence_id", "offset"]
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "place")
    return rows.mapInArrow(match, f"{fields}, sequence_id long, offset long")
