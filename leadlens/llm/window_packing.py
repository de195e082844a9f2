"""Bounded-space online packing of tokenized documents into sequences of at most ``capacity`` tokens.

Every partition keeps a fixed number of open windows.  A piece goes to the window with the least gap that takes it
(best fit); where none does, a window is opened; where all ``WINDOWS`` are open, the fullest one takes the head of the
piece, which fills it, and is emitted.  So a document is cut only where no window takes it whole, and whatever is emitted
is full.  At its end a partition pours its emptiest windows into its fullest ones and keeps one leftover window.

The leftovers are merged by the same packer, ``FAN`` partitions to a group, then ``FAN`` groups, until one is left; no task
sees more than ``FAN`` windows.  What remains then, less than one window, is cut into powers of two, which need no
padding.

State: ``WINDOWS`` windows a task, whatever its input; a task also holds the ids of the document it reads.  Nothing
goes through the driver but the greatest partition number.  The result of a pass is written to the shared folder before
it is used twice, so that a recomputed task cannot number its sequences differently.

Nulls: a null text has only the end id; a null doc_id is packed like any other.  Repeated rows are packed each.  Only
doc_id and text are read, so further columns may have any name.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.encode import encoder
from leadlens.llm.kit import cut, text_hash

CAPACITY = 4096
END = 2
WINDOWS = 64  # open at a time in a task
FAN = 64  # leftovers merged by a task
BATCH = 8_192  # rows handed on at a time

OUT = pa.schema([
    ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("part", pa.int64()), ("ids", pa.binary()),
])
ROW = (
    "doc_id long, text_hash long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "part long, ids binary"
)


class Piece(NamedTuple):
    doc: int | None
    mark: int
    tokens: int  # of the whole document
    start: int
    ids: np.ndarray

    def split(self, at: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:at]), self._replace(start=self.start + at, ids=self.ids[at:])


class Packer:
    """Open windows and their gaps; ``add`` and ``close`` yield the windows that are full, as lists of pieces."""

    def __init__(self, capacity: int = CAPACITY, windows: int = WINDOWS):
        self.capacity, self.windows = capacity, windows
        self.gaps: list[tuple[int, int]] = []  # sorted: gap, window
        self.open: dict[int, list[Piece]] = {}
        self.next = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece.ids) >= self.capacity:
            head, piece = piece.split(self.capacity)
            yield [head]
        while len(piece.ids):
            at = bisect_left(self.gaps, (len(piece.ids), -1))
            if at < len(self.gaps):
                gap, window = self.gaps.pop(at)
                self.open[window].append(piece)
                if gap > len(piece.ids):
                    insort(self.gaps, (gap - len(piece.ids), window))
                else:
                    yield self.open.pop(window)
                return
            if len(self.open) < self.windows:
                self.open[self.next] = [piece]
                insort(self.gaps, (self.capacity - len(piece.ids), self.next))
                self.next += 1
                return
            gap, window = self.gaps.pop(0)  # the fullest
            head, piece = piece.split(gap)
            self.open[window].append(head)
            yield self.open.pop(window)

    def close(self) -> Iterator[list[Piece]]:
        """Pours the emptiest windows into the fullest; what is left open then is one window at most."""
        while len(self.gaps) > 1:
            gap, window = self.gaps[0]
            room, source = self.gaps[-1]
            piece = self.open[source].pop()
            head, rest = piece.split(min(gap, len(piece.ids)))
            self.open[window].append(head)
            if len(rest.ids):
                self.open[source].append(rest)
            if self.open[source]:
                self.gaps[-1] = (room + len(head.ids), source)
            else:
                self.gaps.pop()
                del self.open[source]
            if gap > len(head.ids):
                self.gaps[0] = (gap - len(head.ids), window)
            else:
                self.gaps.pop(0)
                yield self.open.pop(window)

    def leftover(self) -> list[Piece]:
        return next(iter(self.open.values()), [])


def powers(window: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces of a window as sequences whose lengths are powers of two."""
    total = sum(len(p.ids) for p in window)
    waiting = list(reversed(window))
    for size in (1 << k for k in reversed(range(total.bit_length())) if total >> k & 1):
        out, room = [], size
        while room:
            head, rest = waiting.pop().split(room)
            out.append(head)
            room -= len(head.ids)
            if len(rest.ids):
                waiting.append(rest)
        yield out


class _Rows:
    """Rows of emitted windows, numbered from ``first``; rows of the leftover carry their ids and no number."""

    def __init__(self, part: int, first: int):
        self.part, self.number = part, first
        self.columns: list[list] = [[] for _ in OUT]

    def put(self, window: list[Piece], ended: bool = True) -> None:
        offset = 0
        for p in window:
            ids = p.ids.astype("<u4", copy=False)
            values = (
                p.doc, p.mark, p.start, len(ids), zlib.crc32(ids.tobytes()), p.tokens, self.number if ended else None, offset,
                self.part, None if ended else ids.tobytes(),
            )
            for column, value in zip(self.columns, values, strict=True):
                column.append(value)
            offset += len(ids)
        self.number += ended

    def take(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.columns[0]) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, OUT, strict=True)], schema=OUT)
            self.columns = [[] for _ in OUT]


def _number(level: int, part: int) -> int:
    """First sequence of a task: the rounds of merging, the tasks and their sequences keep apart."""
    return level << 56 | part << 32


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, windows: int = WINDOWS, fan: int = FAN) -> DataFrame:
    """One row for each piece: doc_id, text_hash, start (ids of its document before it), length, ids_crc32, doc_tokens,
    sequence_id and offset, its place in the sequence."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids_of, packer, rows = encoder(tokenizer).ids, Packer(capacity, windows), _Rows(part, _number(0, part))
        for batch in batches:
            for doc, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.append(ids_of(text), end).astype("<u4")
                for window in packer.add(Piece(doc, mark, len(ids), 0, ids)):
                    rows.put(window)
                    yield from rows.take(BATCH)
        for window in packer.close():
            rows.put(window)
        rows.put(packer.leftover(), ended=False)
        yield from rows.take()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    filled = cut(source.mapInArrow(fill, ROW))
    ended, level = filled.where("ids IS NULL"), 0
    while (last := filled.where("ids IS NOT NULL").agg(F.max("part")).first()[0]) is not None:
        level += 1
        filled = cut(_merged(filled.where("ids IS NOT NULL"), level, last < fan, capacity, windows, fan))
        ended = ended.union(filled.where("ids IS NULL"))
    return ended.drop("part", "ids")


def _merged(leftovers: DataFrame, level: int, last: bool, capacity: int, windows: int, fan: int) -> DataFrame:
    """Merges the leftovers of ``fan`` parts at a time, longest pieces first; the last merge leaves nothing open."""

    def merge(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py() // fan
        rows, packer = _Rows(part, _number(level, part)), Packer(capacity, windows)
        waiting = [
            (r["part"], r["offset"], Piece(r["doc_id"], r["text_hash"], r["doc_tokens"], r["start"], np.frombuffer(r["ids"], "<u4")))
            for r in table.to_pylist()
        ]
        for *_, piece in sorted(waiting, key=lambda w: (-len(w[2].ids), w[0], w[1])):
            for window in packer.add(piece):
                rows.put(window)
        for window in packer.close():
            rows.put(window)
        if last:
            for window in powers(packer.leftover()):
                rows.put(window)
        else:
            rows.put(packer.leftover(), ended=False)
        return pa.Table.from_batches(list(rows.take()), OUT)

    group = F.floor(F.col("part") / F.lit(fan)).alias("group")
    return leftovers.groupBy(group).applyInArrow(merge, ROW)
