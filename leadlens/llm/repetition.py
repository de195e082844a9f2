"""Quality rules on repetition, from suffix arrays over words and the intervals of their common prefixes.

* The suffixes of all texts of a batch are sorted together, text first, by prefix doubling: only suffixes whose order is
  still open are sorted again, so ordinary prose costs a few rounds.
* The common prefix of neighbours comes from comparing ``LEAST`` words at once; for those that share them, in the order of
  the text, where a prefix is at most one word shorter than the one before.
* A run of neighbours that share a prefix is an interval, and intervals nest.  The string of an interval can't be extended to
  the right; if different words (or the beginning of the text) stand before its places, it can't be extended to the left
  either and is a maximal repeat.  From each place the longest maximal repeat of its intervals is marked, and the marked
  spans are united.

Base rules: fewer than ``FEWEST`` words, or more than ``MOST_REPEATED`` per cent of the words in repeated windows of
``LEAST`` words.  Verdict of the method: the spans cover at most ``COVERED`` of the word characters, and no repeat is
longer than ``LONGEST`` words.

Nulls: a null text has no words and fails the base rules, as an empty one.  Long texts are batches of their own; memory
follows the longest text, some 120 bytes for each of its words.  Repeated rows get equal results.  Only doc_id and text are
read, so further columns may have any name.  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 5
FEWEST = 10
MOST_REPEATED = 20
COVERED = 0.25
LONGEST = 100
SYMBOLS = "#*$%&|<>"  # fixed value
WORDS = 250_000  # words sorted together, more only for one long text
COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_maximal long, longest_repeat long, covered_fraction double"
)


def suffix_array(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, which end with their text; texts stay one after the other.

    ``words`` are numbers of words, texts one after the other; ``ends`` is, for each position, the end of its text.
    """
    n = len(words)
    key = ends.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable").astype(np.int32)

    def heads(keys: np.ndarray) -> np.ndarray:
        """First index of the run of equal keys that each is in."""
        new = np.empty(len(keys), bool)
        new[:1], new[1:] = True, keys[1:] != keys[:-1]
        return np.flatnonzero(new).astype(np.int32)[np.cumsum(new, dtype=np.int32) - 1]

    def shared(first: np.ndarray) -> np.ndarray:
        """Those in runs of two and more."""
        same = first[1:] == first[:-1]
        return np.concatenate(([False], same)) | np.concatenate((same, [False]))

    first = heads(key[order])
    rank = np.empty(n + 1, np.int32)
    rank[order], rank[n] = first, -1
    step = 1
    slots = np.flatnonzero(shared(first)).astype(np.int32) if n else np.zeros(0, np.int32)
    while len(slots):
        at = order[slots]
        ahead = at + step
        key = rank[at].astype(np.int64) * (n + 1) + np.where(ahead < ends[at], rank[np.minimum(ahead, n)] + 1, 0)
        by = np.argsort(key, kind="stable").astype(np.int32)
        at, key = at[by], key[by]
        order[slots] = at
        first = heads(key)
        rank[at] = slots[first]
        slots, step = slots[shared(first)], 2 * step
    return order


def common_prefixes(words: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the suffix array the words that its suffix shares with the one before it."""
    n = len(order)
    prefix = np.zeros(n, np.int32)
    if n < 2:
        return prefix
    left, right = order[:-1], order[1:]
    same = ends[left] == ends[right]
    for d in range(LEAST):
        a, b = left + d, right + d
        same = same & (a < ends[left]) & (b < ends[right]) & (words[np.minimum(a, n - 1)] == words[np.minimum(b, n - 1)])
        prefix[1:] += same
    places = np.flatnonzero(same).astype(np.int32) + 1  # the neighbours go on beyond LEAST words
    places = places[np.argsort(order[places], kind="stable")]
    at, found = memoryview(np.ascontiguousarray(words)), np.empty(len(places), np.int32)
    out, begins, others = memoryview(found), memoryview(order[places]), memoryview(order[places - 1])
    stops, length, before = memoryview(ends), LEAST, -2
    for k in range(len(places)):
        i, j = begins[k], others[k]
        length = max(length - 1, LEAST) if i == before + 1 else LEAST
        room = stops[i] - max(i, j)
        while length < room and at[i + length] == at[j + length]:
            length += 1
        out[k], before = length, i
    prefix[places] = found
    return prefix


class Intervals:
    """The intervals of common prefixes of ``LEAST`` words and more: ``first`` and ``last`` place in the suffix array,
    ``length`` of the prefix, ``parent`` (the next larger interval, or -1), and ``own``, the interval in which a place
    and the one before it share their prefix (-1 without one)."""

    def __init__(self, prefix: np.ndarray):
        entries = np.flatnonzero(prefix >= LEAST).astype(np.int32)
        # every interval is opened by one entry
        self.first, self.last, self.length, self.parent = (np.full(len(entries), -1, np.int32) for _ in range(4))
        self.own = np.full(len(prefix) + 1, -1, np.int32)
        first, last, length, parent, own = map(memoryview, (self.first, self.last, self.length, self.parent, self.own))
        values, made, stack, before = memoryview(prefix), 0, [], -2
        for i in memoryview(entries):
            if i != before + 1:  # a new run: the intervals of the last one end
                self._close(stack, last, parent, before)
            now, begin = values[i], i - 1
            while stack and length[stack[-1]] > now:
                top = stack.pop()
                last[top], begin = i - 1, first[top]
                parent[top] = stack[-1] if stack and length[stack[-1]] >= now else made
            if not stack or length[stack[-1]] < now:
                first[made], length[made] = begin, now
                stack.append(made)
                made += 1
            own[i] = stack[-1]
            before = i
        self._close(stack, last, parent, before)
        self.first, self.last, self.length, self.parent = (v[:made] for v in (self.first, self.last, self.length, self.parent))

    @staticmethod
    def _close(stack: list[int], last, parent, place: int) -> None:
        while stack:
            top = stack.pop()
            last[top] = place
            parent[top] = stack[-1] if stack else -1


def maximal_repeats(words: np.ndarray, ends: np.ndarray, order: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of the longest maximal repeat that begins there, and for each text position how many
    maximal repeats have their first place (in the order of suffixes) there."""
    n = len(order)
    longest, counted = np.zeros(n, np.int32), np.zeros(n, np.int32)
    tree = Intervals(prefix)
    if not len(tree.first):
        return longest, counted
    begins = np.concatenate(([True], ends[1:] != ends[:-1]))  # of texts
    before = np.where(begins, -1, np.concatenate(([-1], words[:-1])))[order]
    differs = np.concatenate(([False], (before[1:] != before[:-1]) | (before[1:] < 0)))
    changes = np.cumsum(differs, dtype=np.int32)
    maximal = changes[tree.last] > changes[tree.first]
    np.add.at(counted, order[tree.first[maximal]], 1)
    # the nearest maximal interval around each, by jumps over parents
    up = np.where(maximal, np.arange(len(maximal), dtype=np.int32), tree.parent)
    while True:
        further = np.where((up >= 0) & ~maximal[up], up[up], up)
        if (further == up).all():
            break
        up = further
    reach = np.where(up >= 0, tree.length[up], 0)
    longer = np.concatenate((prefix[1:], [0])) > prefix
    deepest = np.where(longer, tree.own[1 : n + 1], tree.own[:n])
    held = deepest >= 0
    longest[order[held]] = reach[deepest[held]]
    return longest, counted


def greatest(order: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """For each position the length of the longest string that begins there and occurs elsewhere in the same text."""
    out = np.zeros(len(order), np.int32)
    out[order] = np.maximum(prefix, np.concatenate((prefix[1:], [0]))[: len(prefix)])
    return out


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    order = suffix_array(words, ends)
    return greatest(order, common_prefixes(words, ends, order))


def measure(texts: list[str | None], docs: list) -> dict[str, list]:
    """The columns of ``COLUMNS`` for a batch of whole texts."""
    ids: dict[bytes, int] = {}
    own_ids = []
    for text in texts:
        # bytes.split knows exactly the six characters of white space; one text's words at a time
        own = (text or "").encode("utf-8", "surrogatepass").split()
        own_ids.append(np.fromiter((ids.setdefault(w, len(ids)) for w in own), np.int32, len(own)))
        del own
    counts = np.fromiter(map(len, own_ids), np.int64, len(own_ids))
    flat = np.concatenate(own_ids) if own_ids else np.zeros(0, np.int32)
    stops = np.cumsum(counts)
    ends = np.repeat(stops, counts).astype(np.int32)
    size_of = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in ids), np.int32, len(ids))
    sizes = size_of[flat] if len(ids) else np.zeros(0, np.int32)
    order = suffix_array(flat, ends)
    prefix = common_prefixes(flat, ends, order)
    longest = greatest(order, prefix)
    marked, maximal = maximal_repeats(flat, ends, order, prefix)
    place = np.arange(len(flat))
    covered = np.maximum.accumulate(np.where(marked > 0, place + marked, 0)) > place if len(flat) else marked > 0
    out: dict[str, list] = {c.split()[0]: [] for c in COLUMNS.split(", ")}
    for k, text in enumerate(texts):
        own = slice(int(stops[k] - counts[k]), int(stops[k]))
        text, n, chars = text or "", int(counts[k]), int(sizes[own].sum())
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\f")]
        repeated = int(covered[own].sum())
        failed = n < FEWEST or 100 * repeated > MOST_REPEATED * n
        most = int(longest[own].max()) if n else 0
        fraction = float(sizes[own][covered[own]].sum() / chars) if chars else 0.0
        values = (
            docs[k], n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, failed,
            not failed and fraction <= COVERED and most <= LONGEST, int(maximal[own].sum()), most, fraction,
        )
        for name, value in zip(out, values, strict=True):
            out[name].append(value)
    return out


def quality(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: ``COLUMNS``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text)
                held += len(text or "") // 6 + 1
                if held > WORDS:
                    yield table(texts, ids)
                    ids, texts, held = [], [], 0
            if ids:
                yield table(texts, ids)

    def table(texts: list, ids: list) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        fields = [(c.split()[0], kinds[c.split()[1]]) for c in COLUMNS.split(", ")]
        return pa.RecordBatch.from_pydict(measure(texts, ids), pa.schema(fields))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, COLUMNS)


def good(docs: DataFrame) -> DataFrame:
    """doc_id of the documents that are kept."""
    return quality(docs).where("kept").select("doc_id")
