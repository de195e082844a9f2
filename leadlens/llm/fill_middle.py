"""Fill-in-the-middle: a document is cut at two line ends and its middle moved to the end, behind sentinels.

One ``fullmatch`` of ``(unit)*`` by the regex library keeps every repetition of the group, a unit being a line with its
end; ``match.ends(1)`` then says how many units there are and where both cuts lie, without a loop over lines.  The
library keeps some four million repetitions at most, so a text of more than ``STRETCH`` code points is matched in
stretches that end at a line end; the units are the same.

The draws come from a digest of the doc_id, so that reruns and repeated rows agree.  A text that is empty or contains a
sentinel stays plain, and so ``restored`` gives back the exact text in every case.

Memory: a task holds the texts of an Arrow batch, the ends of the lines of one of them, and about ``BATCH`` code points
of output.  Nulls: a null text is empty; a null doc_id draws from the seed alone.  Repeated rows come out each.  Only
doc_id and text are read, so further columns may have any name.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.llm.kit import text_hash

# Fixed values of the data contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
RATE = 100  # of 100 documents, those that are rearranged
SUFFIX_FIRST = 50  # of 100 of these, those that begin with the suffix

UNITS = regex.compile(r"([^\n]*\n|[^\n]+)*")
STRETCH = 1_000_000  # code points matched at a time
BATCH = 1 << 24  # code points handed on at a time

OUT = pa.schema([
    ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
    ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()),
])


def unit_ends(text: str) -> np.ndarray:
    """Where each unit of the text ends, in code points."""
    found, at = [], 0
    while at < len(text):
        stop = text.find("\n", at + STRETCH - 1) + 1 if len(text) - at > STRETCH else 0
        found.append(UNITS.fullmatch(text, at, stop or len(text)).ends(1))
        at = stop or len(text)
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def draws(seed: int = SEED, doc_id: str = "doc_id") -> list[Column]:
    """Four numbers below 2^32 for each document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def rearranged(text: str, h: tuple[int, int, int, int], rate: int, suffix_first: int) -> tuple:
    """n, form, prefix_chars, middle_chars, output."""
    ends = unit_ends(text)
    n = len(ends)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, second))
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, text_hash, n (units), form (plain, psm or spm),
    prefix_chars, middle_chars (null if plain) and output."""

    def rearrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, mark, *h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((doc, mark, *rearranged(text or "", tuple(h), rate, suffix_first)))
                held += len(rows[-1][-1])
                if held >= BATCH:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), *draws(seed), "text")
    return source.mapInArrow(
        rearrange, "doc_id long, text_hash long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, OUT, strict=True)], schema=OUT)


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text, from output and form alone.  No sentinel occurs in a text that was rearranged, and none can arise
    where a text meets one, so each is found once."""
    text = F.col(output)
    before, last = F.substring_index(text, MIDDLE, 1), F.substring_index(text, MIDDLE, -1)
    psm = F.substring_index(before, PREFIX, -1)
    spm = F.substring_index(before, SUFFIX, -1)
    return (
        F.when(F.col(form) == "psm", F.concat(F.substring_index(psm, SUFFIX, 1), last, F.substring_index(psm, SUFFIX, -1)))
        .when(F.col(form) == "spm", F.concat(F.substring_index(spm, PREFIX, -1), last, F.substring_index(spm, PREFIX, 1)))
        .otherwise(text)
    )
