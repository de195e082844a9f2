"""Toxicity: a convolutional text classifier trained here, in NumPy.

A word is the sum of four embeddings: under two independent hashes, so that one collision does not turn a word into
another, and under hashes of its first letters, fewer and more, so that forms of a stem share what is learned.  Filters
of several widths run over the whole text and are max-pooled; a logistic unit reads the pooled values.

Training takes at most ``FIT_ROWS`` labelled rows, half of each class as far as there are, in hash order; it is the only
bounded part.  A fifth of them is held back: on it each language gets a threshold, the rows of the others counting
``OTHERS`` times, and scores are moved (as log-odds) so that the language's threshold becomes ``ACCEPT``.  The language of a text is itself read from its words by a small model
fitted on the same rows; a score uses the text and nothing else.

Scoring remembers what each word adds to each filter, for at most ``REMEMBER`` words a worker, so that a text costs one
look-up for each word and a few additions; long texts go by blocks.

Nulls: a null or empty text has no words and gets the score of a text in which no filter fires; a null label is not used.
Repeated rows get equal scores.  Without usable rows of both classes every score is 0.  Empty tables: empty results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 6_000
ACCEPT = 0.7
WIDTHS = (1, 2, 3)
FILTERS = 16
SIZE = 8  # of an embedding
BUCKETS = 1 << 16  # for each hash
STEMS = (4, 7)  # bytes of the third and the fourth hash
HASHES = 2 + len(STEMS)
EPOCHS = 8
BATCH = 32
RATE = 0.05
BLOCK = 1 << 14  # words scored at a time
REMEMBER = 100_000  # words: some 40 MB a worker
SEED = 7
OTHERS = 0.1  # weight of the rows of other languages in a language's threshold
CLEAN = 2.0  # weight of a rejected clean row against a missed toxic one
LANGUAGE_WORDS = 200  # frequent words kept for each language
_WORD = re.compile(rb"[0-9A-Za-z_\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))


def buckets(text: str | None) -> np.ndarray:
    """``HASHES`` rows of bucket numbers, one column for each word of the whole text."""
    return hashed(words_of(text))


def hashed(words: list[bytes]) -> np.ndarray:
    hashes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    mixed = (hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    stems = [np.fromiter((zlib.crc32(w[:n]) for w in words), np.uint32, len(words)) for n in STEMS]
    return np.stack([(h % BUCKETS).astype(np.int32) for h in (hashes, mixed, *stems)])


@dataclass
class Model:
    embed: np.ndarray  # (HASHES, BUCKETS, SIZE)
    filters: list[np.ndarray]  # for each width: (width, SIZE, FILTERS)
    bias: np.ndarray  # for each pooled value
    weights: np.ndarray
    constant: float
    languages: np.ndarray  # (BUCKETS, languages): log-likelihood ratios by first hash; all zero elsewhere
    thresholds: np.ndarray  # for each language, then for texts of none

    @cached_property
    def mixed(self) -> np.ndarray:
        """The filters as one matrix: a column for each width, place in the filter, and filter."""
        return np.concatenate([w[j] for w in self.filters for j in range(len(w))], axis=1).astype(np.float32)

    @cached_property
    def memory(self) -> Memory:
        return Memory(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("mixed", "memory")}  # a worker makes its own

    def responses(self, ids: np.ndarray) -> np.ndarray:
        """What each word adds to each filter at each of its places."""
        return sum(self.embed[h][ids[h]] for h in range(HASHES)) @ self.mixed

    def pool(self, best: np.ndarray, rows: np.ndarray) -> None:
        """Raises ``best`` to the maximum of every filter over the ``responses`` of consecutive words."""
        at = 0
        for k, width in enumerate(WIDTHS):
            n, own = len(rows) - width + 1, slice(k * FILTERS, (k + 1) * FILTERS)
            if n > 0:
                total = rows[:n, at : at + FILTERS]
                for j in range(1, width):
                    total = total + rows[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
                np.maximum(best[own], total.max(axis=0) + self.bias[own], out=best[own])
            at += width * FILTERS

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        """Maximum of every filter over the text; 0 where none fires."""
        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        for at in range(0, ids.shape[1], BLOCK):
            self.pool(best, self.responses(ids[:, at : at + BLOCK + max(WIDTHS) - 1]))
        return best

    def raw(self, ids: np.ndarray) -> float:
        return float(self.pooled(ids) @ self.weights + self.constant)

    def language(self, ids: np.ndarray) -> int:
        return self.named(self.languages[ids[0]].sum(axis=0) if ids.shape[1] else np.zeros(self.languages.shape[1]))

    def named(self, seen: np.ndarray) -> int:
        """The language with the greatest sum; one more than all of them without any evidence."""
        return int(seen.argmax()) if len(seen) and seen.any() else len(seen)

    def score(self, text: str | None) -> float:
        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        seen = np.zeros(self.languages.shape[1])
        words = words_of(text)
        for at in range(0, len(words), BLOCK):
            rows, heads = self.memory.rows(words[at : at + BLOCK + max(WIDTHS) - 1])
            self.pool(best, rows)
            seen += self.languages[heads[:BLOCK]].sum(axis=0)
        odds = float(best @ self.weights + self.constant) - self.thresholds[self.named(seen)] + _odds(ACCEPT)
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


class Memory:
    """What a worker remembers of words: their responses and their first hash.  When it is full it begins anew, so that what
    it holds never shows in a score."""

    def __init__(self, model: Model):
        self.model, self.places = model, {}
        self.responses = np.zeros((1_024, model.mixed.shape[1]), np.float32)
        self.heads = np.zeros(1_024, np.int32)

    def rows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = list(map(self.places.get, words))
        if None in at:
            if len(self.places) + len(new := [*dict.fromkeys(w for w, k in zip(words, at, strict=True) if k is None)]) > REMEMBER:
                self.places.clear()
                new = [*dict.fromkeys(words)]
            self._learn(new)
            at = list(map(self.places.__getitem__, words))
        at = np.array(at, np.int64)
        return self.responses[at], self.heads[at]

    def _learn(self, words: list[bytes]) -> None:
        begin = len(self.places)
        end = begin + len(words)
        while end > len(self.heads):
            self.responses = np.concatenate((self.responses, np.zeros_like(self.responses)))
            self.heads = np.concatenate((self.heads, np.zeros_like(self.heads)))
        ids = hashed(words)
        self.responses[begin:end], self.heads[begin:end] = self.model.responses(ids), ids[0]
        self.places.update(zip(words, range(begin, end), strict=True))


def _odds(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _calibrated(odds: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> float:
    """The threshold with the fewest mistakes by weight, clean rows counting ``CLEAN`` times; in the middle of its gap."""
    order = np.argsort(odds)
    odds, toxic, weights = odds[order], toxic[order], weights[order]
    lost = np.concatenate(([0], np.cumsum(toxic * weights)))  # toxic rows below
    kept = np.concatenate(([0], np.cumsum(~toxic * weights)))
    cost = lost + CLEAN * (kept[-1] - kept)
    at = int(np.flatnonzero(cost <= cost.min() + 1e-9)[-1])
    low = odds[at - 1] if at else odds[0] - 1
    high = odds[at] if at < len(odds) else odds[-1] + 1
    return float((low + high) / 2)


def train(texts: list[str | None], toxic: list[int], langs: list[str | None]) -> Model | None:
    """Fits the classifier, the language reader and the thresholds."""
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return None
    ids = [buckets(t) for t in texts]
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(ids))
    held, used = order[: len(ids) // 5], order[len(ids) // 5 :]
    if not y[used].any() or y[used].all():
        held, used = order[:0], order
    pools = len(WIDTHS) * FILTERS
    embed = np.zeros((HASHES, BUCKETS, SIZE), np.float32)
    filters = [rng.normal(0, 0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias, weights, constant = np.full(pools, 0.01, np.float32), rng.normal(0, 0.5, pools).astype(np.float32), np.float32(0)
    sums = [np.full_like(x, 1e-4) for x in (embed, *filters, bias, weights)]  # squared gradients, for the rates

    def step(value: np.ndarray, total: np.ndarray, grad: np.ndarray, rows=...) -> None:
        total[rows] += grad**2
        value[rows] -= RATE * grad / np.sqrt(total[rows])

    share = y[used].mean()
    for _ in range(EPOCHS):
        used = rng.permutation(used)
        for at in range(0, len(used), BATCH):
            batch = used[at : at + BATCH]
            pooled, places = np.zeros((len(batch), pools), np.float32), np.zeros((len(batch), pools), np.int64)
            for r, doc in enumerate(batch):
                own = ids[doc]
                if not own.shape[1]:
                    continue
                vectors = sum(embed[h][own[h]] for h in range(HASHES))
                for k, width in enumerate(WIDTHS):
                    n = len(vectors) - width + 1
                    if n < 1:
                        continue
                    total = vectors[:n] @ filters[k][0]
                    for j in range(1, width):
                        total += vectors[j : j + n] @ filters[k][j]
                    cols = slice(k * FILTERS, (k + 1) * FILTERS)
                    best = total.argmax(axis=0)
                    places[r, cols] = best
                    pooled[r, cols] = np.maximum(total[best, np.arange(FILTERS)] + bias[cols], 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ weights + constant, -30, 30)))
            error = (p - y[batch]) * np.where(y[batch], 0.5 / share, 0.5 / (1 - share)) / len(batch)
            back = error[:, None] * weights[None, :] * (pooled > 0)
            step(weights, sums[-1], pooled.T @ error)
            constant -= np.float32(RATE * error.sum())
            moved: list[tuple[np.ndarray, np.ndarray]] = []
            for k, width in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                r, f = np.nonzero(back[:, cols])
                if not len(r):
                    continue
                g, at_word = back[:, cols][r, f], places[:, cols][r, f]
                grad = np.zeros_like(filters[k])
                for j in range(width):
                    found = np.stack([ids[batch[a]][:, b + j] for a, b in zip(r, at_word, strict=True)])
                    vectors = sum(embed[h][found[:, h]] for h in range(HASHES))
                    by_filter = np.zeros((FILTERS, SIZE), np.float32)
                    np.add.at(by_filter, f, g[:, None] * vectors)
                    grad[j] = by_filter.T
                    moved.append((found, g[:, None] * filters[k][j].T[f]))
                step(filters[k], sums[1 + k], grad)
            step(bias, sums[-2], back.sum(axis=0))
            if moved:
                found = np.concatenate([m[0] for m in moved])
                grads = np.concatenate([m[1] for m in moved])
                for side in range(HASHES):
                    rows, place = np.unique(found[:, side], return_inverse=True)
                    grad = np.zeros((len(rows), SIZE), np.float32)
                    np.add.at(grad, place, grads)
                    step(embed[side], sums[0][side], grad, rows)
    model = Model(embed, filters, bias, weights, float(constant), *_languages([ids[i] for i in used], [langs[i] for i in used]))
    judged = held if len(held) and y[held].any() and not y[held].all() else used
    odds = np.array([model.raw(ids[i]) for i in judged])
    named = np.array([model.language(ids[i]) for i in judged])
    for k in range(len(model.thresholds)):
        model.thresholds[k] = _calibrated(odds, y[judged], np.where(named == k, 1.0, OTHERS))
    return model


def _languages(ids: list[np.ndarray], langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios of the most frequent words of each language, and room for a threshold each."""
    counts: dict[str, Counter] = {}
    for own, lang in zip(ids, langs, strict=True):
        if lang is not None:
            counts.setdefault(lang, Counter()).update(own[0].tolist())
    names = sorted(counts)
    table = np.zeros((BUCKETS, len(names)), np.float32)
    words = sorted({w for c in counts.values() for w, _ in c.most_common(LANGUAGE_WORDS)})
    for k, name in enumerate(names):
        total = sum(counts[name].values()) + len(words)
        table[words, k] = [np.log((counts[name][w] + 1) / total) for w in words]
    table[words] -= table[words].mean(axis=1, keepdims=True) if names else 0
    return table, np.zeros(len(names) + 1)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """Trains on at most ``rows`` labelled documents outside the held-out third.

    The labels are cut to the bound before they meet the texts, so that the join's small side is bounded and the texts
    are not shuffled.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    def some(toxic: int) -> DataFrame:
        of_class = usable.where((F.col("toxic") == 1) == F.lit(bool(toxic)))
        return of_class.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)

    chosen = F.broadcast(some(1).union(some(0)).withColumnRenamed("doc_id", "fit_id"))
    source = docs.select("doc_id", "text", "lang") if "lang" in docs.columns else docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    found = source.join(chosen, F.col("doc_id") == F.col("fit_id")).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.max(F.struct("text", "lang")).alias("row")
    )
    taken = found.select("doc_id", "toxic", "row.text", "row.lang").toPandas().sort_values("doc_id")
    return train(taken["text"].tolist(), taken["toxic"].tolist(), taken["lang"].tolist())


def scorer(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS):
    """A column function text -> score."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([0.0 if model is None else model.score(t) for t in texts], dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of ``ACCEPT``) for each row of ``docs``."""
    score = scorer(docs, labels, rows)
    return docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= ACCEPT).cast("int")
    )


def acceptable(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The documents that are not rejected, with all columns."""
    return docs.where(scorer(docs, labels, rows)("text") < ACCEPT)
