"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary texts, share the lowest order: the
number of different words a word follows, counted over both classes, and a uniform part for
words never seen. Pairs are counted once per word before them and words once per pair. The
same is done over stems, the first bytes of every word, so an inflected or compounded form
that no labelled text has still shares the counts of its relatives. A class's word probability takes an absolute discount off its counts and
gives what it saves to that shared distribution; its bigram probability does the same with
the word probability. An expression that is rare in both classes so gets nearly the same
probability from both.

A text is compared in overlapping windows of ``WINDOW`` words: the difference of the two
log-likelihoods divided by the words of the window. The largest difference and the one of
the whole text, by words and by stems, are mapped to a probability by a logistic unit, fitted on a part of the
sample that the counts leave out. At most ``PER_CLASS`` toxic and ``OTHERS``
times as many ordinary labelled texts are used.

Null, empty and word-less texts have no evidence: their differences are 0. Without labelled
rows of both classes every score is 0. Equal texts get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ALNUM, held_out, mapped, mix64, read, row_slices, text_bytes, training_rows, word_hashes

WINDOW = 4
PER_CLASS, OTHERS = 1500, 3  # bounds of the sample: toxic texts, and ordinary ones per toxic one
# Taken off counts of 1, 2, ... and of the last and above: an expression seen a few times only says nothing of its class.
DISCOUNTS = (0.0, 1.0, 2.0, 3.0, 4.0)
STEMS = (None, 5)  # bytes of a word that a model reads: whole words, and stems
FIT_SLICE = 1 << 19  # bytes of the sample counted at a time, which bounds the driver's memory
MERGE_ROWS = 400_000  # rows of slices that are put together at a time
FOLDS, FOLD = 5, 0
_START = np.uint64(0x5851F42D4C957F2D)


def _bigrams(words) -> tuple[np.ndarray, np.ndarray]:
    """Previous word (or the start mark) and pair hash of every word."""
    before = np.empty_like(words.hashes)
    if len(before):
        before[1:] = words.hashes[:-1]
        starts = words.first[:-1]
        before[starts[starts < len(before)]] = _START
    return before, mix64(before * np.uint64(3) + words.hashes)


def _slices(texts: list[str]):
    for _, _, part, inner in row_slices(*text_bytes(pa.array(texts, pa.large_string())), FIT_SLICE):
        yield part, inner


def _distinct(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns of the first row of each key, sorted by key; the parts are emptied column by column."""
    def column(i):
        whole = np.concatenate([p[i] for p in parts])
        for p in parts:
            p[i] = None
        return whole

    key, once = np.unique(column(0), return_index=True)
    return [key, *[column(i)[once] for i in range(1, 4)]]


def _pairs(texts: list[str], stem: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of some texts, the number of different words before each, its last and its first word."""
    parts: list[list[np.ndarray]] = []
    rows = 0
    for data, bounds in _slices(texts):
        words = word_hashes(data, bounds, ALNUM, True, stem)
        before, both = _bigrams(words)
        older = np.empty_like(before)
        if len(before):
            older[1:] = before[:-1]
            starts = words.first[:-1]
            older[starts[starts < len(before)]] = _START
        parts.append(_distinct([[mix64(older * np.uint64(5) + both), both, words.hashes, before]]))
        rows += len(parts[-1][0])
        if rows > MERGE_ROWS:
            # Expressions repeat: what is kept grows with the distinct ones.
            parts = [_distinct(parts)]
            rows = 0
    if not parts:
        return tuple(np.zeros(0, np.uint64) for _ in range(4))
    _, both, last, first = _distinct(parts)
    pairs, at, count = np.unique(both, return_index=True, return_counts=True)
    return pairs, count, last[at], first[at]


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


class KneserNey:
    """Log ratios of the toxic to the ordinary model, as sorted tables."""

    def __init__(self, toxic: list[str], ordinary: list[str], stem: int | None = None, discounts: tuple[float, ...] = DISCOUNTS):
        self.stem = stem

        def off(c):
            return np.array(discounts)[np.minimum(c, len(discounts) - 1).astype(np.int64)]

        # Every order counts different continuations: a pair once per word before it, a word
        # once per pair. A passage that is copied many times counts like one.
        counts = [_pairs(texts, stem) for texts in (toxic, ordinary)]
        # Shared backoff: of how many different words is this one a follower, in either class.
        self.pairs, at = np.unique(np.concatenate([c[0] for c in counts]), return_index=True)
        self.words, last, shared = np.unique(np.concatenate([c[2] for c in counts])[at], return_inverse=True, return_counts=True)
        self.contexts, first = np.unique(np.concatenate([c[3] for c in counts])[at], return_inverse=True)
        v, size = len(self.words), max(1, len(self.pairs))
        shared = np.append(shared - 0.75, 0) / size + 0.75 * max(1, v) / size / (v + 1)  # the last one: any unknown word
        word_p, backoff, pair_p = [], [], []
        while counts:
            own, seen, hashes, _ = counts.pop(0)
            n = max(1, len(own))
            c = np.append(np.bincount(np.searchsorted(self.words, hashes), minlength=v), 0)
            p = (c - off(c)) / n + off(c).sum() / n * shared if len(own) else shared
            pair_count = np.zeros(len(self.pairs), np.int64)
            pair_count[np.searchsorted(self.pairs, own)] = seen
            context_count = np.bincount(first, weights=pair_count, minlength=len(self.contexts))
            saved = np.bincount(first, weights=off(pair_count), minlength=len(self.contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                rest = np.where(context_count > 0, saved / context_count, 1.0)
                here = np.where(context_count[first] > 0, (pair_count - off(pair_count)) / context_count[first], 0)
            word_p.append(np.log(p))
            backoff.append(np.log(rest))
            pair_p.append(np.log(here + rest[first] * p[last]))
        self.word_ratio = (word_p[0] - word_p[1]).astype(np.float32)
        self.backoff_ratio = (backoff[0] - backoff[1]).astype(np.float32)
        self.pair_ratio = (pair_p[0] - pair_p[1]).astype(np.float32)

    def ratios(self, words) -> np.ndarray:
        """Log-likelihood difference of every word given the one before."""
        if not len(words.hashes):
            return np.zeros(0, np.float32)
        before, both = _bigrams(words)
        at, known = _find(self.words, words.hashes)
        out = self.word_ratio[np.where(known, at, len(self.words))]
        # A pair can only be known where its word is.
        rows = np.flatnonzero(known)
        at, seen = _find(self.pairs, both[rows])
        out[rows[seen]] = self.pair_ratio[at[seen]]
        backed = np.ones(len(out), bool)
        backed[rows[seen]] = False
        rows = np.flatnonzero(backed)
        at, seen = _find(self.contexts, before[rows])
        out[rows[seen]] += self.backoff_ratio[at[seen]]
        return out

    def differences(self, data: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """Per text: largest difference of a window, and difference of the whole, each per word."""
        words = word_hashes(data, bounds, ALNUM, True, self.stem)
        ratios = self.ratios(words).astype(np.float64)
        n = np.diff(words.first)
        sums = np.concatenate([[0], np.cumsum(ratios)])
        out = np.zeros((len(n), 2))
        some = np.flatnonzero(n)
        if not len(some):
            return out
        out[some, 1] = (sums[words.first[some + 1]] - sums[words.first[some]]) / n[some]
        # Windows start at every word and end with the text.
        row_end = np.repeat(words.first[1:], n)
        start = np.arange(len(ratios))
        end = np.minimum(start + window, row_end)
        value = (sums[end] - sums[start]) / window
        out[some, 0] = np.maximum.reduceat(value, words.first[some])
        return out


class Scorer:
    def __init__(self, rows: list[tuple[str, int]]):
        count_rows = [r for i, r in enumerate(rows) if i % 4]
        fit_rows = [r for i, r in enumerate(rows) if i % 4 == 0] or rows
        toxic, ordinary = [t for t, y in count_rows if y], [t for t, y in count_rows if not y]
        self.models = [KneserNey(toxic, ordinary, stem) for stem in STEMS]
        x = np.concatenate([self._features(*part) for part in _slices([t for t, _ in fit_rows])])
        y = np.array([y for _, y in fit_rows], np.float64)
        self.weights = np.zeros(x.shape[1])
        for _ in range(50):  # Newton steps of a ridge logistic regression
            p = 1 / (1 + np.exp(-x @ self.weights))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
            self.weights -= np.linalg.solve(h, x.T @ (p - y) + 0.05 * self.weights)

    def _features(self, data, bounds) -> np.ndarray:
        return np.column_stack([*[m.differences(data, bounds) for m in self.models], np.ones(len(bounds) - 1)])

    def score(self, data, bounds) -> np.ndarray:
        return 1 / (1 + np.exp(-self._features(data, bounds) @ self.weights))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = FOLDS, fold: int = FOLD) -> Scorer | None:
    rows = training_rows(documents, labels, "toxic", folds, fold, per_class, OTHERS)
    if len({y for _, y in rows}) < 2:
        return None
    return Scorer(rows)


def scored(documents: DataFrame, scorer: Scorer | None) -> DataFrame:
    """Input columns and ``_score``. The tables are bounded by the sample's bound."""
    if scorer is None:
        return documents.withColumn("_score", F.lit(0.0))
    rows = documents.select(F.struct(*documents.columns).alias("_row"), "text")
    sent = documents.sparkSession.sparkContext.broadcast(scorer)

    def run(batch):
        data, bounds = text_bytes(batch.column(1))
        parts = [sent.value.score(part, inner) for _, _, part, inner in row_slices(data, bounds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else [], pa.float64())], ["_row", "_score"])

    kind = rows.schema["_row"].dataType.simpleString()
    return mapped(rows, run, f"_row {kind}, _score double").select(*[F.col("_row")[c].alias(c) for c in documents.columns], "_score")


def op2(spark, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = fit(documents, read(spark, sf_dir, "labels"))
    return scored(documents, scorer).select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), F.col("_score").alias("score"),
                                            (F.col("_score") >= 0.5).cast("int").alias("predicted"))
