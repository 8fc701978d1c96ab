"""Language by the nearest centroid of TF-IDF n-gram vectors.

Byte trigrams of the lower-cased text are hashed to ``DIMENSIONS``; counts are damped,
weighted by inverse document frequency over all training documents and normalised. Every
language has up to ``CENTROIDS`` centroids, found by spherical k-means on at most
``PER_LANGUAGE`` of its ids (hash order, one text each, ``TRAINING_BYTES`` in all). The nearest centroid by cosine decides. A text
farther from every centroid than nearly all of the sample of its language is marked as
rejected; it keeps the nearest language.

A null text or one without a letter is ``und`` with score 0 and rejected. Without training
documents every text is ``und``. Equal texts get equal results; equal cosines go to the
first language in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import held_out, lower_table, mapped, one_each, read, row_slices, text_bytes

DIMENSIONS, CENTROIDS, PER_LANGUAGE = 4096, 4, 300
KEPT = 0.999  # share of a language's sample inside its distance
SLICE = 512 << 10
FOLDS, FOLD = 4, 2


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Trigram counts per row. Runs of other bytes than letters count as one gap; trigrams across rows do not count."""
    rows = len(bounds) - 1
    out = np.zeros((rows, DIMENSIONS), np.float32)
    letter = _LETTERS[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(bounds))[keep]
    if len(row) < 3:
        return out
    table = lower_table(True)
    table[~_LETTERS] = table[0x20]
    h = table[data[keep]]
    h = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ h[2:]
    h = ((h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - 12)).astype(np.int64)
    inside = row[:-2] == row[2:]
    return np.bincount((row[:-2] * np.int64(DIMENSIONS) + h)[inside], minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS).astype(np.float32)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _frequencies(documents: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents and documents per trigram, over all of them."""
    def task(batches):
        n, df = 0, np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            data, bounds = text_bytes(batch.column(0))
            for _, _, part, inner in row_slices(data, bounds, SLICE):
                df += (_counts(part, inner) > 0).sum(0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*range(-1, DIMENSIONS)], pa.int32()), pa.array([n, *df], pa.int64())], ["i", "n"])
    rows = documents.select("text").mapInArrow(task, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMENSIONS + 1)
    for r in rows:
        df[r.i] = r.n  # -1, the number of documents, is the last entry
    return int(df[-1]), df[:-1]


def _cluster(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(1)
        centres = np.stack([x[nearest == j].mean(0) if (nearest == j).any() else centres[j] for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


class Languages:
    def __init__(self, idf: np.ndarray, samples: dict[str, list[str]]):
        self.idf = idf.astype(np.float32)
        self.names, centres, self.limits = sorted(samples), [], []
        for name in self.names:
            data, bounds = text_bytes(pa.array(samples[name], pa.string()))
            x = np.concatenate([_vectors(_counts(p, b), self.idf) for _, _, p, b in row_slices(data, bounds, SLICE)])
            own = _cluster(x, CENTROIDS)
            centres.append(own)
            self.limits.append(float(np.quantile((x @ own.T).max(1), 1 - KEPT)))
        self.owner = np.repeat(np.arange(len(centres)), [len(c) for c in centres])
        self.centres = np.concatenate(centres)

    def nearest(self, data, bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine, and whether it is below the language's limit."""
        cosine = _vectors(_counts(data, bounds), self.idf) @ self.centres.T
        best = cosine.argmax(1)
        value = cosine[np.arange(len(best)), best]
        owner = self.owner[best]
        return owner, value, value < np.array(self.limits)[owner]


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE, folds: int = FOLDS, fold: int = FOLD) -> Languages | None:
    known = documents.filter(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), folds, fold)).select("doc_id", "text", "lang")
    # The first ids of each language in one pass: every partition keeps its own first ones before rows are dealt out.
    rank = F.dense_rank().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    first = known.select("lang", "doc_id").withColumn("_r", rank).filter(F.col("_r") <= per_language)
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")  # all null ids count as one
    chosen = [tuple(r) for r in first.select("lang", named).distinct().collect()]
    if not chosen:
        return None
    small = documents.sparkSession.createDataFrame(chosen, "lang string, _id string")
    texts: dict[str, list[str]] = {}
    for r in sorted(one_each(known.select("lang", named, "text").join(F.broadcast(small), ["lang", "_id"]), ["lang", "_id"]), key=lambda r: (r.lang, r._id)):
        texts.setdefault(r.lang, []).append(r.text)
    n, df = _frequencies(known)
    return Languages(np.log((n + 1) / (df + 1)) + 0.1, texts)


def identified(documents: DataFrame, languages: Languages | None) -> DataFrame:
    """Input columns and ``_lang``, ``_score`` and ``_rejected``."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if languages is None:
        return documents.withColumns({"_lang": F.lit("und"), "_score": F.lit(0.0), "_rejected": F.lit(True)})
    rows = documents.select(F.struct(*documents.columns).alias("_row"), "text", letters.alias("_letters"))
    sent = documents.sparkSession.sparkContext.broadcast(languages)

    def run(batch):
        data, bounds = text_bytes(batch.column(1))
        model = sent.value
        parts = [model.nearest(part, inner) for _, _, part, inner in row_slices(data, bounds, SLICE)] or [(np.zeros(0, int), np.zeros(0), np.zeros(0, bool))]
        owner, value, rejected = (np.concatenate(x) for x in zip(*parts))
        letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        names = [model.names[o] if ok else "und" for o, ok in zip(owner, letters)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(letters, np.clip(value, 0, 1), 0).astype(np.float64)),
                                          pa.array(rejected | ~letters)], ["_row", "_lang", "_score", "_rejected"])

    kind = rows.schema["_row"].dataType.simpleString()
    return mapped(rows, run, f"_row {kind}, _lang string, _score double, _rejected boolean").select(
        *[F.col("_row")[c].alias(c) for c in documents.columns], "_lang", "_score", "_rejected")


def op9(spark, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    languages = fit(documents)
    return identified(documents.select("doc_id", "text"), languages).select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"),
        F.col("_rejected").alias("rejected"))
