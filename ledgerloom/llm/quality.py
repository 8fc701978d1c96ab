"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into blocks of 256 bytes; two neighbouring blocks form a chunk, so chunks
overlap by half and cover the whole text. Filters over six bytes are applied at every
byte, max-pooled over each chunk, squashed, and the chunk vectors averaged; a logistic
unit turns the average into the probability that the text is good. Filters, biases and
output weights are learned by Adam on at most ``PER_CLASS`` labelled texts of each class,
chosen by hash order, each step on some random chunks of a text.

Null and empty texts have one chunk of padding and get a score like any other. Without any
labelled rows every score is 0.5. Equal texts get equal scores. Inputs other than the text
play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import held_out, mapped, read, row_slices, text_bytes, training_rows

BLOCK, WIDTH, FILTERS = 256, 6, 16
PER_CLASS = 1200  # bound on the labelled texts of a class used for the fit
EPOCHS, BATCH, CHUNKS = 8, 32, 4
FOLDS, FOLD = 3, 1


class ByteNetwork:
    def __init__(self, filters: int = FILTERS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, 0.3, (WIDTH, 256, filters)).astype(np.float32)
        self.w[:, 0] = 0  # padding says nothing
        self.b = np.zeros(filters, np.float32)
        self.v = rng.normal(0, 0.3, filters).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def responses(self, x: np.ndarray, n: int) -> np.ndarray:
        """Filter values at the first ``n`` positions of the last axis."""
        out = self.w[0][x[..., :n]]
        for j in range(1, WIDTH):
            out += self.w[j][x[..., j: j + n]]
        return out

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability per row; work is done in pieces of blocks, so a long text needs no more memory."""
        lengths = np.diff(bounds)
        blocks = np.maximum(1, -(-(lengths + WIDTH - 1) // BLOCK))
        first = np.concatenate([[0], np.cumsum(blocks)])
        padded = np.zeros(int(first[-1]) * BLOCK + WIDTH, np.uint8)
        for i in np.flatnonzero(lengths):
            at = first[i] * BLOCK
            padded[at: at + lengths[i]] = data[bounds[i]: bounds[i + 1]]
        pooled = np.empty((int(first[-1]), len(self.b)), np.float32)
        ends = np.zeros(len(pooled), bool)
        ends[first[1:] - 1] = True
        step = 512
        for k in range(0, len(pooled), step):
            n = min(step, len(pooled) - k) * BLOCK
            values = self.responses(padded[k * BLOCK: k * BLOCK + n + WIDTH], n)
            values = values.reshape(-1, BLOCK, len(self.b))
            # A row's last positions hold padding only, but the filters there reach into the next row.
            values[ends[k: k + step], BLOCK - WIDTH + 1:] = 0
            pooled[k: k + step] = values.max(1)
        chunk = pooled.copy()
        chunk[:-1] = np.maximum(pooled[:-1], pooled[1:])
        last = first[1:] - 1
        chunk[last] = pooled[last]
        chunk = np.tanh(chunk + self.b)
        # The last block alone counts only where it is the whole text.
        chunk[last[blocks > 1]] = 0
        mean = np.add.reduceat(chunk, first[:-1], axis=0) / np.maximum(1, blocks - 1)[:, None]
        return 1 / (1 + np.exp(-(mean @ self.v + self.c[0]).astype(np.float64)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        size = 2 * BLOCK
        texts = [np.frombuffer(t + bytes(size + WIDTH), np.uint8) for t in texts]
        params = [self.w, self.b, self.v, self.c]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
        steps = 0
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
                x = np.empty((len(batch), CHUNKS, size + WIDTH), np.uint8)
                for r, i in enumerate(batch):
                    ends = max(1, len(texts[i]) - 2 * size - WIDTH + 1)
                    for q, at in enumerate(rng.integers(0, ends, CHUNKS)):
                        x[r, q] = texts[i][at: at + size + WIDTH]
                        if rng.random() < 0.1:  # texts of a few words occur as well
                            x[r, q, rng.integers(4, 100):] = 0
                values = self.responses(x, size)
                at = values.argmax(2)
                pooled = np.take_along_axis(values, at[:, :, None], 2)[:, :, 0]
                act = np.tanh(pooled + self.b)
                mean = act.mean(1)
                p = 1 / (1 + np.exp(-(mean @ self.v + self.c[0])))
                d = ((p - labels[batch]) / len(batch)).astype(np.float32)
                d_act = d[:, None, None] * self.v / CHUNKS * (1 - act ** 2)
                g_w = np.zeros_like(self.w)
                filters = np.broadcast_to(np.arange(len(self.b)), at.shape)
                for j in range(WIDTH):
                    seen = np.take_along_axis(x, (at + j).reshape(len(batch), CHUNKS, -1), 2)
                    np.add.at(g_w[j], (seen, filters), d_act)
                g_w[:, 0] = 0
                grads = [g_w, d_act.sum((0, 1)), mean.T @ d, d.sum(keepdims=True)]
                steps += 1
                for p_, g, (m, s) in zip(params, grads, moments):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p_ -= (0.02 * (m / (1 - 0.9 ** steps)) / (np.sqrt(s / (1 - 0.999 ** steps)) + 1e-8)).astype(np.float32)
        return self


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = FOLDS, fold: int = FOLD) -> ByteNetwork | None:
    rows = training_rows(documents, labels, "quality", folds, fold, per_class)
    if not rows:
        return None
    return ByteNetwork().fit([t.encode() for t, _ in rows], np.array([y for _, y in rows], np.float32))


def scored(documents: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """Input columns and ``_score``. The network has a fixed size and goes along with the task."""
    if network is None:
        return documents.withColumn("_score", F.lit(0.5))
    rows = documents.select(F.struct(*documents.columns).alias("_row"), "text")
    sent = documents.sparkSession.sparkContext.broadcast(network)

    def run(batch):
        data, bounds = text_bytes(batch.column(1))
        parts = [sent.value.score(part, inner) for _, _, part, inner in row_slices(data, bounds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else [], pa.float64())], ["_row", "_score"])

    kind = rows.schema["_row"].dataType.simpleString()
    return mapped(rows, run, f"_row {kind}, _score double").select(*[F.col("_row")[c].alias(c) for c in documents.columns], "_score")


def op1(spark, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    network = fit(documents, read(spark, sf_dir, "labels"))
    return scored(documents, network).select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), F.col("_score").alias("score"),
                                             (F.col("_score") >= 0.5).cast("int").alias("predicted"))
