"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

Tokens are lower-cased words and one end per text. Counts of all training documents come
from the key exchange of ``exchange``: a chunk sends its distinct tokens with their counts, a
range of hashes adds them up and answers every chunk. The base score is the smoothed unigram
log10 probability.

The model writes P(word | context) = P(class | context) * P(word | class). The most frequent
tokens are classes of their own, others share a class by their last letters, and a word
without training count is the one member of the last class, whose weight is the share of
words seen once. P(word | class) is the word's share of the class's counts. P(class |
context) is a softmax over three hashed features: the word before, the two words before
and the second word before alone (skip). Its weights are learned in rounds: every task goes
over its part of the training documents with AdaGrad steps on sparse batches (first on the
even positions, then on the odd ones, so every training token takes part), the parts' weights
are averaged per feature in Spark, by how often a part has seen the feature, in two levels, and
the next round starts from the average.

Null text is empty: one token, the end. With no training document all counts are 0, N and V
are 0, base and score are those of a uniform single type. Equal texts get equal scores.
"""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import exchange
from ledgerloom.llm.common import cut, held_out, mix64, read, row_slices, text_bytes, word_hashes

TOP, SUFFIX = 15, 16
CLASSES = TOP + SUFFIX + 1
UNKNOWN = CLASSES - 1
BUCKETS, TABLES = 4096, 3
ROUNDS, BATCH, RATE = 2, 4096, 0.5
SPLIT_BYTES = 128 << 20  # text of one training task, about
BLOCK = 512  # features averaged together
FOLDS, FOLD = 5, 1
_END = np.uint64(0x1F3D5B79A2C4E680)
_FEATURES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Tokens:
    """Tokens of some texts: hash, suffix class, row bounds, and features of the context."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        words = word_hashes(data, bounds, lower=True)
        rows = len(bounds) - 1
        n = len(words.hashes)
        place = np.arange(n) + np.repeat(np.arange(rows), np.diff(words.first))
        self.bounds = words.first + np.arange(rows + 1)
        self.ends = self.bounds[1:] - 1
        self.hashes = np.full(n + rows, _END)
        self.hashes[place] = words.hashes
        self.suffix = np.zeros(n + rows, np.int64)
        tail = np.zeros(n, np.uint64)
        for back in (1, 2, 3):
            at = words.ends - back
            inside = at >= words.starts
            byte = data[np.where(inside, at, 0)] if n else np.zeros(0, np.uint8)
            byte = np.where((byte >= 0x41) & (byte <= 0x5A), byte + 32, byte)
            tail = tail * np.uint64(257) + np.where(inside, byte, 0).astype(np.uint64)
        self.suffix[place] = (mix64(tail) % np.uint64(SUFFIX)).astype(np.int64)

    def features(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Three feature rows per token, or for the tokens ``at`` only."""
        one, two = np.full_like(self.hashes, _END), np.full_like(self.hashes, _END)
        one[1:], two[2:] = self.hashes[:-1], self.hashes[:-2]
        starts = self.bounds[:-1]
        one[starts], two[starts] = _END, _END
        second = starts + 1
        two[second[second < self.bounds[1:]]] = _END
        one, two = one[at], two[at]
        keys = (one * _FEATURES[0], (one * _FEATURES[1]) ^ mix64(two), two * _FEATURES[2])
        return np.stack([(mix64(k) % np.uint64(BUCKETS)).astype(np.int64) + i * BUCKETS for i, k in enumerate(keys)])


class Statistics:
    """Bounded totals of the training counts."""

    def __init__(self, parts: list[dict]):
        self.n = sum(p["n"] for p in parts)
        self.v = sum(p["v"] for p in parts)
        once = sum(p["once"] for p in parts)
        mass = np.sum([p["mass"] for p in parts], axis=0) if parts else np.zeros(SUFFIX)
        top = sorted((t for p in parts for t in p["top"]), key=lambda t: (-t[1], t[0]))[:TOP]
        order = sorted(range(len(top)), key=lambda i: top[i][0])
        self.top = np.array([top[i][0] for i in order], np.uint64)
        weights = np.zeros(CLASSES)
        weights[: len(top)] = [top[i][1] for i in order]
        for _, count, suffix in top:
            mass[suffix] -= count
        weights[TOP: TOP + SUFFIX] = mass
        self.mass = weights.copy()
        weights[UNKNOWN] = max(once, 0.5)
        self.prior = np.log(np.maximum(weights, 1e-6) / weights.sum())

    def classes(self, tokens: Tokens) -> np.ndarray:
        out = TOP + tokens.suffix
        if len(self.top):
            at = np.searchsorted(self.top, tokens.hashes)
            at[at == len(self.top)] = 0
            out = np.where(self.top[at] == tokens.hashes, at, out)
        return out


def _log_classes(weights: np.ndarray, prior: np.ndarray, features: np.ndarray) -> np.ndarray:
    z = weights.take(features[0], 0)
    z += weights.take(features[1], 0)
    z += weights.take(features[2], 0)
    z = z + prior
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def _steps(weights, squares, seen, prior, features, classes) -> None:
    """AdaGrad steps over sparse batches, in place."""
    for a in range(0, len(classes), BATCH):
        f, y = features[:, a: a + BATCH], classes[a: a + BATCH]
        g = np.exp(_log_classes(weights, prior, f))
        g[np.arange(len(y)), y] -= 1
        g[:, UNKNOWN] = 0  # no training word is unknown; its weight stays the prior
        for rows in f:
            order = np.argsort(rows.astype(np.int16), kind="stable")  # short keys are sorted by radix
            sorted_rows = rows[order]
            at = np.flatnonzero(np.diff(sorted_rows, prepend=-1))
            own = sorted_rows[at]
            total = np.add.reduceat(g.take(order, 0), at, axis=0)
            seen[own] += np.diff(np.append(at, len(order)))
            squares[own] += total * total
            weights[own] -= RATE * total / np.sqrt(squares[own] + 4)


def _train_round(documents: DataFrame, statistics: Statistics, weights: np.ndarray, turn: int, rounds: int, fan: int) -> np.ndarray:
    """Weights after every training position of this turn; ``fan`` groups of tasks are averaged first."""
    sent = documents.sparkSession.sparkContext.broadcast((statistics, weights))

    def task(batches):
        statistics, start = sent.value
        weights, squares, seen = start.copy(), np.zeros_like(start), np.zeros(len(start), np.float32)
        prior = statistics.prior.astype(np.float32)
        for batch in batches:
            data, bounds = text_bytes(batch.column(0))
            for _, _, part, inner in row_slices(data, bounds, 1 << 20):
                tokens = Tokens(part, inner)
                at = np.arange(turn, len(tokens.hashes), rounds)
                _steps(weights, squares, seen, prior, tokens.features(at), statistics.classes(tokens)[at])
        yield _blocks(range(-(-len(weights) // BLOCK)), seen, weights)

    def average(table: pa.Table) -> pa.Table:
        seen, total, block = np.zeros(BLOCK), np.zeros((BLOCK, CLASSES)), table["block"][0].as_py()
        for s, w in zip(table["seen"], table["weights"]):
            s = np.frombuffer(s.as_py(), np.float32)
            total += s[:, None] * np.frombuffer(w.as_py(), np.float16).reshape(BLOCK, CLASSES)
            seen += s
        old = sent.value[1][block * BLOCK: (block + 1) * BLOCK]
        new = np.where(seen[:, None] > 0, total / np.maximum(seen, 1)[:, None], old)
        return pa.Table.from_batches([_blocks([block], seen, new)])

    kind = "block int, seen binary, weights binary"
    rows = documents.select("text").mapInArrow(task, kind).withColumn("_g", F.pmod(F.spark_partition_id(), F.lit(fan)))
    rows = rows.groupBy("block", "_g").applyInArrow(average, kind).groupBy("block").applyInArrow(average, kind)
    out = weights.copy()
    for r in rows.collect():  # the model has a fixed size
        out[r.block * BLOCK: (r.block + 1) * BLOCK] = np.frombuffer(r.weights, np.float16).reshape(BLOCK, CLASSES)
    sent.unpersist()
    return out


def _blocks(blocks, seen: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    """One row per block of features; ``seen`` and ``weights`` hold these blocks one after the other."""
    spans = [slice(i * BLOCK, (i + 1) * BLOCK) for i in range(len(blocks))]
    return pa.RecordBatch.from_arrays([
        pa.array(list(blocks), pa.int32()), pa.array([seen[s].astype(np.float32).tobytes() for s in spans], pa.binary()),
        pa.array([weights[s].astype(np.float16).tobytes() for s in spans], pa.binary())], ["block", "seen", "weights"])


def _chunk_tokens(table: pa.Table):
    data, bounds = text_bytes(table["text"])
    for first, end, part, inner in row_slices(data, bounds):
        yield first, end, Tokens(part, inner)


def _keys(table: pa.Table):
    train = table["_train"].to_numpy()
    hashes, suffix, use = [], [], []
    for first, end, tokens in _chunk_tokens(table):
        hashes.append(tokens.hashes)
        suffix.append(tokens.suffix)
        use.append(np.repeat(train[first:end], np.diff(tokens.bounds)))
    keys, at, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate(use), minlength=len(keys)).astype(np.uint32)
    return keys, counts * np.uint32(32) + np.concatenate(suffix)[at].astype(np.uint32)


def _totals(keys, starts, values):
    """Total count per key for every chunk, and the sums of the range."""
    known, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
    totals = np.bincount(inverse, weights=values // 32, minlength=len(known)).astype(np.int64)
    suffix = (values[at] % 32).astype(np.int64)
    best = np.lexsort((known, -totals))[:TOP]
    sums = {"n": int(totals.sum()), "v": int((totals > 0).sum()), "once": int((totals == 1).sum()),
            "mass": np.bincount(suffix, weights=totals, minlength=SUFFIX).tolist(),
            "top": [(int(known[i]), int(totals[i]), int(suffix[i])) for i in best if totals[i] > 0]}
    back = totals[inverse].astype("<u4")
    return [zlib.compress(back[a:b].tobytes(), 1) for a, b in zip(starts[:-1], starts[1:])], json.dumps(sums).encode()


_SUMS = "n long, v long, once long, mass array<double>, top array<array<string>>"


def _statistics(replies: DataFrame) -> Statistics:
    """Totals of all ranges, added up in Spark."""
    sums = replies.filter("_chunk = -1").select(F.from_json(F.col("_reply").cast("string"), _SUMS).alias("s")).select("s.*")
    whole = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "once")],
                     F.array(*[F.coalesce(F.sum(F.get("mass", F.lit(i))), F.lit(0.0)) for i in range(SUFFIX)]).alias("mass")).first()
    top = sums.select(F.explode("top").alias("t")).select(
        F.col("t")[0].cast("decimal(20,0)").alias("hash"), F.col("t")[1].cast("long").alias("n"), F.col("t")[2].cast("int").alias("suffix"))
    best = top.orderBy(F.desc("n"), "hash").limit(TOP).collect()
    return Statistics([{**whole.asDict(), "top": [(int(r.hash), r.n, r.suffix) for r in best]}])


def scored(documents: DataFrame, train, rounds: int = ROUNDS) -> DataFrame:
    """Input columns and ``_n_tokens, _n_known, _train_tokens, _base, _score``; ``train`` is a boolean column."""
    others = [c for c in documents.columns if c != "text"]
    layout = exchange.Layout(documents)
    rows = layout.deal(documents.withColumn("_train", F.coalesce(train, F.lit(False)))).select(F.struct(*others).alias("_row"), "text", "_train", "_chunk")
    replies = cut(exchange.answer(exchange.ask(rows.select("text", "_train", "_chunk"), layout.bits, _keys), _totals))
    statistics = _statistics(replies)
    weights = np.zeros((TABLES * BUCKETS, CLASSES), np.float32)
    if statistics.n:
        fan = max(1, math.isqrt(layout.total // SPLIT_BYTES))
        for turn in range(rounds):
            weights = _train_round(documents.filter(F.coalesce(train, F.lit(False))), statistics, weights, turn, rounds, fan)
    sent = documents.sparkSession.sparkContext.broadcast((statistics, weights.astype(np.float32)))

    def run(table, blobs):
        statistics, weights = sent.value
        prior = statistics.prior.astype(np.float32)
        parts = list(_chunk_tokens(table))
        out = [[], [], [], []]
        if parts:
            keys = np.unique(np.concatenate([t.hashes for *_, t in parts]))
            counts = np.frombuffer(b"".join(map(zlib.decompress, blobs)), "<u4").astype(np.int64)
            bottom = statistics.n + 0.5 * (statistics.v + 1)
        for _, _, tokens in parts:
            c = counts[np.searchsorted(keys, tokens.hashes)]
            starts = tokens.bounds[:-1]
            classes = np.where(c > 0, statistics.classes(tokens), UNKNOWN)
            features = tokens.features()
            value = np.empty(len(c))
            for a in range(0, len(c), BATCH):
                b = a + BATCH
                value[a:b] = _log_classes(weights, prior, features[:, a:b])[np.arange(len(c[a:b])), classes[a:b]]
            value += np.where(c > 0, np.log(np.maximum(c, 1) / np.maximum(statistics.mass[classes], 1)), 0)
            out[0].append(np.diff(tokens.bounds))
            out[1].append(np.add.reduceat((c > 0).astype(np.int64), starts))
            out[2].append(np.add.reduceat(np.log10((c + 0.5) / bottom), starts))
            out[3].append(np.add.reduceat(value / np.log(10), starts))
        n_tokens, n_known, base, score = (np.concatenate(x) if x else np.zeros(0) for x in out)
        row = table["_row"].combine_chunks() if table.num_rows else table["_row"]
        return pa.table([row, pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                         pa.array(np.full(len(n_tokens), statistics.n), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())],
                        names=["_row", "_n_tokens", "_n_known", "_train_tokens", "_base", "_score"])

    kind = rows.schema["_row"].dataType.simpleString()
    done = exchange.finish(rows.select("_row", "text", "_chunk"), replies.filter("_chunk >= 0"), run,
                           f"_row {kind}, _n_tokens long, _n_known long, _train_tokens long, _base double, _score double")
    return done.select(*[F.col("_row")[c].alias(c) for c in others], "_n_tokens", "_n_known", "_train_tokens", "_base", "_score")


def op6(spark, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), FOLDS, FOLD)
    done = scored(read(spark, sf_dir, "documents").select("doc_id", "text"), ~out)
    return done.select("doc_id", out.alias("held_out"), F.col("_n_tokens").alias("n_tokens"), F.col("_n_known").alias("n_known"),
                       F.col("_train_tokens").alias("train_tokens"), F.col("_base").alias("base_score"), F.col("_score").alias("score"))
