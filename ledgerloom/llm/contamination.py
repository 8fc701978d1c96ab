"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole texts inside one task. Words outside the benchmark's vocabulary
cannot be part of a match, so they become separators, and stretches between separators
shorter than the shortest window go as well. What is left is indexed: suffix array by prefix
doubling, Burrows-Wheeler transform, wavelet tree with rank counts, every eighth suffix
position kept. All windows of the benchmark are searched backwards at once, their
occurrences located by walking to a kept position, and overlapping ones merged into spans.

Nothing is shuffled. The benchmark is a query set: it is read in blocks of bounded size,
and only one block at a time is broadcast and searched.

Null text has no words, neither in a document nor in an item. Empty tables give empty
results, an empty benchmark hits nothing. Equal documents get equal results; items with
the same words are all reported. Ids are compared as strings when they are joined.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import ALNUM, cut, give_back, read, row_slices, text_bytes, word_hashes

WIDTH = 10
SAMPLE = 8
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20


class WaveletTree:
    """Bit planes of a sequence, most significant bit first, with the number of ones before each position."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros, self.bits = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            self.bits.append(bit.astype(np.int8))
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(bit) - int(bit.sum()))
            # Zeros first, each half in its old order.
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            one = ((symbols >> (self.levels - 1 - k)) & 1).astype(bool)
            ones = self.ones[k]
            at_ones, low_ones = ones[at].astype(np.int64), ones[low].astype(np.int64)
            at = np.where(one, self.zeros[k] + at_ones, at - at_ones)
            low = np.where(one, self.zeros[k] + low_ones, low - low_ones)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbols = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            bit = self.bits[k][at].astype(np.int64)
            ones = self.ones[k][at]
            symbols = symbols * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return symbols


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; a missing tail sorts first."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        tail = np.zeros(n, np.int64)
        tail[: max(0, n - step)] = rank[step:]
        pair = rank * (n + 1) + tail
        order = np.argsort(pair, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], pair[order][1:] != pair[order][:-1]]))
        if new[order[-1]] == n or step > n:
            return order
        rank, step = new, step * 2


class FMIndex:
    """Self-index over a sequence of symbols 1..sigma-1; symbol 0 ends it."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_array(text)
        last = text[order - 1]
        self.tree = WaveletTree(last, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        kept = order % sample == 0
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.positions, self.n = kept, order[kept], len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``[low, high)`` of each pattern; ``patterns`` is padded on the left."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbols = patterns[live, -back]
            low[live] = self.first[symbols] + self.tree.rank(symbols, low[live])
            high[live] = self.first[symbols] + self.tree.rank(symbols, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        open_rows = np.arange(len(rows))
        while len(open_rows):
            at = rows[open_rows]
            done = self.kept[at]
            out[open_rows[done]] = self.positions[self.kept_before[at[done]]] + steps
            open_rows = open_rows[~done]
            at = rows[open_rows]
            symbols = self.tree.access(at)
            rows[open_rows] = self.first[symbols] + self.tree.rank(symbols, at)
            steps += 1
        return out


class Phrases:
    """Distinct windows of a block of items: symbols padded on the left, lengths, and the items of each."""

    def __init__(self, texts: list[str], width: int):
        data, bounds = text_bytes(pa.array(texts, pa.string()))
        words = word_hashes(data, bounds, ALNUM, True)
        self.vocabulary, symbols = np.unique(words.hashes, return_inverse=True)
        found: dict[bytes, int] = {}
        rows, lengths, owners = [], [], []
        for item in range(len(texts)):
            own = symbols[words.first[item]: words.first[item + 1]] + 2  # 0 ends, 1 separates
            size = min(width, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                window = own[i: i + size].astype(np.int64)
                key = window.tobytes()
                if key not in found:
                    found[key] = len(rows)
                    rows.append(np.concatenate([np.zeros(width - size, np.int64), window]))
                    lengths.append(size)
                    owners.append([])
                if item not in owners[found[key]][-1:]:
                    owners[found[key]].append(item)
        self.patterns = np.array(rows, np.int64).reshape(-1, width)
        self.lengths = np.array(lengths, np.int64)
        self.owners = owners

    def matches(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(word position, pattern)`` of every occurrence inside one text of the shard."""
        none = np.zeros(0, np.int64)
        if not len(self.patterns) or not len(hashes):
            return none, none
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == hashes
        # Stretches of known words; they end with a text as well.
        starts = known.copy()
        starts[1:] &= ~known[:-1]
        edges = first[1:-1]
        edges = edges[(edges > 0) & (edges < len(known))]
        starts[edges] = known[edges]
        stretch = np.cumsum(starts)
        sizes = np.bincount(stretch[known], minlength=int(stretch[-1]) + 1)
        keep = np.flatnonzero(known & (sizes[stretch] >= self.lengths.min()))
        if not len(keep):
            return none, none
        # A separator before every stretch.
        new = np.concatenate([[True], stretch[keep][1:] != stretch[keep][:-1]])
        place = np.arange(len(keep)) + np.cumsum(new)
        text = np.ones(place[-1] + 1, np.int64)
        text[place] = at[keep] + 2
        source = np.full(len(text), -1, np.int64)
        source[place] = keep
        index = FMIndex(text, len(self.vocabulary) + 2)
        low, high = index.search(self.patterns, self.lengths)
        counts = high - low
        hit = np.flatnonzero(counts > 0)
        counts = counts[hit]
        rows = np.repeat(low[hit], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return source[index.locate(rows)] if len(rows) else none, np.repeat(hit, counts)


def blocks(spark, benchmark: DataFrame, width: int, block_bytes: int) -> list:
    """Broadcast blocks of items. A block is collected, sent and let go before the next one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    out = []
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        rows = sorted((r.item_id or "", r.text) for r in part.collect())
        out.append(spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows])))
    return out


def find(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Input columns and ``_n_words``, ``_n_hit``, ``_items`` (sorted ids of items found), ``_spans`` (hit words,
    end excluded) and ``_rest`` (the text without the spans, null where nothing was hit)."""
    sent = blocks(documents.sparkSession, benchmark, width, block_bytes)
    added = [T.StructField("_n_words", T.LongType()), T.StructField("_n_hit", T.LongType()), T.StructField("_items", T.ArrayType(T.StringType())),
             T.StructField("_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("_rest", T.StringType())]
    rows = documents.select(F.struct(*documents.columns).alias("_row"), "text")

    def task(batches):
        cache = {}

        def phrases(k):
            # One block is held at a time; with a single block it is built once for the task.
            if k not in cache:
                cache.clear()
                ids, texts = sent[k].value
                cache[k] = (ids, Phrases(texts, width))
            return cache[k]

        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for a, b, part, inner in row_slices(data, bounds, SHARD_BYTES):
                words = word_hashes(part, inner, ALNUM, True)
                found = _search(words, phrases, len(sent))
                raw = None
                out = {f.name: [] for f in added}
                n = np.diff(words.first)
                for i in range(b - a):
                    spans, items = found.get(i, ((), ()))
                    out["_n_words"].append(int(n[i]))
                    out["_n_hit"].append(sum(e - s for s, e in spans))
                    out["_items"].append(sorted(items))
                    out["_spans"].append([[s, e] for s, e in spans])
                    if not spans:
                        out["_rest"].append(None)
                        continue
                    raw = part.tobytes() if raw is None else raw
                    at, pieces, base = int(inner[i]), [], int(words.first[i])
                    for s, e in spans:
                        pieces.append(raw[at: words.starts[base + s]])
                        at = int(words.starts[base + e]) if e < n[i] else int(inner[i + 1])
                    pieces.append(raw[at: inner[i + 1]])
                    out["_rest"].append(b"".join(pieces).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(out["_n_words"], pa.int64()), pa.array(out["_n_hit"], pa.int64()),
                     pa.array(out["_items"], pa.list_(pa.string())), pa.array(out["_spans"], pa.list_(pa.list_(pa.int64()))),
                     pa.array(out["_rest"], pa.string())], ["_row", *out])
        give_back()

    schema = T.StructType([rows.schema["_row"], *added])
    return rows.mapInArrow(task, schema).select(*[F.col("_row")[c].alias(c) for c in documents.columns], *[f.name for f in added])


def _search(words, phrases, n_blocks: int) -> dict:
    """Row -> (merged spans, ids of items) for the rows with an occurrence."""
    hits: dict[int, tuple[list, set]] = {}
    for k in range(n_blocks):
        ids, block = phrases(k)
        at, pattern = block.matches(words.hashes, words.first)
        rows = np.searchsorted(words.first, at, "right") - 1
        for row, pos, p in zip(rows.tolist(), (at - words.first[rows]).tolist(), pattern.tolist()):
            spans, items = hits.setdefault(row, ([], set()))
            spans.append((pos, pos + int(block.lengths[p])))
            items.update(ids[o] for o in block.owners[p])
    return {row: (_merge(spans), items) for row, (spans, items) in hits.items()}


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def op4(spark, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "_items").cast("binary"), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"))


_PATTERN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_PATTERN}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_PATTERN}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS n, array_to_string(w[i: i + least(len(w), {WIDTH}) - 1], ' ') AS k
       FROM (SELECT *, unnest(range(1, greatest(len(w) - {WIDTH} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i: i + n - 1], ' ') AS k
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, k)),
p AS (SELECT r, COUNT(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM h) GROUP BY r),
m AS (SELECT r, COUNT(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
  sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN m USING (r)
"""
