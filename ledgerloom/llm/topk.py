"""Exact top-k inner products from an impact-ordered index, score at a time.

Vectors become whole numbers. A posting's impact is the size of its component, quantised into
levels; a shard holds one segment of postings per level. A block of queries adds up the
segments by descending level in accumulators. What a vector has not shown yet is smaller
than the level just read, which bounds its score from above. The vectors with the best
bounds are scored exactly, and their k-th score is the threshold: a query stops only when
the vectors whose bound reaches it are few, or when everything is read, and all of those are
scored exactly. Each (block of queries, shard) is a task's row; the k best of a query over
the shards are ranked in Spark.

Vectors that are null, or hold null or non-finite components, and rows without id take no
part. Rows equal in id and vector count once. A vector shorter than others is padded with
zeros. Ties go to the smaller id. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, read

K, SCALE, EVERY = 20, 64, 20
SHARD, QUERIES = 16384, 1024
FEW = 0.05  # share of a shard that may be scored exactly instead of reading on
LEVELS = (0.75, 0.4)  # quantiles of the sizes of components that part the levels
ROWS = 128  # queries of one pass


class ImpactIndex:
    """Over whole numbers. Queries have components of at most ``reach``; scores are sums of 64-bit integers."""

    def __init__(self, vectors: np.ndarray, reach: int):
        self.exact = np.ascontiguousarray(vectors, np.int64)
        self.reach = reach
        # Every partial sum of products is at most this; whole numbers below 2^24 and 2^53 stay exact.
        most = (int(np.abs(self.exact).max()) if self.exact.size else 0) * reach * vectors.shape[1]
        kind = np.float32 if most < 2**24 else np.float64
        # Sums that double precision rounds: bounds are raised by more than the rounding can be.
        self.slack = 0.0 if most < 2**53 else 4.0 * (vectors.shape[1] + 4) * most * 2.0**-53
        self.vectors = vectors.astype(kind)
        self.n = len(vectors)
        size = np.abs(self.vectors)
        floors = sorted({float(np.quantile(size, q)) for q in LEVELS} | {0.0}, reverse=True) if self.n else [0.0]
        self.segments, self.caps = [], []
        above = np.inf
        for floor in floors:
            self.segments.append(np.where((size >= floor) & (size < above), self.vectors, 0))
            left = size < floor
            # Components are whole numbers: those left are below the floor by one step at least.
            self.caps.append(np.where(left, math.ceil(floor) - 1, 0).astype(kind))
            above = floor

    def search(self, queries: np.ndarray, k: int, own: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query, rows and scores of all that can be among the k best; rows in ``own`` are left out."""
        out: list = [None] * len(queries)
        whole, queries = queries.astype(np.int64), queries.astype(self.vectors.dtype)
        open_rows = np.arange(len(queries))
        sums = np.zeros((len(queries), self.n), self.vectors.dtype)
        for step, (segment, cap) in enumerate(zip(self.segments, self.caps)):
            q = queries[open_rows]
            sums += q @ segment.T
            last = step == len(self.segments) - 1
            bound = sums.copy() if last else sums + np.abs(q) @ cap.T
            bound += bound.dtype.type(self.slack)
            for i, r in enumerate(open_rows):
                bound[i, own[r]] = -np.inf
            if self.n > k:
                lead = np.argpartition(bound, self.n - k, axis=1)[:, self.n - k:]
            stay = []
            for i, r in enumerate(open_rows):
                if self.n > k:
                    scores = self.exact[lead[i]] @ whole[r]
                    threshold = scores[np.isfinite(bound[i, lead[i]])].min() if np.isfinite(bound[i, lead[i]]).all() else -np.inf
                    may = np.flatnonzero(bound[i] >= max(float(threshold), np.finfo(bound.dtype).min))
                else:
                    may = np.flatnonzero(bound[i] > -np.inf)
                if last or len(may) <= max(4 * k, FEW * self.n):
                    out[r] = may, self.exact[may] @ whole[r]
                else:
                    stay.append(i)
            open_rows, sums = open_rows[stay], sums[stay]
            if not len(open_rows):
                break
        return out


def _packed(vectors: DataFrame, key: str, size: int, dims: int) -> DataFrame:
    """One row per group of vectors: ids and components as binary values."""
    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        flat = np.zeros((len(ids), dims), np.int64)
        for i, v in enumerate(table["v"].to_pylist()):
            flat[i, : len(v)] = v
        order = np.argsort(ids, kind="stable")
        kind = np.int16 if len(ids) and np.abs(flat).max() < 2**15 else np.int64
        return pa.table({key: pa.array([table[key][0].as_py()], pa.int32()), "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
                         "wide": pa.array([kind is np.int64]), "parts": pa.array([flat[order].astype(kind).tobytes()], pa.binary())})
    return vectors.withColumn(key, F.pmod(F.xxhash64("id"), F.lit(size)).cast("int")).groupBy(key).applyInArrow(
        run, f"{key} int, ids binary, wide boolean, parts binary")


def whole_numbers(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return embeddings.filter(ok).select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")).distinct()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; both inputs are ``(id, v)`` with whole numbers."""
    n, dims, n_queries = (*vectors.agg(F.count("*"), F.max(F.size("v"))).first(), queries.count())
    dims = max(1, dims or 1)
    shards, blocks = max(1, math.ceil((n or 0) / SHARD)), max(1, math.ceil(n_queries / QUERIES))
    packed = _packed(vectors, "shard", shards, dims)
    asked = _packed(queries, "block", blocks, dims).withColumnsRenamed({"ids": "q_ids", "wide": "q_wide", "parts": "q_parts"})
    # The stated queries meet every shard, block by block.
    work = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(packed, "shard").repartition(min(4096, shards * blocks * 2), "block", "shard")

    def numbers(ids, wide, parts):
        return np.frombuffer(ids, "<i8"), np.frombuffer(parts, np.int64 if wide else np.int16).reshape(-1, dims)

    def task(batches):
        index, held = None, None
        for batch in batches:
            for row in batch.to_pylist():
                ids, matrix = numbers(row["ids"], row["wide"], row["parts"])
                q_ids, q_matrix = numbers(row["q_ids"], row["q_wide"], row["q_parts"])
                reach = int(np.abs(q_matrix.astype(np.int64)).max()) if q_matrix.size else 0
                if held != row["shard"] or reach > index.reach:
                    index, held = ImpactIndex(matrix, reach), row["shard"]
                out = [[], [], []]
                for first in range(0, len(q_ids), ROWS):
                    some = q_ids[first: first + ROWS]
                    own = [np.arange(*np.searchsorted(ids, [q, q + 1])) for q in some]
                    for q, (rows, scores) in zip(some, index.search(q_matrix[first: first + ROWS], k, own)):
                        best = np.lexsort((ids[rows], -scores))[:k]
                        out[0].append(np.full(len(best), q))
                        out[1].append(ids[rows[best]])
                        out[2].append(scores[best].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    found = work.mapInArrow(task, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(spark, sf_dir: str) -> DataFrame:
    vectors = cut(whole_numbers(read(spark, sf_dir, "embeddings")))
    return top_k(vectors, vectors.filter(F.col("id") % EVERY == 0))


ORACLE = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
