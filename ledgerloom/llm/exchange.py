"""Count keys over all documents without a row per key: chunks -> key ranges -> chunks.

Documents are dealt into chunks by a hash of id and text. A chunk sends its distinct keys,
sorted and cut into ranges by their leading bits, as one binary value per range. A range
sees each key at most once per chunk, however often it occurs, so no key is hot. It
answers every chunk with one value per key, in the order of the chunk's keys, and the chunk
puts the answers of its ranges together. The texts are shuffled once per job and what moves
beside them is a few bytes per distinct key of a chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import give_back, planes, unplanes

CHUNK_BYTES = 2 << 20
RANGE_BYTES = 16 << 20
ROW_BYTES = 16  # what a row counts beside its text, so that many empty texts make many chunks too


class Layout:
    """Numbers of chunks and ranges for a table, from the bytes of its texts.

    Chunks grow from 2 MB to at most 64 MB of text with the root of the input, which keeps the
    number of values exchanged in proportion to the input.
    """

    def __init__(self, documents: DataFrame):
        total = documents.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
        size = min(64 << 20, max(CHUNK_BYTES, math.isqrt(total) * 64))
        self.total = total
        self.chunks = max(1, math.ceil(total / size))
        self.bits = max(5, math.ceil(math.log2(max(1, total / RANGE_BYTES))))

    def deal(self, documents: DataFrame) -> DataFrame:
        key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))
        return documents.withColumn("_chunk", F.pmod(key, F.lit(self.chunks)).cast("int"))


def ask(dealt: DataFrame, bits: int, keys: Callable[[pa.Table], tuple[np.ndarray, np.ndarray | None]]) -> DataFrame:
    """``keys`` gives the sorted distinct keys of a chunk and optionally one unsigned number each."""
    def run(table: pa.Table) -> pa.Table:
        found, values = keys(table)
        ranges = (found >> np.uint64(64 - bits)).astype(np.int32)
        at = np.flatnonzero(np.diff(ranges, prepend=-1)) if len(found) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(found))
        spans = list(zip(at.tolist(), ends.tolist()))
        chunk = table["_chunk"][0].as_py()
        give_back()
        return pa.table({
            "_range": pa.array(ranges[at], pa.int32()),
            "_chunk": pa.array(np.full(len(at), chunk, np.int32)),
            "_keys": pa.array([planes(found[a:b]) for a, b in spans], pa.binary()),
            "_values": pa.array([None if values is None else values[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()),
        })
    return dealt.groupBy("_chunk").applyInArrow(run, "_range int, _chunk int, _keys binary, _values binary")


def answer(asked: DataFrame, reply: Callable) -> DataFrame:
    """``reply(keys, starts, chunk sizes, values)`` gives one binary value per chunk of a range.

    ``keys`` holds the keys of all chunks one after the other and ``starts`` their bounds.
    A reply may also give one extra binary value for the range, stored under chunk -1.
    """
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_chunk")
        parts = [unplanes(b.as_py()) for b in table["_keys"]]
        starts = np.cumsum([0, *map(len, parts)])
        values = [np.frombuffer(b.as_py(), "<u4") if b.is_valid else None for b in table["_values"]]
        values = None if any(v is None for v in values) else np.concatenate(values)
        blobs, extra = reply(np.concatenate(parts), starts, values)
        chunks = table["_chunk"].to_pylist()
        where = table["_range"][0].as_py()
        if extra is not None:
            chunks, blobs = [*chunks, -1], [*blobs, extra]
        del parts
        give_back()
        return pa.table({
            "_chunk": pa.array(chunks, pa.int32()), "_range": pa.array([where] * len(chunks), pa.int32()), "_reply": pa.array(blobs, pa.binary())})
    return asked.groupBy("_range").applyInArrow(run, "_chunk int, _range int, _reply binary")


def finish(dealt: DataFrame, replies: DataFrame, run: Callable[[pa.Table, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """``run`` gets the rows of a chunk and its replies in key order."""
    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return run(left, [])
        done = run(left, [b.as_py() for b in right.sort_by("_range")["_reply"]] if right.num_rows else [])
        give_back()
        return done
    return dealt.groupBy("_chunk").cogroup(replies.groupBy("_chunk")).applyInArrow(both, schema)
