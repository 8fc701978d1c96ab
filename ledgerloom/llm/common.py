"""Shared pieces: Arrow texts as byte arrays, word hashes, fixed splits, bounded training samples."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import session

__all__ = ["SLICE_BYTES", "cut", "row_key", "held_out", "read", "text_bytes", "row_slices", "Words", "word_hashes",
           "window_hashes", "lower_table", "SPACE_SPLIT", "ALNUM", "mix64", "training_rows", "one_each", "planes", "unplanes", "mapped", "give_back"]

# Texts of one numpy pass; a single longer text is a pass of its own. Intermediates take some 40 times as much.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE = _BASE - (_BASE % np.uint64(8)) + np.uint64(5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))

# Byte classes of the two kinds of words. All bytes of a non-ASCII character belong to words.
SPACE_SPLIT = np.ones(256, bool)
SPACE_SPLIT[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint whose shuffle files go as soon as the copy is written.

    The copy in the shared folder has no lineage, so nothing reads those files again.
    """
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, "false")
    conf.set(FREE_SHUFFLES, "true")
    try:
        return session.cut(df)
    finally:
        conf.set(FREE_SHUFFLES, before)


def _powers(base: np.uint64, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006 - kept between calls on purpose
    have = cache.get(int(base))
    if have is None or len(have) < n:
        size = max(n, min(SLICE_BYTES, 1 << max(20, (n - 1).bit_length())))
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 2 * SLICE_BYTES:
            cache[int(base)] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_table(lower: bool) -> np.ndarray:
    """Byte values for hashing; A-Z share the values of a-z when ``lower``."""
    table = _TABLE.copy()
    if lower:
        table[0x41:0x5B] = table[0x61:0x7B]
    return table


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the bounds of its rows (n + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    if data is None or not data.size:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0]: bounds[-1]], bounds - bounds[0]


def row_slices(data: np.ndarray, bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, bounds)`` of runs of whole rows of about ``limit`` bytes."""
    row, rows = 0, len(bounds) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield row, end, data[bounds[row]: bounds[end]], bounds[row: end + 1] - bounds[row]
        row = end


class Words:
    """Words of consecutive texts: ``starts``, ``ends`` (byte positions), ``hashes`` and ``first`` (word bounds per row)."""

    __slots__ = ("starts", "ends", "hashes", "first")

    def __init__(self, starts, ends, hashes, first):
        self.starts, self.ends, self.hashes, self.first = starts, ends, hashes, first


def word_hashes(data: np.ndarray, bounds: np.ndarray, keep: np.ndarray = SPACE_SPLIT, lower: bool = False, stem: int | None = None) -> Words:
    """Maximal runs of ``keep`` bytes inside each row, with a 64-bit hash of their bytes (the first ``stem`` ones, if given)."""
    n = len(data)
    inside = keep[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    table = lower_table(lower)
    table[~keep] = 0
    if len(starts):
        values = table[data]
        if stem is not None:
            first = np.zeros(n, np.int64)
            first[starts] = starts
            values[np.arange(n) - np.maximum.accumulate(first) >= stem] = 0
        sums = np.add.reduceat(values * _powers(_BASE, n), starts)
        hashes = mix64(sums * _powers(_INVERSE, n)[starts])
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(starts, ends, hashes, np.searchsorted(starts, bounds))


def window_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(position of the first word, rolling hash)`` of every run of ``width`` words inside one row."""
    n = len(words.hashes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hashes * _powers(_BASE, n), out=sums[1:])
    rolled = (sums[width:] - sums[:-width]) * _powers(_INVERSE, n)[: n - width + 1]
    valid = np.ones(n - width + 1, bool)
    # A window that starts less than a width before the end of its row would cross it.
    marks = np.zeros(n + 2, np.int64)
    ends = words.first[1:]
    np.add.at(marks, np.maximum(ends - width + 1, words.first[:-1]), 1)
    np.add.at(marks, ends, -1)
    valid &= np.cumsum(marks)[: n - width + 1] == 0
    at = np.flatnonzero(valid)
    return at, mix64(rolled[at])


def planes(keys: np.ndarray) -> bytes:
    """Bytes of unsigned integers, most significant first and transposed, so that sorted keys compress."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view(">u8").ravel().astype(np.uint64)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves ``fold``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def row_key() -> Column:
    """Key of a row of documents by id and text. Equal rows share it and are interchangeable."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), F.coalesce(F.col("text"), F.lit("")))


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# All texts that one model is fitted on, together.
TRAINING_BYTES = 64 << 20


def one_each(rows: DataFrame, keys: list[str], budget: int = TRAINING_BYTES) -> list:
    """Rows of a few keys with one text each, however many rows repeat a key, and ``budget`` bytes of text in all.

    Of a key the text of least hash counts. The sizes come first, one narrow row per key; then the texts
    that fit the budget in the order of their hashes. Whether a text is taken depends on the table only.
    """
    rows = rows.withColumns({"_h": F.xxhash64(F.coalesce("text", F.lit(""))), "_b": F.coalesce(F.octet_length("text"), F.lit(0))})
    sizes = rows.groupBy(*keys).agg(F.min(F.struct("_h", "_b")).alias("_m")).select(*keys, "_m.*").collect()
    taken, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["_h"], *[(r[k] is not None, r[k]) for k in keys])):
        if total + r["_b"] <= budget:
            taken.append(tuple(r[k] for k in keys) + (r["_h"],))
            total += r["_b"]
    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    small = rows.sparkSession.createDataFrame(taken, ", ".join([*kinds, "_h long"]))
    return rows.join(F.broadcast(small), [*keys, "_h"]).groupBy(*keys).agg(F.first("text").alias("text")).collect()


def training_rows(documents: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int, others: int = 1) -> list[tuple[str, int]]:
    """At most ``per_class`` labelled texts of class 1 and ``others`` times as many of class 0, by hash order of
    the id, outside the held-out fold.

    The bounds, on ids here and on bytes in ``one_each``, are parameters of the model. Only the chosen ids (a bounded
    number) reach the driver and are broadcast to the scan of the texts. An id that stands in many rows gives one text.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold)).select(
        "doc_id", F.col(label).cast("int").alias("y")).distinct()
    chosen = None
    for value in (0, 1):
        part = usable.filter(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class if value else per_class * others)
        chosen = part if chosen is None else chosen.unionByName(part)
    spark = documents.sparkSession
    small = spark.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id long, y int")
    rows = one_each(documents.select("doc_id", "text").join(F.broadcast(small), "doc_id"), ["doc_id", "y"])
    rows.sort(key=lambda r: (r.doc_id, r.y, r.text or ""))
    return [(r.text or "", r.y) for r in rows]


@cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system. Idle workers of earlier stages share an executor's memory with later ones."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` for a function from one record batch to an iterator of record batches."""
    def task(batches):
        for batch in batches:
            yield from run(batch)
        give_back()
    return df.mapInArrow(task, schema)
