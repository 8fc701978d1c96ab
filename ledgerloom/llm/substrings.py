"""Removal of repeated word windows: rolling hashes of every window, counted in Spark.

Every run of ``width`` consecutive words of a text is hashed with a 64-bit Rabin-Karp
rolling hash over word hashes. A window whose hash also occurs at another place, in the
same text or another one, is repeated; overlapping repeated windows merge into maximal
intervals, whose words go. Windows are judged on the input.

Null text and texts shorter than a window lose nothing. Equal rows repeat each other, so
both lose every window. An empty table gives an empty result. The chance that two
different windows share a hash is below n^2 / 2^65 for n windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import exchange
from ledgerloom.llm.common import SPACE_SPLIT, read, row_slices, text_bytes, window_hashes, word_hashes

WIDTH = 35


def _windows(table: pa.Table, width: int):
    data, bounds = text_bytes(table["text"])
    for first, end, part, inner in row_slices(data, bounds):
        words = word_hashes(part, inner)
        yield first, end, part, inner, words, *window_hashes(words, width)


def _several(keys, starts, _values):
    """One bit per key: whether another chunk holds it too."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return [np.packbits(twice[a:b]).tobytes() for a, b in zip(starts[:-1], starts[1:])], None


def without_repeats(documents: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """Input columns (``text`` only on request), and ``_n_words``, ``_n_removed``, ``_kept`` (words joined by a space),
    ``_rest`` (the text itself without the intervals; white space after a kept word stays) and
    ``_spans`` (removed intervals as word positions, end excluded)."""
    layout = exchange.Layout(documents)
    others = [c for c in documents.columns if c != "text"]
    rows = layout.deal(documents).select(F.struct(*others).alias("_row"), "text", "_chunk")

    def keys(table):
        found = [np.unique(h) for *_, h in _windows(table, width)]
        return (np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros(0, np.uint64)), None

    kind = T.StructType([rows.schema["_row"], T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType()),
                         T.StructField("_kept", T.StringType()), T.StructField("_rest", T.StringType()),
                         T.StructField("_spans", T.ArrayType(T.ArrayType(T.LongType()))),
                         *([T.StructField("text", T.StringType())] if with_text else [])])

    def run(table, replies):
        out = {"_n_words": [], "_n_removed": [], "_kept": [], "_rest": [], "_spans": []}
        parts = list(_windows(table, width))
        hashes = [p[-1] for p in parts]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        known, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
        repeated = counts > 1
        if len(known):
            # Replies hold one bit per key of each range, padded to whole bytes.
            repeated |= _unpack(known, replies, layout.bits)
        flags = repeated[inverse]
        done = 0
        for _, _, part, bounds, words, at, own in parts:
            hit = at[flags[done: done + len(own)]]
            done += len(own)
            _cut_rows(part, bounds, words, hit, width, out)
        # Struct columns go through as they came.
        arrays = [table["_row"].combine_chunks() if table.num_rows else table["_row"]]
        text = {"text": table["text"]} if with_text else {}
        return pa.table([*arrays, pa.array(out["_n_words"], pa.int64()), pa.array(out["_n_removed"], pa.int64()),
                         pa.array(out["_kept"], pa.string()), pa.array(out["_rest"], pa.string()),
                         pa.array(out["_spans"], pa.list_(pa.list_(pa.int64()))), *text.values()], names=["_row", *out, *text])

    asked = exchange.ask(rows, layout.bits, keys)
    done = exchange.finish(rows, exchange.answer(asked, _several), run, kind)
    return done.select(*[F.col("_row")[c].alias(c) for c in others], *[f.name for f in kind.fields[1:]])


def _unpack(known: np.ndarray, replies: list[bytes], bits: int) -> np.ndarray:
    ranges = (known >> np.uint64(64 - bits)).astype(np.int64)
    sizes = np.diff(np.append(np.flatnonzero(np.diff(ranges, prepend=-1)), len(known)))
    return np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)) for b, n in zip(replies, sizes, strict=True)]).astype(bool)


def _cut_rows(part, bounds, words, hit, width, out) -> None:
    n = len(words.starts)
    marks = np.zeros(n + 1, np.int64)
    marks[hit] += 1
    np.add.at(marks, np.minimum(hit + width, n), -1)
    gone = np.cumsum(marks[:n]) > 0
    kept = ~gone
    # Bytes of kept words, each followed by one space, with the bounds of the rows in them.
    keep_bytes = np.zeros(len(part) + 1, np.int8)
    keep_bytes[words.starts[kept]] += 1
    keep_bytes[words.ends[kept]] -= 1
    inside = np.cumsum(keep_bytes[:-1]).astype(bool)
    lengths = (words.ends - words.starts)[kept] + 1
    filled = np.full(int(lengths.sum()), 0x20, np.uint8)
    body = np.ones(len(filled), bool)
    body[np.cumsum(lengths) - 1] = False
    filled[body] = part[inside]
    words_before = np.concatenate([[0], np.cumsum(kept)])[words.first]
    byte_at = np.concatenate([[0], np.cumsum(lengths)])[words_before]
    removed_before = np.concatenate([[0], np.cumsum(gone)])[words.first]
    flat = filled.tobytes()
    raw = part.tobytes()
    edge = np.flatnonzero(np.diff(gone, prepend=False, append=False)) if n else np.zeros(0, np.int64)
    for i in range(len(bounds) - 1):
        a, b = int(words.first[i]), int(words.first[i + 1])
        removed = int(removed_before[i + 1] - removed_before[i])
        out["_n_words"].append(b - a)
        out["_n_removed"].append(removed)
        out["_kept"].append(flat[byte_at[i]: max(byte_at[i], byte_at[i + 1] - 1)].decode())
        if not removed:
            out["_rest"].append(None)
            out["_spans"].append([])
            continue
        spans = _row_spans(edge, gone, a, b)
        at, pieces = int(bounds[i]), []
        for s, e in spans:
            pieces.append(raw[at: words.starts[s]])
            at = int(words.starts[e]) if e < b else int(bounds[i + 1])
        pieces.append(raw[at: bounds[i + 1]])
        out["_rest"].append(b"".join(pieces).decode())
        out["_spans"].append([[s - a, e - a] for s, e in spans])


def _row_spans(edge, gone, a, b):
    inner = edge[(edge > a) & (edge < b)] if len(edge) < 64 else edge[np.searchsorted(edge, a, "right"): np.searchsorted(edge, b)]
    points = [*([a] if gone[a] else []), *inner.tolist(), *([b] if gone[b - 1] else [])]
    return list(zip(points[::2], points[1::2]))


def op3(spark, sf_dir: str) -> DataFrame:
    cut_texts = without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut_texts.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
                            F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, row_number() OVER () AS r FROM documents),
p AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, len(w) AS n, unnest(w) AS word FROM d),
k AS (SELECT r, i, md5(array_to_string((SELECT w FROM d d2 WHERE d2.r = p.r)[i: i + {WIDTH - 1}], ' ')) AS h FROM p WHERE i + {WIDTH - 1} <= n),
t AS (SELECT r, i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING COUNT(*) > 1)),
f AS (SELECT p.r, p.i, p.word, max(t.i) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM p LEFT JOIN t USING (r, i)),
a AS (SELECT r, COUNT(*) AS n_words, COUNT(*) FILTER (WHERE last + {WIDTH - 1} >= i) AS n_removed,
        string_agg(word, ' ' ORDER BY i) FILTER (WHERE last IS NULL OR last + {WIDTH - 1} < i) AS kept FROM f GROUP BY r)
SELECT doc_id, COALESCE(n_words, 0)::BIGINT AS n_words, COALESCE(n_removed, 0)::BIGINT AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (r)
"""
