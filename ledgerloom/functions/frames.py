"""Walk of nested call frames. Imports nothing from this package, so it can be sent to workers by value."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa

TEXTS = ["type", "from", "to", "value", "gas", "gasUsed", "input", "output", "error"]
# Frames of one output batch.
BATCH = 8192


def frames_of(line: str | None) -> Iterator[tuple]:
    """``(block number, transaction index, path, texts…, number of calls)`` of every frame of a line, parents first.

    The tree is walked with a stack, so depth costs memory of one path only. A line that is no
    JSON object, and an entry that is none, gives nothing; a missing text is null and a number its digits.
    """
    try:
        parsed = json.loads(line) if line else None
    except ValueError:
        return
    if not isinstance(parsed, dict):
        return
    block = parsed.get("block_number")
    for index, entry in enumerate(parsed.get("transaction_traces") or []):
        if not isinstance(entry, dict):
            continue
        wrapped = entry.get("result")
        stack = [((), wrapped if isinstance(wrapped, dict) else entry)]
        while stack:
            path, frame = stack.pop()
            calls = frame.get("calls")
            calls = [c for c in calls if isinstance(c, dict)] if isinstance(calls, list) else []
            texts = (frame.get(name) for name in TEXTS)
            yield (block if isinstance(block, int) else None, index, list(path), *[t if t is None or isinstance(t, str) else json.dumps(t) for t in texts], len(calls))
            stack.extend(((*path, i), call) for i, call in reversed(list(enumerate(calls))))


SCHEMA = "block_number bigint, transaction_index bigint, trace_address array<int>, " + ", ".join(f"`{t}` string" for t in TEXTS) + ", subtraces bigint"
_ARROW = pa.schema([("block_number", pa.int64()), ("transaction_index", pa.int64()), ("trace_address", pa.list_(pa.int32())),
                    *[(t, pa.string()) for t in TEXTS], ("subtraces", pa.int64())])


def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of one text column to batches of frames."""
    held: list[tuple] = []
    for batch in batches:
        for line in batch.column(0):
            for frame in frames_of(line.as_py()):
                held.append(frame)
                if len(held) == BATCH:
                    yield _batch(held)
                    held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
