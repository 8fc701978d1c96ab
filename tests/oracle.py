"""Compare a registered query with its SQL twin on DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isinf(v) or math.isnan(v):
            return (1, repr(v))
        return (1, repr(round(v, 9) + 0.0))
    return (1, repr(v))


def _rows(table, names):
    columns = [table.column(n).to_pylist() for n in names]
    return sorted([tuple(_cell(v) for v in row) for row in zip(*columns)])


def compare(df, con, sql: str) -> str | None:
    """None when rows, names and types agree; otherwise what differs."""
    got = df.toArrow()
    want = con.execute(sql).to_arrow_table() if hasattr(con, "to_arrow_table") else con.execute(sql).arrow()
    if hasattr(want, "read_all"):
        want = want.read_all()
    names = sorted(got.column_names)
    if names != sorted(want.column_names):
        return f"columns {names} vs {sorted(want.column_names)}"
    kinds = [(n, str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in names]
    wrong = [k for k in kinds if k[1].replace("large_", "") != k[2].replace("large_", "")]
    if wrong:
        return f"types {wrong}"
    a, b = _rows(got, names), _rows(want, names)
    if a != b:
        have, wanted = set(a), set(b)
        extra = [r for r in a if r not in wanted][:2]
        missing = [r for r in b if r not in have][:2]
        return f"rows {len(a)} vs {len(b)} {names}; only spark {extra}; only sql {missing}"
    return None if a else "EMPTY"
