"""Check registered queries against DuckDB: run_check.py SF_DIR [name …]."""

import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_module
from ledgerloom.session import build_session
from tests.oracle import compare, connect


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    con = connect(sf_dir)
    bad = []
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                n = df.toArrow().num_rows
                problem = None if n else "EMPTY"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {'' if name in oracles else '(rows)'} {problem or ''}"[:900], flush=True)
        if problem:
            bad.append(name)
    print(len(bad), "bad:", *bad)


if __name__ == "__main__":
    main()
