import json
import pathlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.sinks import files
from ledgerloom.sources import external, readers


def table(spark):
    return spark.createDataFrame(
        [(1, ["a", "b"], None, True, [(1, "x")]), (2, None, "t", False, [])],
        "n bigint, topics array<string>, note string, flag boolean, items array<struct<i:int,s:string>>")


def read_lines(path, suffix):
    return [line for p in sorted(pathlib.Path(path).rglob(f"*.{suffix}")) for line in p.read_text().splitlines()]


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    files.write_csv(table(spark).coalesce(1), path)
    header, *rows = read_lines(path, "csv")
    assert header == "n,topics,note,flag,items"
    assert rows[1] == "2,,t,False,"
    back = readers.read_items(spark, path, ["n", "topics", "note", "flag", "items"]).orderBy("n").collect()
    assert (back[0].topics, back[0].flag, json.loads(back[0].items.replace('\\"', '"'))) == ("a,b", "True", {"i": 1, "s": "x"})


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, None)], "n bigint, s string").withColumn("d", F.lit("1.123456789").cast("decimal(20,9)"))
    files.write_jsonl(df, path, ["n", "d", "s"])
    assert [json.loads(x) for x in read_lines(path, "json")] == [{"n": 1, "d": 1.12345679, "s": None}]
    assert readers.read_items(spark, path, ["n", "d"]).first().n == "1"


def test_routing_rejects_unknown_types(spark):
    df = spark.createDataFrame([("block", 1), ("log", 2)], "type string, n int")
    assert sorted(files.route_by_type(df, ["block", "log"])) == ["block", "log"]
    with pytest.raises(ValueError, match="log"):
        files.route_by_type(df, ["block"])
    with pytest.raises(ValueError, match="missing"):
        files.route_by_type(df.withColumn("type", F.lit(None).cast("string")), ["block"])


def test_topics(spark, tmp_path):
    items = spark.createDataFrame([("block", "b1", "T", "{}"), ("odd", "o", "T", "{}")], "type string, item_id string, item_timestamp string, payload string")
    records = files.topic_records(items)
    row = records.collect()[0]
    assert (records.count(), row.topic, row.key, [h.key for h in row.headers]) == (1, "blocks", "b1", ["item_id", "item_timestamp"])
    files.write_topics(records, str(tmp_path / "t"))
    assert (tmp_path / "t" / "topic=blocks").exists()


def test_bundles(spark, tmp_path):
    blocks = spark.createDataFrame([(1, "h1"), (2, "h2")], "number bigint, hash string")
    tx = spark.createDataFrame([(1, "a"), (1, "b"), (9, "lost")], "block_number bigint, hash string")
    rows = {r.block_number: r for r in files.block_bundles(blocks, {"transactions": tx}).collect()}
    assert sorted(rows) == [1, 2] and sorted(t.hash for t in rows[1].transactions) == ["a", "b"] and rows[2].transactions == []
    files.write_block_bundles(files.block_bundles(blocks, {"transactions": tx}), str(tmp_path / "b"))
    assert json.loads(read_lines(tmp_path / "b" / "block_number=1", "txt")[0])["block"]["hash"] == "h1"
    with pytest.raises(Exception, match="more than one block row"):
        files.block_bundles(blocks.union(blocks), {"transactions": tx}).collect()
    shaped = files.block_bundles(blocks, {}, lambda df: df.select("block_number"))
    assert shaped.columns == ["block_number"]


def test_upsert_replays_and_replaces(spark, tmp_path):
    base = str(tmp_path)
    put = lambda rows, n: files.upsert(spark, base, spark.createDataFrame(rows, "hash string, v int"), "blocks", n)
    put([("a", 1), ("b", 1)], 0)
    put([("b", 2), ("c", 2)], 1)
    put([("b", 3), ("c", 2)], 1)
    assert sorted(tuple(r) for r in files.read_upserted(spark, base, "blocks").collect()) == [("a", 1), ("b", 3), ("c", 2)]


def test_partitioned_export_and_external_tables(spark, tmp_path):
    rows = spark.createDataFrame([(n, f"h{n}", n * 86400) for n in (0, 99, 100, 120)], "number bigint, hash string, timestamp bigint")
    parts = files.block_partitions(rows, "number", 0, 120, 100)
    files.write_partitioned(parts, str(tmp_path / "blocks"), ["start_block", "end_block"])
    assert (tmp_path / "blocks" / "start_block=00000100" / "end_block=00000120").exists()
    external.register_external_tables(spark, str(tmp_path), entities=["blocks"])
    assert spark.sql("SELECT count(*), max(hash) FROM blocks WHERE number >= 99").first()[:] == (3, "h99")
    assert sorted(str(r.date) for r in files.date_partition(rows, "timestamp").collect())[1] == "1970-04-10"
    assert [files.parse_partition_bound(x) for x in ("1438269988", "1438269988000", "123", "1970-01-02")] == [
        ("unix", 1438269988), ("unix", 1438269988), ("block", 123), ("date", 86400)]


def test_keyed_table(spark, tmp_path):
    """Sixty batches leave a bounded number of folders; a retried batch changes nothing, compacted or not."""
    import random

    from ledgerloom.sinks.keyed_table import KeyedTable

    path = str(tmp_path / "table")
    table = KeyedTable(spark, path, ["k"], buckets=2, compact_every=5)
    rng = random.Random(1)
    want, batches = {}, []
    for n in range(60):
        # Batches of few keys touch some buckets only; null is a key.
        batches.append([(rng.choice([None, *range(30)]), n * 10 + i) for i in range(3)])
        batches[-1] = list({k: (k, v) for k, v in batches[-1]}.values())
        want.update(batches[-1])
    put = lambda n: table.upsert(spark.createDataFrame(batches[n], "k bigint, v bigint").coalesce(1), n)
    read = lambda: {r.k: r.v for r in table.read().collect()}
    for n in range(23):
        put(n)
    so_far = {k: v for rows in batches[:23] for k, v in rows}
    assert read() == so_far
    # Batch 7 is part of the base, batch 21 still a delta: neither changes anything when it comes again.
    for n in (7, 21, 22):
        put(n)
        assert read() == so_far
    for n in range(23, 60):
        put(n)
    assert read() == want
    data, manifests = list((tmp_path / "table" / "data").iterdir()), [p for p in (tmp_path / "table" / "manifest").iterdir() if not p.name.startswith(".")]
    # Two buckets' bases, up to five deltas, and what the manifest before the last still names.
    assert len(data) <= 2 + 5 + 7 and len(manifests) <= 2 + 5
    with pytest.raises(RuntimeError, match="someone else"):
        table._swap({**table.manifest(), "number": table.manifest()["number"] - 1})


def test_keyed_table_without_batches(spark, tmp_path):
    from ledgerloom.sinks.keyed_table import KeyedTable

    table = KeyedTable(spark, str(tmp_path / "table"), ["k"])
    with pytest.raises(ValueError, match="no batch"):
        table.read()
    table.upsert(spark.createDataFrame([], "k bigint, v string"), 0)
    assert table.read().count() == 0 and table.read().columns == ["k", "v"]


def test_sinks_of_a_batch(spark, capsys):
    """Several sinks share one batch; the console prints all rows; tables in memory hold items by type."""
    items = spark.range(55).selectExpr("IF(id % 2 = 0, 'block', 'log') AS type", "concat('i', id) AS item_id")
    seen = []
    sink = files.multi_sink(files.console_sink, files.memory_sink("kept"), lambda df, n: seen.append((n, df.count())))
    sink(items, 0)
    sink(items.limit(5), 1)
    sink(items.limit(5), 1)
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert len(lines) == 65 and {x["item_id"] for x in lines} == {f"i{n}" for n in range(55)}
    assert seen == [(0, 55), (1, 5), (1, 5)]
    assert spark.table("kept_block").count() + spark.table("kept_log").count() == 60


def test_whole_export_with_special_traces(spark):
    from ledgerloom.operators import calltree
    from ledgerloom.sinks.export_all import export_all

    block = {"number": "0x0", "hash": "0xb", "timestamp": "0x1", "transactions": [{"hash": "0xt", "blockNumber": "0x0", "from": "0xA", "to": "0xB", "value": "0x1"}]}
    receipt = {"transactionHash": "0xt", "blockNumber": "0x0", "status": "0x1", "logs": []}
    trace = {"action": {"callType": "call", "from": "0xA", "to": "0xB", "value": "0x1", "gas": "0x1", "input": "0x"}, "blockNumber": 0, "result": {"gasUsed": "0x0", "output": "0x"},
             "subtraces": 0, "traceAddress": [], "transactionHash": "0xt", "transactionPosition": 0, "type": "call"}
    raw = lambda *rows: spark.createDataFrame([(json.dumps(r),) for r in rows], "body string")
    nothing = lambda schema: spark.createDataFrame([], schema)
    first = calltree.special_traces(spark.createDataFrame([(i, f"0x{i}", 5) for i in range(3)], "position bigint, address string, value bigint"), "genesis")
    tables = export_all(raw(block), raw(receipt), nothing("address string, bytecode string"), nothing("address string, call string, result string"),
                        raw([trace]), [first])
    got = sorted((r.trace_index, r.trace_type, r.trace_id, r.status) for r in tables["traces"].collect())
    assert got == [(i, "genesis", f"genesis_0_{i}", 1) for i in range(3)] + [(3, "call", "call_0xt_", 1)]
    assert tables["receipts"].count() == 1 and tables["logs"].count() == 0
