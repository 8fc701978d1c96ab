import datetime
import pathlib
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.models import tiers
from ledgerloom.operators import enrich, hops, parse, sampling, tracecalc, transfers
from ledgerloom.plans import ORACLES, QUERIES
from ledgerloom.plans import views as V
from ledgerloom.session import shared_dir
from tests.oracle import compare
from tests.test_findings_r04 import counted, plan

TRACE = "block_number bigint, transaction_hash string, trace_address array<int>, error string, trace_type string, reward_type string, from_address string, to_address string, value decimal(38,0), trace_index bigint"


def staged_folders(spark):
    return sorted(p.name for p in pathlib.Path(shared_dir(spark).removeprefix("file:")).glob("staged-*"))


def orders_with_lines(folder, keys):
    """Order and line tables of the given order keys, two lines each."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    n, day = len(keys), datetime.datetime(1996, 1, 2)
    pq.write_table(pa.table({
        "o_orderkey": keys, "o_custkey": [k % 5 for k in keys], "o_orderstatus": ["OFP"[k % 3] for k in keys], "o_totalprice": [k + 0.5 for k in keys],
        "o_orderdate": [day] * n, "o_orderpriority": ["1-URGENT"] * n}), f"{folder}/orders.parquet")
    twice = [k for k in keys for _ in range(2)]
    pq.write_table(pa.table({
        "l_orderkey": twice, "l_partkey": [k % 11 for k in twice], "l_suppkey": [k % 3 for k in twice], "l_linenumber": pa.array([1, 2] * n, pa.int32()),
        "l_quantity": [float(k % 7 + 1) for k in twice], "l_extendedprice": [k + 0.25 for k in twice], "l_returnflag": ["ANR"[(k + i) % 3] for i, k in enumerate(twice)],
        "l_linestatus": ["OF"[k % 2] for k in twice], "l_shipdate": [day] * 2 * n}), f"{folder}/lineitem.parquet")
    return str(folder)


def test_stream_export_blocks_exports_every_block(spark, tmp_path):
    """Late and corrected receipts a long way behind the head, and the last blocks."""
    import duckdb

    d = orders_with_lines(tmp_path, [1, 3, 7, 57, 100, 199_990, 199_998, 199_999, 200_000, 200_007])
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    assert compare(QUERIES["stream_export_blocks"](spark, d), con, ORACLES["stream_export_blocks"]) is None


def test_conditions_from_a_join_do_not_parse_a_response_again(spark):
    body = '{"number":"0x5","hash":"0xa","timestamp":"0x7","transactions":["0x1"]}'
    tokens = spark.range(9).select(F.col("id").alias("block_number"), F.col("id").cast("string").alias("address")).filter(
        F.length(F.repeat(F.col("block_number").cast("string"), 2)) == 2)
    done = enrich.enrich_tokens(parse.parse_blocks(spark.createDataFrame([(body,), ("",), (None,)], "body string")), tokens)
    assert plan(done).count("from_json") == 1
    assert [tuple(r) for r in done.collect()] == [(5, "5", 7, "0xa")]
    receipts = parse.parse_receipts(spark.createDataFrame([('{"transactionHash":"0x1","status":"0x1"}',)], "body string")).filter("status = 1 AND transaction_hash <> ''")
    assert plan(receipts).count("from_json") == 1 and receipts.count() == 1


def test_lines_are_shuffled_once_for_their_blocks_and_traces(spark, tmp_path):
    d = orders_with_lines(tmp_path, [1, 2, 3])
    for raw, most in ((V.raw_traces, 1), (V.raw_receipts, 1), (V.raw_call_frames, 1)):
        df = raw(spark, d)
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == most
        assert df.count() == (6 if raw is V.raw_receipts else 3)


def dead(trace, traces):
    """By the definition: itself or an ancestor of the same transaction failed."""
    if trace[3]:
        return True
    if not trace[1] or trace[2] is None:
        return False
    return any(t[1] == trace[1] and t[3] and t[2] is not None and trace[2][:len(t[2])] == t[2] for t in traces)


def test_statuses_and_ids_of_odd_trees(spark):
    import random

    r = random.Random(5)
    rows = []
    for i in range(600):
        tx = r.choice([None, "", "0xa", "0xb", "0xc", "7"])
        rows.append((r.choice([5, 7, None]), tx, r.choice([None, *[[r.choice([0, 1, 2, 10]) for _ in range(k)] for k in range(5)]]), r.choice([None, "", None, "", "bad"]) if r.random() < 0.2 else None,
                     r.choice(["call", "reward"]), r.choice([None, "block", "uncle"]), r.choice(["0x1", "0x2"]), None, Decimal(r.randrange(3)), i))
    traces, seen = counted(spark, rows, TRACE)
    done = {x.trace_index: x for x in tracecalc.finish_traces(traces).collect()}
    assert seen.value == len(rows) == len(done)
    key = lambda t: tuple((v is not None, v or 0) for v in (t[5], t[6], t[7], t[8], t[9]))
    for t in rows:
        x = done[t[9]]
        assert (x.block_number, x.transaction_hash, x.trace_address, x.error) == t[:4]
        assert x.status == (0 if dead(t, rows) else 1), t
        if t[1]:
            assert x.trace_id == "_".join([t[4], t[1], "_".join(map(str, t[2] or []))])
        else:
            rank = sorted((key(o), o[9]) for o in rows if not o[1] and (o[0], o[4]) == (t[0], t[4])).index((key(t), t[9]))
            assert x.trace_id == "_".join([t[4], *([str(t[0])] if t[0] is not None else []), str(rank)])


def test_traces_are_shuffled_once_for_ids_and_statuses(spark):
    traces = spark.createDataFrame([(1, "0xa", [0], None, "call", None, "0x1", None, None, 0)], TRACE)
    kept = staged_folders(spark)
    done = tracecalc.finish_traces(traces).select("trace_id", "status")
    assert staged_folders(spark) == kept
    assert done._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_distances_keep_the_last_round_only(spark):
    """A path of 40 nodes, 33 sources: two words of bits, many rounds."""
    path = spark.range(39).select(F.lit(1).alias("seed"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    sources = spark.range(33).select(F.lit(1).alias("seed"), F.col("id").alias("anchor"))
    kept = staged_folders(spark)
    table = hops.hop_distances(path, sources)
    assert len(staged_folders(spark)) == len(kept) + 1
    assert {(r.anchor, r.node_id): r.dist for r in table.collect()} == {(a, n): abs(a - n) for a in range(33) for n in range(40)}


def test_combined_augmentation_reads_subgraphs_a_bounded_number_of_times(spark):
    edges = [(s, 10 * s + i, a, b) for s in range(3) for i, (a, b) in enumerate([(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)])]
    inner, seen = counted(spark, edges, "seed bigint, edge_id bigint, src bigint, dst bigint")
    nodes = spark.createDataFrame([(s, n) for s in range(3) for n in range(4)], "seed bigint, node_id bigint")
    kept, left, masked = sampling.combined(nodes, inner, nodes.withColumn("x", F.lit(1.0)), ["x"])
    assert {(r.seed, r.node_id) for r in masked.collect()} == {(r.seed, r.node_id) for r in kept.collect()} and left.count()
    assert seen.value <= 2 * len(edges)


def test_pooled_subgraphs_carry_no_other_columns(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(tiers, "subgraphs", lambda edges, *a, **b: seen.append(edges.columns) or hops.subgraphs(edges, *a, **b))
    e = spark.createDataFrame([(0, 1, "x"), (1, 2, "y"), (2, 0, "z"), (2, 0, "z")], "src bigint, dst bigint, note string")
    f = spark.createDataFrame([(i, *[float(i)] * 4) for i in range(3)], "node_id bigint, " + ", ".join(f"{c} double" for c in tiers.POOLED))
    pooled, _ = tiers.pooled_subgraphs(e, f, f.select("node_id"))
    assert seen == [["src", "dst"]] and {(r.node_id, r.num_nodes, r.num_edges) for r in pooled.collect()} == {(0, 3, 4), (1, 3, 4), (2, 3, 4)}


def test_export_all_shuffles_no_whole_receipts(spark, tmp_path, monkeypatch):
    """Only receipts of other transactions make the filter join; they go in any case."""
    from ledgerloom.sinks import export_all as X

    d = orders_with_lines(tmp_path, [1, 2, 3])
    receipts = V.raw_receipts(spark, d)
    code = spark.createDataFrame([], "address string, bytecode string")
    answers = spark.createDataFrame([], "address string, call string, result string")
    alien = spark.createDataFrame([('{"transactionHash":"0xalien","blockNumber":"0x1"}',), ('{"blockNumber":"0x1"}',)], "body string")
    joins = []
    monkeypatch.setattr(X, "staged", lambda df, keep=X.staged: joins.append(plan(df).count("LeftSemi")) or keep(df))
    for more, found in ((receipts, 0), (receipts.unionByName(alien), 1)):
        joins.clear()
        out = X.export_all(V.raw_blocks(spark, d), more, code, answers)
        assert sum(joins) == found and out["receipts"].count() == 6 and out["logs"].count() == 12


def test_transfers_split_their_data_once(spark):
    a, b = "0x" + "1" * 64, "0x" + "2" * 64
    rows = [("0xT", "0x" + "0" * 63 + "5", [transfers.TRANSFER_TOPIC, a, b], "0xa", 0, 1), ("0xT", "0x", [transfers.TRANSFER_TOPIC, a], "0xa", 1, 1),
            ("0xT", None, [transfers.TRANSFER_TOPIC], "0xa", 2, 1), ("0xT", "0x", None, "0xa", 3, 1)]
    done = transfers.extract_token_transfers(spark.createDataFrame(rows, "address string, data string, topics array<string>, transaction_hash string, log_index bigint, block_number bigint"))
    assert plan(done).count("regexp_extract_all") == 1
    assert [(r.token_address, r.from_address, r.to_address, r.value) for r in done.collect()] == [("0xt", "0x" + "1" * 40, "0x" + "2" * 40, "5")]
