import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import blocks, calltree, contracts, enrich, market, parse, tracecalc, transfers
from ledgerloom.sources import readers

TRANSFER = transfers.TRANSFER_TOPIC
WORD = "0x" + "0" * 24 + "Ab" * 20


def raw(spark, *bodies):
    return spark.createDataFrame([(json.dumps(b),) for b in bodies], "body string")


def test_blocks_with_bare_hashes_and_odd_fields(spark):
    tx = {"hash": "0xt", "from": "0xAB", "to": None, "value": hex(2 * 10**18), "blobVersionedHashes": "no list", "type": "0x2"}
    block = {"number": "0x1", "timestamp": "0x5", "miner": "0xFF", "transactions": [tx, "0xbare"],
             "withdrawals": [{"index": "0x1", "validatorIndex": "0x2", "address": "0xAA", "amount": "0x3"}]}
    df = raw(spark, block, {"number": "0x2"})
    rows = {r.number: r for r in parse.parse_blocks(df).collect()}
    assert (rows[1].transaction_count, rows[1].miner, rows[1].withdrawals[0].amount) == (2, "0xff", 3)
    assert (rows[2].transaction_count, rows[2].withdrawals) == (None, None)
    (t,) = parse.parse_transactions(df).collect()
    assert (t.hash, t.from_address, t.to_address, int(t.value), t.block_timestamp, t.blob_versioned_hashes) == ("0xt", "0xab", None, 2 * 10**18, 5, None)


def test_rpc_envelope_is_unwrapped(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"jsonrpc":"2.0","result":{"number":"0x7"}}\n{"number":"0x8"}\n')
    numbers = parse.parse_blocks(readers.scan_raw(spark, str(tmp_path))).select("number").collect()
    assert sorted(r[0] for r in numbers) == [7, 8]


def logs(spark, *rows):
    return spark.createDataFrame(list(rows), "log_index bigint, transaction_hash string, address string, data string, topics array<string>, block_number bigint")


def test_transfers_of_all_shapes(spark):
    big = hex(2**256 - 1000)
    df = logs(
        spark, (1, "0x1", "0xAA", big, [TRANSFER, WORD, WORD], 1), (2, "0x1", "0xAA", "0x", [TRANSFER.upper().replace("0X", "0x"), WORD, WORD, "0x5"], 1),
        (3, "0x1", "0xAA", WORD + WORD[2:] + "0" * 63 + "9", [TRANSFER], 1), (4, "0x1", "0xAA", big, [TRANSFER], 1),
        (5, "0x1", "0xAA", big, ["0xother", WORD, WORD], 1), (6, "0x1", "0xAA", big, [], 1), (7, "0x1", "0xAA", big, None, 1))
    got = {r.log_index: r for r in transfers.extract_token_transfers(df).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1].value, got[1].value_dec, got[1].from_address) == (str(2**256 - 1000), None, "0x" + "ab" * 20)
    assert (got[2].value, got[3].value) == ("5", "9")


TRACES = "block_number bigint, transaction_hash string, trace_address array<int>, trace_type string, error string, reward_type string, from_address string, to_address string, value bigint, trace_index bigint"


def trace(tx, path, error=None, kind="call", to="0x1", value=1, index=0):
    return (7, tx, path, kind, error, None, "0x0", to, value, index)


def test_trace_status_and_ids(spark):
    df = spark.createDataFrame([
        trace("a", []), trace("a", [0], "Out of gas"), trace("a", [0, 0]), trace("a", [0, 0, 3]), trace("a", [1]), trace("a", [10]),
        trace("b", [], "bad"), trace("b", [0]), trace(None, None, kind="reward", to="0x9", index=9), trace(None, [], "x", kind="reward", to="0x2", index=8)], TRACES)
    done = tracecalc.finish_traces(df).collect()
    assert len(done) == 10
    got = {(r.transaction_hash, tuple(r.trace_address or ())): (r.status, r.trace_id) for r in done if r.transaction_hash}
    assert [got["a", p][0] for p in [(), (0,), (0, 0), (0, 0, 3), (1,), (10,)]] == [1, 0, 0, 0, 1, 1]
    assert (got["b", (0,)][0], got["a", ()][1], got["a", (0, 0, 3)][1]) == (0, "call_a_", "call_a_0_0_3")
    assert {r.to_address: (r.trace_id, r.status) for r in done if not r.transaction_hash} == {"0x2": ("reward_7_0", 0), "0x9": ("reward_7_1", 1)}


def test_missing_parent_is_an_error(spark):
    df = spark.createDataFrame([trace("a", []), trace("a", [0, 1])], TRACES)
    with pytest.raises(ValueError, match="0_1"):
        tracecalc.require_parents(df)
    assert tracecalc.require_parents(df.filter("size(trace_address) = 0")).count() == 1


def test_call_frames(spark):
    leaf = {"type": "SELFDESTRUCT", "from": "0xA", "to": "0xB", "value": "0x1", "gas": "0x0", "gasUsed": "0x0", "input": "0x"}
    mid = {"type": "STATICCALL", "from": "0xA", "to": "0xB", "gas": "0x1", "gasUsed": "0x1", "input": "0x", "calls": [leaf, leaf]}
    top = {"type": "CALL", "from": "0xA", "to": "0xB", "value": "0x2", "gas": "0x1", "gasUsed": "0x1", "input": "0x", "error": "e", "calls": [mid, leaf]}
    line = {"block_number": 3, "transaction_traces": [{"result": top}, leaf]}
    rows = calltree.flatten_call_frames(raw(spark, line)).orderBy("transaction_index", "trace_address").collect()
    assert [(r.transaction_index, r.trace_address, r.trace_type, r.call_type, r.subtraces) for r in rows] == [
        (0, [], "call", "call", 2), (0, [0], "call", "staticcall", 2), (0, [0, 0], "suicide", None, 0), (0, [0, 1], "suicide", None, 0),
        (0, [1], "suicide", None, 0), (1, [], "suicide", None, 0)]
    assert (rows[0].error, rows[0].from_address, rows[1].value) == ("e", "0xa", None)


def test_fork_traces_come_first(spark):
    alloc = spark.createDataFrame([(0, "0xaa", 5), (1, "0xbb", 0)], "position bigint, from_address string, value bigint")
    special = calltree.special_traces(alloc, "daofork")
    shifted = calltree.with_special_traces(special.withColumn("trace_type", F.lit("call")), special)
    assert sorted((r.trace_type, r.trace_index) for r in shifted.collect()) == [("call", 2), ("call", 3), ("daofork", 0), ("daofork", 1)]
    assert special.first().to_address == calltree.FORK_RECEIVER
    with pytest.raises(ValueError):
        calltree.special_traces(alloc, "other")


def test_tokens_from_call_results(spark):
    word = lambda n: f"{n:064x}"
    dynamic = "0x" + word(32) + word(3) + b"Tok".hex().ljust(64, "0")
    fixed = "0x" + b"SYM".hex().ljust(64, "0")
    made = spark.createDataFrame([("0xa", 1, True, False), ("0xb", 2, False, True), ("0xc", 3, False, False)], "address string, block_number bigint, is_erc20 boolean, is_erc721 boolean")
    calls = spark.createDataFrame([
        ("0xa", "name()", dynamic), ("0xa", "symbol()", "0x"), ("0xa", "SYMBOL()", fixed), ("0xa", "decimals()", "0x" + word(18)),
        ("0xa", "totalSupply()", "0x" + "f" * 64), ("0xb", "name()", "0x" + "ff" * 32), ("0xc", "name()", dynamic)], "address string, call string, result string")
    got = {r.address: tuple(r)[1:] for r in contracts.resolve_tokens(made, calls).collect()}
    assert got == {"0xa": ("SYM", "Tok", 18, str(2**256 - 1), 1), "0xb": (None, None, None, None, 2)}


def test_market(spark):
    from ledgerloom.functions.hexnum import content_hash

    data = "0x017dfd85d4f6cb4dcd715a88101f7b1f06cd1e009b2327a0809d01eb9c91f231"
    cid = spark.range(1).select(content_hash(F.lit(data))).first()[0]
    v0, v1 = market.MARKET_V0, market.MARKET_V1
    topic = market.LISTING_TOPICS[0]
    df = logs(
        spark, (1, "0x", v0[1].upper().replace("0X", "0x"), data, [topic, "0x0", "0x7"], v0[2]), (2, "0x", v1[1], data, [topic, "0x0", "0x8"], v1[2]),
        (3, "0x", v0[1], data, [topic, "0x0", "0x9"], v1[2]), (4, "0x", v0[1], data, [topic, "0x0"], v0[2]), (5, "0x", v0[1], data, ["0xother", "0x0", "0x1"], v0[2]))
    docs = spark.createDataFrame([
        (cid, json.dumps({"title": "Shop", "price": {"amount": "5"}, "shopIpfsHash": "S"})),
        ("S/index.html", '<link rel="data-dir" href="dir">'), ("S/dir/products.json", json.dumps([{"id": "p"}, {"title": "no id"}, {"id": "gone"}])),
        ("S/dir/p/data.json", json.dumps({"externalId": 5, "title": "T", "description": "D", "price": 10, "variants": [{"id": 0, "title": "V", "price": 11, "option1": "red"}]}))], "path string, body string")
    listings = {r.listing_id: r for r in market.marketplace_listings(df, docs).collect()}
    assert sorted(listings) == ["1-000-7", "1-001-8"]
    assert (listings["1-000-7"].title, listings["1-000-7"].price, listings["1-000-7"].category) == ("Shop", "5", "")
    products = sorted((r.product_id, r.external_id, r.parent_external_id, r.title, r.price, r.currency, r.option1) for r in market.shop_products(df, docs).collect() if r.listing_id == "1-000-7")
    assert products == [("1-000-7-0", None, "5", "V", 11, "fiat-USD", "red"), ("1-000-7-p", "5", None, "T", 10, "fiat-USD", None)]


def test_cardinality_check(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "k bigint")
    enrich.require_same_cardinality(left, spark.createDataFrame([(1,), (2,)], "n bigint"), ("k", "n"), "rows")
    for other in ([(1,)], [(1,), (1,), (2,)]):
        with pytest.raises(ValueError, match="number of rows"):
            enrich.require_same_cardinality(left, spark.createDataFrame(other, "n bigint"), ("k", "n"), "rows")


def test_tables_needed():
    assert enrich.tables_needed([]) == {"block"}
    assert enrich.tables_needed(["token_transfer"]) == {"block", "transaction", "log", "token_transfer"}
    assert enrich.tables_needed(["token"]) == {"block", "trace", "contract", "token"}
    with pytest.raises(ValueError):
        enrich.tables_needed(["uncle"])


def test_block_ranges(spark):
    df = spark.createDataFrame([(0, 0)] + [(n, 1000 + n * 10) for n in range(1, 6)], "number bigint, timestamp bigint")
    find = lambda a, b: blocks.block_range_for_timestamps(df, a, b)
    assert find(1020, 1040) == (2, 4)
    assert find(1015, 1045) == (2, 4)
    assert find(1010, 1030) == (0, 3)
    assert find(5, 1030) == (0, 3)
    for bad in ((1030, 2000), (1031, 1039), (1040, 1030)):
        with pytest.raises(ValueError):
            find(*bad)


def test_periods_share_end_blocks(spark):
    df = spark.createDataFrame([(1917000,), (1800000,), (1,)], "number bigint")
    got = sorted(tuple(r) for r in blocks.assign_periods(df, "number").collect())
    assert got == [(1800000, "pre_dao"), (1917000, "dao_hack"), (1917000, "pre_dao")]


def test_call_frames_of_any_depth_in_one_job(spark):
    """A thousand frames under each other, beside lines that are none."""
    import json

    frame = {"type": "CALL", "from": "0xA", "to": "0xB", "value": "0x1", "gas": "0x5", "gasUsed": "0x1", "input": "0x", "output": "0x"}
    deep = dict(frame)
    for _ in range(1000):
        deep = {**frame, "calls": [dict(frame), deep]}
    lines = [json.dumps({"block_number": 7, "transaction_traces": [{"result": deep}, frame]}), "not json", None, "[]", json.dumps({"block_number": 8, "transaction_traces": None})]
    raw = spark.createDataFrame([(line,) for line in lines], "body string")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    rows = calltree.flatten_call_frames(raw).orderBy("transaction_index", "trace_address").collect()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before <= 5
    assert len(rows) == 2002
    assert max(len(r.trace_address) for r in rows) == 1000
    assert [r.trace_address for r in rows[:3]] == [[], [0], [1]]
    assert [r.subtraces for r in rows[:3]] == [2, 0, 2] and rows[-1].transaction_index == 1
