from pyspark.sql import functions as F

from ledgerloom.models import tiers
from ledgerloom.operators import contracts, enrich, parse, tracecalc
from ledgerloom.session import staged

TRACES = "transaction_hash string, trace_address array<int>, error string, block_number bigint"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trace_statuses_never_broadcast_traces(spark):
    rows = [("0x1", [], None, 1), ("0x1", [0], "bad", 1), ("0x1", [0, 0], None, 1), ("0x2", [], None, 1), (None, [], None, 1)]
    done = tracecalc.trace_statuses(spark.createDataFrame(rows, TRACES))
    assert {(r[0], tuple(r[1])): r.status for r in done.collect()} == {
        ("0x1", ()): 1, ("0x1", (0,)): 0, ("0x1", (0, 0)): 0, ("0x2", ()): 1, (None, ()): 1}
    assert "Broadcast" not in plan(done)


def test_block_contract_and_token_joins_are_merges(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "block_number bigint, x string")
    blocks = spark.createDataFrame([(1, 5, "0xh")], "number bigint, timestamp bigint, hash string")
    joined = enrich.with_block(rows, blocks)
    assert "Broadcast" not in plan(joined) and [tuple(r) for r in joined.collect()] == [(1, "a", 5, "0xh")]
    known = spark.createDataFrame([("0xa", True, False, 1)], "address string, is_erc20 boolean, is_erc721 boolean, block_number bigint")
    answers = spark.createDataFrame([("0xa", "decimals()", "0x12")], "address string, call string, result string")
    tokens = contracts.resolve_tokens(known, answers)
    assert "Broadcast" not in plan(tokens) and tokens.first().decimals == 18


def test_staged_tables_are_written_once(spark):
    df = spark.range(3).select("id", F.uuid().alias("u"), F.array(F.col("id").cast("int")).alias("a"))
    first = staged(df)
    assert staged(first) is first and first.dtypes == df.dtypes and sorted(first.collect()) == sorted(first.collect())


def test_texts_are_parsed_once_before_their_entries(spark):
    body = '{"blockNumber":"0x1","logs":[{"logIndex":"0x0","topics":[]},null]}'
    raw = spark.createDataFrame([(body,), ('{"logs":[]}',), ("{}",), (None,)], "body string").select(F.concat("body", F.lit(" ")).alias("body"))
    logs = parse.parse_logs(raw)
    assert logs._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert sorted(str(r.log_index) for r in logs.collect()) == ["0", "None"]
    traces = parse.parse_traces(spark.createDataFrame([('[{"type":"call"},{"type":"reward"}]',), ("[]",)], "body string"))
    assert traces._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert sorted(r.trace_index for r in traces.collect()) == [0, 1]


def test_models_learn_from_rows_of_one_class(spark):
    rows = spark.createDataFrame([(float(i), 1) for i in range(20)], "x double, label int")
    assert tiers.positive_weight(rows) == 1.0
    scores = tiers.score(tiers.train_logistic(rows, ["x"]), rows, ["x"]).select("score").collect()
    assert all(r.score > 0.5 for r in scores)
    trees = tiers.score(tiers.train_boosted(rows, ["x"], rounds=2), rows, ["x"]).select("score").collect()
    assert all(r.score > 0.5 for r in trees)


def test_texts_are_not_made_inside_the_parser(spark):
    raw = spark.createDataFrame([('{"number":"0x1","logs":[{}]}',), ("",), (None,)], "body string").select(F.concat("body", F.lit(" ")).alias("body"))
    for rows in (parse.open_blocks(raw), parse.open_receipts(raw), parse.parse_traces(raw)):
        text = rows._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("from_json") == 1 and not any("from_json" in line and "concat" in line for line in text.splitlines())
    assert [r.b and r.b.number for r in parse.open_blocks(raw).collect()] == ["0x1", None, None]


def test_trees_see_varying_columns_in_bounded_partitions(spark, monkeypatch):
    rows = spark.createDataFrame([(0.0, float(i), None if i % 3 else 1.0, int(i > 20)) for i in range(40)], "a double, x double, g double, label int")
    assert tiers.varying(rows, ["a", "x", "g"]) == (40, [1, 2]) and tiers.varying(rows, ["a"]) == (40, [0])
    fitted, fit = [], tiers.GBTClassifier.fit
    monkeypatch.setattr(tiers.GBTClassifier, "fit", lambda self, df: (fitted.append(df), fit(self, df))[1])
    model = tiers.train_boosted(rows.coalesce(1), ["a", "x"], rounds=2, depth=2, rows_per_task=3)
    assert fitted[0].rdd.getNumPartitions() >= 14 and {r.live.size for r in fitted[0].collect()} == {1}
    assert all((r.score > 0.5) == (r.label == 1) for r in tiers.score(model, rows, ["a", "x"]).collect())
