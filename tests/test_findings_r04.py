import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import lm
from ledgerloom.operators import blocks, graph, parse
from ledgerloom.sources import readers


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def counted(spark, rows, schema):
    """``rows`` and a counter of how many of them were computed."""
    seen = spark.sparkContext.accumulator(0)

    def task(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    return spark.createDataFrame(rows, schema).mapInArrow(task, schema), seen


def test_event_stream_computes_its_sources_once(spark):
    rows, seen = counted(spark, [("a", "b", str(i), 9 - i) for i in range(10)] + [(None, "b", "1", 3)], "from_address string, to_address string, value string, block_number bigint")
    done = readers.load_event_stream({"trace": rows}).collect()
    assert [r.timestamp for r in done] == [14.0 * i for i in range(10)] and [r.value for r in done] == [9.0 - i for i in range(10)]
    assert seen.value == 11


def test_range_scans_compute_their_rows_once(spark):
    schema = ", ".join(f"{c} {'bigint' if c in ('block_number', 'log_index') else 'string'}" for c in blocks.RANGE_SCANS["token_transfers"][0])
    rows, seen = counted(spark, [("t", "a", "b", "1", "h", 1, i) for i in range(10)], schema)
    assert [r.block_number for r in blocks.range_scan(rows, "token_transfers", 3, 5).collect()] == [3, 4, 5]
    assert seen.value == 10


def test_address_index_reads_its_tables_once(spark):
    rows, seen = counted(spark, [("c", "a"), ("a", "a"), (None, "b")], "from_address string, to_address string")
    index = {r.address: (r.node_id, r.n) for r in graph.build_address_index(rows).collect()}
    assert index == {None: (0, 1), "a": (1, 3), "b": (2, 1), "c": (3, 1)}
    assert seen.value == 3


def test_conditions_on_a_field_do_not_parse_an_entry_again(spark):
    body = '{"timestamp":"0x5","transactions":[{"hash":"0x1","from":"0xA","to":"0xB"},{"hash":"0x2"},"0x3"]}'
    tx = parse.parse_transactions(spark.createDataFrame([(body,)], "body string")).filter(F.col("from_address") != "0xc")
    assert plan(tx).count("from_json") == 2  # the block and its entries
    assert [(r.hash, r.from_address, r.block_timestamp) for r in tx.collect()] == [("0x1", "0xa", 5)]


def test_features_of_some_tokens_are_those_of_all():
    data = np.frombuffer(b"a b c a b d e a", np.uint8)
    tokens = lm.Tokens(data, np.array([0, 9, 9, len(data)]))
    at = np.arange(1, len(tokens.hashes), 2)
    assert (tokens.features(at) == tokens.features()[:, at]).all()
    assert lm.TABLES * lm.BUCKETS <= np.iinfo(np.int16).max
