"""Queries of the chain ETL half."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import items as I
from ..functions.hexnum import hex_to_text, long_to_hex
from ..operators import blocks as B
from ..operators import calltree, contracts, enrich, parse, tracecalc, transfers
from ..session import shared_dir, staged
from ..sinks import files
from ..sinks.keyed_table import KeyedTable
from ..sources import readers
from . import views as V
from .registry import query
from .sqlviews import _CODE, addr, word


def joined(col: str) -> F.Column:
    return F.array_join(F.col(col).cast("array<string>"), "_").alias(col)


# ---------------------------------------------------------------- parsing

@query("parse_blocks", views="blocks lines", sql="""
    SELECT b.number, b.hash, b.parent_hash, b.miner, CAST(b.number * 1000003 AS VARCHAR) AS difficulty,
           CAST(CAST(b.number + 1 AS HUGEINT) * 18446744073709551616 AS VARCHAR) AS total_difficulty,
           CAST(500 AS BIGINT) AS size, CAST(8000000 AS BIGINT) AS gas_limit, b.gas_used, b.timestamp,
           coalesce(c.n, 0) + CASE WHEN b.status = 'P' THEN 1 ELSE 0 END AS transaction_count,
           CASE WHEN b.status = 'O' THEN b.number END AS withdrawal_index,
           CASE WHEN b.status = 'O' THEN b.gas_used END AS withdrawal_amount
    FROM blocks b LEFT JOIN (SELECT k, count(*) AS n FROM lines GROUP BY k) c ON c.k = b.number""")
def parse_blocks(spark: SparkSession, d: str) -> DataFrame:
    first = F.get("withdrawals", F.lit(0))
    return parse.parse_blocks(V.raw_blocks(spark, d)).select(
        "number", "hash", "parent_hash", "miner", F.col("difficulty").cast("string"),
        F.col("total_difficulty").cast("string"), "size", "gas_limit", "gas_used", "timestamp",
        "transaction_count", first["index"].alias("withdrawal_index"), first["amount"].alias("withdrawal_amount"))


@query("parse_withdrawals", views="blocks", sql="""
    SELECT number AS block_number, number AS index, CAST(7 AS BIGINT) AS validator_index, miner AS address,
           gas_used AS amount FROM blocks WHERE status = 'O'""")
def parse_withdrawals(spark, d):
    return parse.parse_blocks(V.raw_blocks(spark, d)).select(
        F.col("number").alias("block_number"), F.inline("withdrawals"))


@query("parse_transactions", views="transactions blocks", sql="""
    SELECT t.hash, t.nonce, t.block_hash, t.block_number, t.transaction_index, t.from_address, t.to_address,
           CAST(t.value AS VARCHAR) AS value, t.gas, t.gas_price, '0x' AS input, b.timestamp AS block_timestamp,
           CASE WHEN t.flag = 'A' THEN CAST(2 AS BIGINT) END AS transaction_type,
           CASE WHEN t.flag = 'R' THEN '0x01_0x02' END AS blob_versioned_hashes
    FROM transactions t JOIN blocks b ON b.number = t.block_number""")
def parse_transactions(spark, d):
    return parse.parse_transactions(V.raw_blocks(spark, d)).select(
        "hash", "nonce", "block_hash", "block_number", "transaction_index", "from_address", "to_address",
        F.col("value").cast("string"), "gas", "gas_price", "input", "block_timestamp", "transaction_type",
        joined("blob_versioned_hashes"))


@query("parse_receipts", views="lines", sql=f"""
    SELECT {word('k * 1024 + n')} AS transaction_hash, n AS transaction_index, {word('k + 1000000')} AS block_hash,
           k AS block_number, qty * 2000 AS cumulative_gas_used, qty * 1000 AS gas_used,
           CASE WHEN flag = 'A' THEN {addr('part + 2000000')} END AS contract_address,
           CAST(CASE WHEN flag = 'R' THEN 0 ELSE 1 END AS BIGINT) AS status, n * 1000000000 AS effective_gas_price,
           CASE WHEN flag = 'N' THEN CAST(1.5 AS DOUBLE) END AS l1_fee_scalar FROM lines""")
def parse_receipts(spark, d):
    return parse.parse_receipts(V.raw_receipts(spark, d)).select(
        "transaction_hash", "transaction_index", "block_hash", "block_number", "cumulative_gas_used", "gas_used",
        "contract_address", "status", "effective_gas_price", "l1_fee_scalar")


@query("parse_logs", views="logs", sql="""
    SELECT log_index, transaction_hash, transaction_index, block_hash, block_number, address, data,
           array_to_string(topics, '_') AS topics FROM logs""")
def parse_logs(spark, d):
    return parse.parse_logs(V.raw_receipts(spark, d)).withColumn("topics", joined("topics"))


@query("reparse_logs", views="logs", sql="""
    SELECT log_index, transaction_hash, transaction_index, block_hash, block_number, address, data,
           CAST(len(topics) AS BIGINT) AS topic_count, coalesce(topics[1], '') AS first_topic FROM logs""")
def reparse_logs(spark, d):
    flat = files.csv_rows(parse.parse_logs(V.raw_receipts(spark, d)))
    return parse.reparse_logs(flat).select(
        "log_index", "transaction_hash", "transaction_index", "block_hash", "block_number", "address", "data",
        F.size("topics").cast("bigint").alias("topic_count"),
        F.coalesce(F.get("topics", F.lit(0)), F.lit("")).alias("first_topic"))


def _traces(spark, d):
    return parse.parse_traces(V.raw_traces(spark, d))


@query("parse_traces", views="traces", sql="""
    SELECT block_number, transaction_hash, transaction_index, from_address, to_address, CAST(value AS VARCHAR) AS value,
           input, output, trace_type, call_type, reward_type, gas, gas_used, subtraces, path AS trace_address, error,
           trace_index FROM traces""")
def parse_traces(spark, d):
    return _traces(spark, d).select(
        "block_number", "transaction_hash", "transaction_index", "from_address", "to_address",
        F.col("value").cast("string"), "input", "output", "trace_type", "call_type", "reward_type", "gas", "gas_used",
        "subtraces", joined("trace_address"), "error", "trace_index")


@query("trace_index", views="traces", sql="SELECT block_number, trace_type, path AS trace_address, trace_index FROM traces")
def trace_index(spark, d):
    return _traces(spark, d).select("block_number", "trace_type", joined("trace_address"), "trace_index")


@query("trace_ids", views="traces", sql="SELECT block_number, trace_index, trace_id FROM traces")
def trace_ids(spark, d):
    return tracecalc.trace_ids(_traces(spark, d)).select("block_number", "trace_index", "trace_id")


@query("trace_statuses", views="traces", sql="SELECT block_number, trace_index, status FROM traces")
def trace_statuses(spark, d):
    return tracecalc.trace_statuses(_traces(spark, d)).select("block_number", "trace_index", "status")


@query("orphan_traces", views="traces", sql="""
    , kept AS (SELECT * FROM traces WHERE transaction_hash IS NOT NULL AND error IS NULL)
    SELECT a.transaction_hash, a.path FROM kept a
    LEFT JOIN kept p ON p.transaction_hash = a.transaction_hash AND p.trace_index = a.trace_index - 1
    WHERE a.path <> '' AND p.path IS NULL""")
def orphan_traces(spark, d):
    """Traces whose parent failed, found as missing once failed traces are taken away."""
    return tracecalc.orphan_traces(_traces(spark, d).filter("error IS NULL")).select("transaction_hash", "path")


@query("flatten_call_frames", views="calls", sql=f"""
    SELECT k AS block_number, CAST(0 AS BIGINT) AS transaction_index, {addr('supp')} AS from_address, {addr('part')} AS to_address,
           CAST(cents AS VARCHAR) AS value, 'call' AS trace_type,
           CASE WHEN linestatus = 'F' THEN 'delegatecall' ELSE 'call' END AS call_type, qty AS gas, CAST(5 AS BIGINT) AS gas_used,
           CAST(CASE WHEN depth + 1 < calls THEN 2 ELSE 1 END AS BIGINT) AS subtraces,
           CASE WHEN depth = 0 THEN '' ELSE repeat('0_', CAST(depth - 1 AS INTEGER)) || '0' END AS trace_address,
           CASE WHEN flag = 'R' THEN 'reverted' END AS error FROM calls
    UNION ALL
    SELECT k, CAST(0 AS BIGINT), '0xab', '0xcd', '1', 'suicide', NULL, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT),
           repeat('0_', CAST(depth AS INTEGER)) || CASE WHEN depth + 1 < calls THEN '1' ELSE '0' END, NULL FROM calls""")
def flatten_call_frames(spark, d):
    return calltree.flatten_call_frames(V.raw_call_frames(spark, d)).select(
        "block_number", "transaction_index", "from_address", "to_address", F.col("value").cast("string"), "trace_type",
        "call_type", "gas", "gas_used", "subtraces", joined("trace_address"), "error")


@query("special_traces", views="traces", sql=f"""
    , genesis AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS p, {addr('s_suppkey')} AS a,
                         CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS v FROM supplier)
    SELECT CAST(0 AS BIGINT) AS block_number, CAST(NULL AS VARCHAR) AS from_address, a AS to_address, CAST(v AS VARCHAR) AS value,
           'genesis' AS trace_type, p AS trace_index, CAST(1 AS INTEGER) AS status, 'genesis_0_' ||
           (row_number() OVER (ORDER BY a, v) - 1) AS trace_id FROM genesis
    UNION ALL
    SELECT block_number, from_address, to_address, CAST(value AS VARCHAR), trace_type,
           trace_index + CASE WHEN block_number = 0 THEN (SELECT count(*) FROM genesis) ELSE 0 END, status, trace_id FROM traces""")
def special_traces(spark, d):
    alloc = V.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("position"), V.address(F.col("s_suppkey")).alias("address"),
        F.round(F.abs("s_acctbal") * 100).cast("bigint").alias("value"))
    full = calltree.with_special_traces(_traces(spark, d), calltree.special_traces(alloc, "genesis"))
    return tracecalc.finish_traces(full).select(
        "block_number", "from_address", "to_address", F.col("value").cast("string"), "trace_type", "trace_index",
        "status", "trace_id")


# ---------------------------------------------------------------- transfers, contracts, tokens

_TRANSFER_COLUMNS = ["token_address", "from_address", "to_address", "value", "transaction_hash", "log_index", "block_number"]


def _transfers(spark, d):
    return transfers.extract_token_transfers(parse.parse_logs(V.raw_receipts(spark, d)))


@query("extract_token_transfers", views="transfers", sql="""
    SELECT token_address, from_address, to_address, CAST(value AS VARCHAR) AS value, transaction_hash, log_index,
           block_number FROM transfers""")
def extract_token_transfers(spark, d):
    return _transfers(spark, d).select(_TRANSFER_COLUMNS)


@query("token_transfers_of_tokens", views="transfers", sql=f"""
    SELECT token_address, from_address, to_address, CAST(value AS VARCHAR) AS value, transaction_hash, log_index, block_number
    FROM transfers WHERE token_address IN (SELECT {addr('s_suppkey + 1000000')} FROM supplier WHERE s_acctbal > 5000)""")
def token_transfers_of_tokens(spark, d):
    wanted = V.table(spark, d, "supplier").filter("s_acctbal > 5000").select(
        F.upper(V.address(F.col("s_suppkey") + 1000000)).alias("address"))
    logs = parse.parse_logs(V.raw_receipts(spark, d))
    return transfers.extract_token_transfers(logs, wanted).select(_TRANSFER_COLUMNS)


_SELECTED = " || ".join(
    f"CASE WHEN (part // {1 << i}) % 3 <> 1 THEN '0x{s}_' ELSE '' END"
    for i, s in sorted(enumerate(V.SELECTOR_ORDER), key=lambda p: p[1]))
_HAS = [f"((part // {1 << i}) % 3 <> 1)" for i in range(7)]
_FLAGS = f"""{_HAS[0]} AND {_HAS[1]} AND {_HAS[2]} AND {_HAS[3]} AND {_HAS[4]} AND {_HAS[5]} AS is_erc20,
           {_HAS[1]} AND {_HAS[4]} AND {_HAS[6]} AND ({_HAS[2]} OR {_HAS[3]}) AS is_erc721"""


@query("extract_contracts", views="calls", sql=f"""
    , judged AS (SELECT *, max(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY depth) AS dead FROM calls)
    SELECT upper({addr('part + 3000000')}) AS address, k AS block_number, {_CODE} AS bytecode,
           rtrim({_SELECTED}, '_') AS function_sighashes, {_FLAGS}
    FROM judged WHERE linestatus = 'F' AND dead = 0""")
def extract_contracts(spark, d):
    traces = tracecalc.trace_statuses(_traces(spark, d))
    return contracts.extract_contracts(traces).select(
        "address", "block_number", "bytecode", joined("function_sighashes"), "is_erc20", "is_erc721")


@query("classify_addresses", sql=f"""
    SELECT {addr('p_partkey')} AS address, rtrim({_SELECTED.replace('part ', 'p_partkey ')}, '_') AS function_sighashes,
           {_FLAGS.replace('part ', 'p_partkey ')} FROM part""")
def classify_addresses(spark, d):
    part = V.table(spark, d, "part")
    code = part.select(V.address(F.col("p_partkey")).alias("address"), V.bytecode("p_partkey").alias("bytecode"))
    return contracts.classify_addresses(code.select("address"), code).select(
        "address", joined("function_sighashes"), "is_erc20", "is_erc721")


@query("resolve_tokens", sql=f"""
    , flagged AS (SELECT p_partkey AS part, p_name, p_brand, p_size, p_retailprice FROM part),
    t AS (SELECT *, {_FLAGS} FROM flagged)
    SELECT {addr('part')} AS address, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS symbol, p_name AS name,
           CAST(p_size AS BIGINT) AS decimals, CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR) AS total_supply,
           part AS block_number FROM t WHERE is_erc20 OR is_erc721""".replace(", flagged", "WITH flagged", 1))
def resolve_tokens(spark, d):
    """Call results are ABI-encoded: names as dynamic strings, symbols as bytes32 of the upper-case call."""
    part = V.table(spark, d, "part")
    address = V.address(F.col("p_partkey")).alias("address")
    code = part.select(address, V.bytecode("p_partkey").alias("bytecode"), F.col("p_partkey").alias("block_number"))
    size = F.octet_length("p_name")
    body = F.lower(F.hex(F.col("p_name").cast("binary")))
    dynamic = F.concat(V.word(F.lit(32)), F.substring(V.word(size), 3, 64), F.rpad(body, 64, "0"))
    fixed = F.concat(F.lit("0x"), F.rpad(F.lower(F.hex(F.col("p_brand").cast("binary"))), 64, "0"))
    bad = F.lit("0x" + "ff" * 32)
    results = part.select(address, F.explode(F.map_from_arrays(
        F.array(*map(F.lit, ["name()", "symbol()", "SYMBOL()", "DECIMALS()", "totalSupply()"])),
        F.array(dynamic, F.lit("0x"), F.when(F.col("p_size") % 3 == 0, bad).otherwise(fixed), V.word(F.col("p_size")),
                V.word(V.cents("p_retailprice"))))).alias("call", "result"))
    return contracts.resolve_tokens(contracts.classify(code), results)


# ---------------------------------------------------------------- enrichment

_BLOCK_COLUMNS = "b.timestamp AS block_timestamp, b.hash AS block_hash"


def _blocks(spark, d):
    return parse.parse_blocks(V.raw_blocks(spark, d))


@query("enrich_transactions", views="transactions lines", sql=f"""
    SELECT t.hash, t.block_number, t.transaction_index, CAST(t.value AS VARCHAR) AS value, l.qty * 2000 AS receipt_cumulative_gas_used,
           l.qty * 1000 AS receipt_gas_used, CAST(CASE WHEN l.flag = 'R' THEN 0 ELSE 1 END AS BIGINT) AS receipt_status,
           CASE WHEN l.flag = 'A' THEN {addr('l.part + 2000000')} END AS receipt_contract_address
    FROM transactions t JOIN lines l ON l.k = t.block_number AND l.n = t.transaction_index""")
def enrich_transactions(spark, d):
    tx = parse.parse_transactions(V.raw_blocks(spark, d))
    return enrich.enrich_transactions(tx, parse.parse_receipts(V.raw_receipts(spark, d))).select(
        "hash", "block_number", "transaction_index", F.col("value").cast("string"), "receipt_cumulative_gas_used",
        "receipt_gas_used", "receipt_status", "receipt_contract_address")


@query("enrich_join", views="blocks transactions", sql="""
    SELECT t.hash AS tx, t.gas, b.miner AS validator FROM transactions t JOIN blocks b ON b.number = t.block_number""")
def enrich_join(spark, d):
    return enrich.enrich_join(
        V.transactions(spark, d), V.blocks(spark, d), ("block_number", "number"), [("hash", "tx"), "gas"], [("miner", "validator")])


@query("enrich_logs", views="logs blocks", sql=f"""
    SELECT l.log_index, l.transaction_hash, l.address, l.block_number, {_BLOCK_COLUMNS}
    FROM logs l JOIN blocks b ON b.number = l.block_number""")
def enrich_logs(spark, d):
    return enrich.enrich_logs(_blocks(spark, d), parse.parse_logs(V.raw_receipts(spark, d))).select(
        "log_index", "transaction_hash", "address", "block_number", "block_timestamp", "block_hash")


@query("enrich_token_transfers", views="transfers blocks", sql=f"""
    SELECT l.token_address, l.from_address, l.to_address, CAST(l.value AS VARCHAR) AS value, l.log_index, l.block_number, {_BLOCK_COLUMNS}
    FROM transfers l JOIN blocks b ON b.number = l.block_number""")
def enrich_token_transfers(spark, d):
    return enrich.enrich_token_transfers(_blocks(spark, d), _transfers(spark, d)).select(
        "token_address", "from_address", "to_address", "value", "log_index", "block_number", "block_timestamp", "block_hash")


@query("enrich_traces", views="traces blocks", sql=f"""
    SELECT l.trace_id, l.status, l.trace_index, l.block_number, {_BLOCK_COLUMNS}
    FROM traces l JOIN blocks b ON b.number = l.block_number""")
def enrich_traces(spark, d):
    return enrich.enrich_traces(_blocks(spark, d), tracecalc.finish_traces(_traces(spark, d))).select(
        "trace_id", "status", "trace_index", "block_number", "block_timestamp", "block_hash")


@query("enrich_contracts", views="calls blocks", sql=f"""
    , judged AS (SELECT *, max(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY depth) AS dead FROM calls),
    c AS (SELECT k, part, {_FLAGS} FROM judged WHERE linestatus = 'F' AND dead = 0)
    SELECT upper({addr('part + 3000000')}) AS address, c.is_erc20, c.is_erc721, c.k AS block_number, {_BLOCK_COLUMNS}
    FROM c JOIN blocks b ON b.number = c.k""")
def enrich_contracts(spark, d):
    made = contracts.extract_contracts(tracecalc.trace_statuses(_traces(spark, d)))
    return enrich.enrich_contracts(_blocks(spark, d), made).select(
        "address", "is_erc20", "is_erc721", "block_number", "block_timestamp", "block_hash")


@query("enrich_tokens", views="blocks", sql=f"""
    , t AS (SELECT p_partkey AS part, p_name, {_FLAGS.replace('part ', 'p_partkey ')} FROM part)
    SELECT {addr('part')} AS address, p_name AS name, part AS block_number, {_BLOCK_COLUMNS}
    FROM t JOIN blocks b ON b.number = part WHERE is_erc20 OR is_erc721""")
def enrich_tokens(spark, d):
    return enrich.enrich_tokens(_blocks(spark, d), resolve_tokens(spark, d)).select(
        "address", "name", "block_number", "block_timestamp", "block_hash")


@query("enrichment_cardinality", views="transactions blocks logs transfers traces", sql="""
    , pairs AS (
        SELECT 'transactions' AS entity, block_number FROM transactions UNION ALL SELECT 'logs', block_number FROM logs
        UNION ALL SELECT 'token_transfers', block_number FROM transfers UNION ALL SELECT 'traces', block_number FROM traces
        UNION ALL SELECT 'part', CAST(p_partkey * 20 AS BIGINT) FROM part)
    SELECT entity, count(*) AS left_rows, count(b.number) AS joined_rows, count(*) - count(b.number) AS unmatched_rows
    FROM pairs LEFT JOIN blocks b ON b.number = pairs.block_number GROUP BY entity""")
def enrichment_cardinality(spark, d):
    """Every entity against blocks; part keys run past the last block, so some stay unmatched."""
    blocks = V.blocks(spark, d)
    raw = V.raw_receipts(spark, d)
    sides = {
        "transactions": V.transactions(spark, d), "logs": parse.parse_logs(raw),
        "token_transfers": _transfers(spark, d), "traces": _traces(spark, d),
        "part": V.table(spark, d, "part").select((F.col("p_partkey") * 20).alias("block_number")),
    }
    parts = [enrich.cardinality(df, blocks, ("block_number", "number")).withColumn("entity", F.lit(n)) for n, df in sides.items()]
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- ids, timestamps, converters

@query("item_ids", views="blocks transactions transfers traces", sql="""
    SELECT 'block' AS type, 'block_' || hash AS item_id FROM blocks
    UNION ALL SELECT 'transaction', 'transaction_' || hash FROM transactions
    UNION ALL SELECT 'token_transfer', 'token_transfer_' || transaction_hash || '_' || log_index FROM transfers
    UNION ALL SELECT 'trace', 'trace_' || trace_id FROM traces""")
def item_ids(spark, d):
    sides = {
        "block": V.blocks(spark, d), "transaction": V.transactions(spark, d), "token_transfer": _transfers(spark, d),
        "trace": tracecalc.trace_ids(_traces(spark, d)),
    }
    parts = [df.select(F.lit(t).alias("type"), I.item_id(t).alias("item_id")) for t, df in sides.items()]
    return reduce(DataFrame.unionByName, parts)


@query("item_timestamps", views="blocks", sql="""
    SELECT 'block_' || hash AS item_id, strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS item_timestamp
    FROM blocks""")
def item_timestamps(spark, d):
    return I.with_item_fields(V.blocks(spark, d), "block").select("item_id", "item_timestamp")


@query("unix_timestamps_to_text", views="blocks", sql="""
    SELECT number, strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M:%S') AS timestamp FROM blocks""")
def unix_timestamps_to_text(spark, d):
    return I.unix_timestamps_to_text(V.blocks(spark, d).select("number", "timestamp"))


@query("field_converters", views="transactions logs", sql="""
    SELECT l.transaction_hash, CAST(l.log_index AS VARCHAR) AS log_index, CAST(l.block_number AS DOUBLE) AS block_number,
           l.topics[1] AS topic0, l.topics[2] AS topic1, l.topics[3] AS topic2, l.topics[4] AS topic3,
           lower(l.address) AS address FROM logs l""")
def field_converters(spark, d):
    logs = parse.parse_logs(V.raw_receipts(spark, d)).select("transaction_hash", "log_index", "block_number", "topics", "address")
    return I.apply_converters(
        logs, I.integers_to_text(["log_index"]), I.integers_to_decimal, I.list_to_columns("topics", "topic"),
        I.map_fields({"address": F.lower, "block_number": lambda c: c.cast("double")}))


@query("hex_quantities", views="lines", sql="""
    SELECT k, n, CAST(CAST(cents AS HUGEINT) * 4294967296 * 4294967296 + qty AS VARCHAR) AS wide,
           CAST(cents AS HUGEINT) AS narrow FROM lines""".replace("CAST(cents AS HUGEINT) AS narrow", "cents AS narrow"))
def hex_quantities(spark, d):
    wide = F.concat(long_to_hex(F.col("cents")), F.lpad(F.lower(F.hex(F.col("qty"))), 16, "0"))
    return V.lines(spark, d).select(
        "k", "n", hex_to_text(wide).alias("wide"), hex_to_text(V.word(F.col("cents"))).cast("bigint").alias("narrow"))


@query("data_words", views="logs", sql="""
    SELECT transaction_hash, log_index, CAST((length(data) - 2) // 64 AS BIGINT) AS words,
           CASE WHEN length(data) > 2 THEN '0x' || right(data, 40) END AS last_address FROM logs""")
def data_words(spark, d):
    from ..functions.text import split_to_words, word_to_address

    words = split_to_words(F.col("data"))
    return parse.parse_logs(V.raw_receipts(spark, d)).select(
        "transaction_hash", "log_index", F.size(words).cast("bigint").alias("words"),
        word_to_address(F.try_element_at(words, F.lit(-1))).alias("last_address"))


@query("safe_casts", sql="""
    SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, TRY_CAST(event_type AS BIGINT) AS bad,
           value AS number FROM events""")
def safe_casts(spark, d):
    from ..functions.text import to_float_or_null, to_int_or_null

    return V.table(spark, d, "events").select(
        "event_id", to_int_or_null(F.regexp_extract("props", "([0-9]+)", 1)).alias("k"),
        to_int_or_null(F.col("event_type")).alias("bad"), to_float_or_null(F.col("value").cast("string")).alias("number"))


@query("clean_text", sql="""
    SELECT doc_id, replace(text, chr(0), '') AS text FROM documents""")
def clean_text(spark, d):
    from ..functions.text import clean_text as clean

    return V.table(spark, d, "documents").select("doc_id", clean(F.col("text")).alias("text"))


@query("filter_items", views="transactions", sql="SELECT hash, gas FROM transactions WHERE gas > 40000 AND flag <> 'N'")
def filter_items(spark, d):
    from ..operators.items import filter_items as keep

    return keep(V.transactions(spark, d), "gas > 40000 AND flag <> 'N'").select("hash", "gas")


@query("extract_field", views="transactions", sql="SELECT to_address FROM transactions")
def extract_field(spark, d):
    from ..operators.items import extract_field as pick

    return pick(V.transactions(spark, d), "to_address")


@query("distinct_values", views="transactions", sql="SELECT DISTINCT to_address FROM transactions")
def distinct_values(spark, d):
    from ..operators.items import distinct_values as unique

    return unique(V.transactions(spark, d), "to_address")


# ---------------------------------------------------------------- ranges and periods

PERIODS = [("early", 0, 400), ("middle", 400, 900), ("late", 901, 100000000)]
_PERIOD_SQL = "(VALUES ('early', 0, 400), ('middle', 400, 900), ('late', 901, 100000000)) AS p(period, s, e)"


@query("range_scan_transactions", views="transactions blocks", sql="""
    SELECT t.hash, t.block_number, t.transaction_index, CAST(t.value AS VARCHAR) AS value, t.gas, b.timestamp AS block_timestamp
    FROM transactions t JOIN blocks b ON b.number = t.block_number WHERE t.block_number BETWEEN 100 AND 900""")
def range_scan_transactions(spark, d):
    tx = parse.parse_transactions(V.raw_blocks(spark, d))
    return B.range_scan(tx, "transactions", 100, 900).select(
        "hash", "block_number", "transaction_index", F.col("value").cast("string"), "gas", "block_timestamp")


@query("range_scan_traces", views="traces", sql="""
    SELECT block_number, transaction_hash, CAST(value AS VARCHAR) AS value, trace_type, status FROM traces
    WHERE block_number BETWEEN 100 AND 900""")
def range_scan_traces(spark, d):
    return B.range_scan(tracecalc.finish_traces(_traces(spark, d)), "traces", 100, 900).select(
        "block_number", "transaction_hash", F.col("value").cast("string"), "trace_type", "status")


@query("range_scan_blocks", views="blocks", sql="""
    SELECT number, hash, miner, gas_used, timestamp FROM blocks WHERE number BETWEEN 100 AND 900""")
def range_scan_blocks(spark, d):
    return B.range_scan(_blocks(spark, d), "blocks", 100, 900).select("number", "hash", "miner", "gas_used", "timestamp")


@query("range_scan_token_transfers", views="transfers", sql="""
    SELECT token_address, from_address, to_address, CAST(value AS VARCHAR) AS value, transaction_hash, log_index, block_number
    FROM transfers WHERE block_number BETWEEN 100 AND 900""")
def range_scan_token_transfers(spark, d):
    return B.range_scan(_transfers(spark, d), "token_transfers", 100, 900)


@query("extract_period", views="blocks", sql="""
    SELECT 'middle' AS period, number, hash FROM blocks WHERE number BETWEEN 400 AND 900""")
def extract_period(spark, d):
    return B.extract_period(_blocks(spark, d), "blocks", "middle", PERIODS).select("period", "number", "hash")


@query("all_periods", views="transactions", sql=f"""
    SELECT p.period, t.hash, t.block_number FROM transactions t JOIN {_PERIOD_SQL} ON t.block_number BETWEEN p.s AND p.e""")
def all_periods(spark, d):
    return B.assign_periods(V.transactions(spark, d), "block_number", PERIODS).select("period", "hash", "block_number")


@query("collection_stats", views="transactions blocks", sql=f"""
    SELECT p.period, 'transactions' AS table_name, count(*) AS rows, CAST(11 AS BIGINT) AS columns
    FROM transactions t JOIN {_PERIOD_SQL} ON t.block_number BETWEEN p.s AND p.e GROUP BY p.period
    UNION ALL
    SELECT p.period, 'blocks', count(*), CAST(7 AS BIGINT) FROM blocks b JOIN {_PERIOD_SQL} ON b.number BETWEEN p.s AND p.e GROUP BY p.period""")
def collection_stats(spark, d):
    return readers.collection_stats({
        "transactions": B.assign_periods(V.transactions(spark, d), "block_number", PERIODS),
        "blocks": B.assign_periods(V.blocks(spark, d), "number", PERIODS)})


def dated_blocks(spark, d):
    """One block per distinct order date, numbered by date from 1."""
    from ..operators.skew import dense_index

    days = V.table(spark, d, "orders").select(V.seconds("o_orderdate").alias("timestamp")).distinct()
    return dense_index(days, "number", [F.col("timestamp")], {"year": F.floor(F.col("timestamp") / 31536000)}).withColumn(
        "number", F.col("number") + 1)


@query("block_range_for_timestamps", sql="""
    WITH days AS (SELECT DISTINCT CAST(floor(epoch(o_orderdate)) AS BIGINT) AS timestamp FROM orders),
    b AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) AS number FROM days)
    SELECT min(CASE WHEN timestamp >= 852076800 THEN number END) AS start_block,
           max(CASE WHEN timestamp <= 883612800 THEN number END) AS end_block FROM b""")
def block_range_for_timestamps(spark, d):
    return B.block_range_bounds(dated_blocks(spark, d), 852076800, 883612800).select("start_block", "end_block")


# ---------------------------------------------------------------- loading extracted tables

@query("load_transactions", views="transactions blocks", sql="""
    SELECT t.hash, t.from_address, t.to_address, CAST(t.value AS DOUBLE) AS value, CAST(t.gas AS DOUBLE) AS gas,
           CAST(0 AS DOUBLE) AS gas_price, b.timestamp AS block_timestamp
    FROM transactions t JOIN blocks b ON b.number = t.block_number WHERE t.flag <> 'R'""")
def load_transactions(spark, d):
    tx = parse.parse_transactions(V.raw_blocks(spark, d)).withColumns({
        "to_address": F.when(F.col("blob_versioned_hashes").isNull(), F.col("to_address")),
        "block_timestamp": F.replace(I.rfc3339(F.col("block_timestamp")), F.lit("Z"), F.lit("+00:00")),
        "gas_price": F.lit("n/a"),
    })
    return readers.load_transactions(tx).select(
        "hash", "from_address", "to_address", "value", "gas", "gas_price", "block_timestamp")


@query("load_traces", views="traces", sql="""
    SELECT trace_id, from_address, to_address, CAST(value AS DOUBLE) AS value FROM traces
    WHERE trace_type = 'call' AND value > 0 AND from_address IS NOT NULL AND to_address IS NOT NULL""")
def load_traces(spark, d):
    return readers.load_traces(tracecalc.trace_ids(_traces(spark, d))).select("trace_id", "from_address", "to_address", "value")


@query("load_token_transfers", views="transfers", sql="""
    SELECT token_address, from_address, to_address, CAST(value AS DOUBLE) AS value, log_index FROM transfers""")
def load_token_transfers(spark, d):
    return readers.load_token_transfers(_transfers(spark, d)).select("token_address", "from_address", "to_address", "value", "log_index")


@query("load_event_stream", views="transactions blocks traces transfers", sql="""
    SELECT from_address, to_address, CAST(value AS DOUBLE) AS value, CAST(b.timestamp AS DOUBLE) AS timestamp, 'tx' AS edge_type
    FROM transactions t JOIN blocks b ON b.number = t.block_number
    UNION ALL SELECT from_address, to_address, CAST(value AS DOUBLE), CAST(block_number * 14 AS DOUBLE), 'trace' FROM traces
    WHERE trace_type = 'call' AND value > 0 AND from_address IS NOT NULL AND to_address IS NOT NULL
    UNION ALL SELECT from_address, to_address, CAST(value AS DOUBLE), CAST(block_number * 14 AS DOUBLE), 'token_transfer' FROM transfers""")
def load_event_stream(spark, d):
    return readers.load_event_stream({
        "tx": parse.parse_transactions(V.raw_blocks(spark, d)),
        "trace": readers.load_traces(_traces(spark, d)),
        "token_transfer": _transfers(spark, d)})


# ---------------------------------------------------------------- sinks

@query("csv_rows", views="logs", sql="""
    SELECT CAST(log_index AS VARCHAR) AS log_index, transaction_hash, address, array_to_string(topics, ',') AS topics FROM logs""")
def csv_rows(spark, d):
    return files.csv_rows(parse.parse_logs(V.raw_receipts(spark, d)), ["log_index", "transaction_hash", "address", "topics"])


@query("json_rows", views="lines", sql="""
    SELECT k, n, round(CAST(cents AS DOUBLE) / 100, 8) AS price FROM lines""")
def json_rows(spark, d):
    rows = V.lines(spark, d).select("k", "n", (F.col("cents").cast("decimal(18,0)") / 100).alias("price"))
    return files.json_rows(rows)


@query("topic_records", views="blocks transactions", sql="""
    SELECT 'blocks' AS topic, 'block_' || hash AS key FROM blocks
    UNION ALL SELECT 'transactions', 'transaction_' || hash FROM transactions""")
def topic_records(spark, d):
    blocks = files.envelope(V.blocks(spark, d), "block")
    tx = V.transactions(spark, d).withColumn("block_timestamp", F.lit(0))
    items = blocks.unionByName(files.envelope(tx, "transaction")).unionByName(
        blocks.withColumn("type", F.lit("unlisted")))
    return files.topic_records(items).select("topic", "key")


@query("route_by_type", views="blocks transactions", sql="""
    SELECT 'block' AS type, 'block_' || hash AS item_id, CAST(gas_used AS VARCHAR) AS detail FROM blocks
    UNION ALL SELECT 'transaction', 'transaction_' || hash, CAST(gas AS VARCHAR) FROM transactions""")
def route_by_type(spark, d):
    """Every item with its route, and a field of its payload to show that it went whole."""
    items = files.envelope(V.blocks(spark, d), "block").unionByName(
        files.envelope(V.transactions(spark, d).withColumn("block_timestamp", F.lit(0)), "transaction"))
    routed = files.route_by_type(items, ["block", "transaction"])
    fields = {"block": "$.gas_used", "transaction": "$.gas"}
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(kind).alias("type"), "item_id", F.get_json_object("payload", fields[kind]).alias("detail")) for kind, df in routed.items()])


@query("block_bundles", views="blocks transactions logs transfers traces", sql="""
    , tx AS (SELECT block_number, count(*) AS n, string_agg(hash, ',' ORDER BY hash) AS ids FROM transactions GROUP BY block_number),
    lg AS (SELECT block_number, count(*) AS n, sum(log_index) AS s FROM logs GROUP BY block_number),
    tf AS (SELECT block_number, count(*) AS n, sum(value) AS s FROM transfers GROUP BY block_number),
    tr AS (SELECT block_number, count(*) AS n, sum(trace_index) AS s FROM traces GROUP BY block_number)
    SELECT b.number AS block_number, b.hash, coalesce(tx.n, 0) AS transactions, coalesce(lg.n, 0) AS logs, coalesce(tf.n, 0) AS token_transfers, coalesce(tr.n, 0) AS traces,
           coalesce(tx.ids, '') AS transaction_hashes, CAST(coalesce(lg.s, 0) AS BIGINT) AS log_indices, CAST(coalesce(tf.s, 0) AS BIGINT) AS transferred, CAST(coalesce(tr.s, 0) AS BIGINT) AS trace_indices
    FROM blocks b LEFT JOIN tx ON tx.block_number = b.number LEFT JOIN lg ON lg.block_number = b.number
    LEFT JOIN tf ON tf.block_number = b.number LEFT JOIN tr ON tr.block_number = b.number""")
def block_bundles(spark, d):
    """Bundles of every block: sizes of the arrays, and what their elements carry. Receipts are parsed once, for logs and transfers."""
    logs = staged(parse.parse_logs(V.raw_receipts(spark, d)))
    bundles = files.block_bundles(V.blocks(spark, d), {
        "transactions": V.transactions(spark, d), "logs": logs, "token_transfers": transfers.extract_token_transfers(logs), "traces": _traces(spark, d)})
    total = lambda array, field: F.aggregate(F.transform(array, lambda x: x[field].cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return bundles.select(
        "block_number", F.col("block.hash").alias("hash"), *[F.size(c).cast("bigint").alias(c) for c in files.CHILDREN],
        F.array_join(F.array_sort(F.transform("transactions", lambda x: x["hash"])), ",").alias("transaction_hashes"),
        total("logs", "log_index").alias("log_indices"), total("token_transfers", "value").alias("transferred"),
        total("traces", "trace_index").alias("trace_indices"))


@query("upsert_latest", sql="""
    SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id""")
def upsert_latest(spark, d):
    rows = V.table(spark, d, "events").select("user_id", "event_type", "event_id")
    return files.latest_rows(rows.withColumn("_v", F.col("event_id")), ["user_id"], "_v").drop("_v")


@query("upsert_table", sql="""
    SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id""")
def upsert_table(spark, d):
    """The latest event of every user, merged in twelve batches with compaction on the way, two of them sent twice."""
    rows = V.table(spark, d, "events").select("user_id", "event_type", "event_id")
    table = KeyedTable(spark, f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}", ["user_id"], buckets=4, compact_every=5)
    last = rows.agg(F.max("event_id")).first()[0]
    for batch in [*range(12), 11, 3]:
        part = rows.filter(F.floor(F.col("event_id") * 12 / F.lit(last + 1)) == batch)
        table.upsert(files.latest_rows(part.withColumn("_v", F.col("event_id")), ["user_id"], "_v").drop("_v"), batch)
    return table.read()


@query("block_partitions", views="blocks", sql="""
    SELECT number, lpad(CAST(number // 1000 * 1000 AS VARCHAR), 8, '0') AS start_block,
           lpad(CAST(least(number // 1000 * 1000 + 999, (SELECT max(number) FROM blocks)) AS VARCHAR), 8, '0') AS end_block
    FROM blocks""")
def block_partitions(spark, d):
    blocks = V.blocks(spark, d)
    last = blocks.agg(F.max("number")).first()[0]
    return files.block_partitions(blocks, "number", 0, last, 1000).select("number", "start_block", "end_block")


@query("date_partition", views="blocks", sql="""
    SELECT number, strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d') AS date FROM blocks""")
def date_partition(spark, d):
    return files.date_partition(V.blocks(spark, d), "timestamp").select("number", F.col("date").cast("string").alias("date"))


@query("export_all", views="blocks transactions lines logs transfers traces", sql=f"""
    SELECT 'blocks' AS entity, hash AS id FROM blocks UNION ALL SELECT 'transactions', hash FROM transactions
    UNION ALL SELECT 'receipts', hash FROM transactions UNION ALL SELECT 'logs', transaction_hash || '_' || log_index FROM logs
    UNION ALL SELECT 'token_transfers', transaction_hash || '_' || log_index FROM transfers
    UNION ALL SELECT DISTINCT 'contracts', {addr('l.part + 2000000')} FROM lines l JOIN part p ON p.p_partkey = l.part WHERE l.flag = 'A'
    UNION ALL SELECT DISTINCT 'tokens', token_address FROM transfers
    UNION ALL SELECT 'traces', trace_id FROM traces""")
def export_all(spark, d):
    from ..sinks.export_all import export_all as run

    part = V.table(spark, d, "part")
    code = part.select(V.address(F.col("p_partkey") + 2000000).alias("address"), V.bytecode("p_partkey").alias("bytecode"))
    answers = V.table(spark, d, "supplier").select(
        V.address(F.col("s_suppkey") + 1000000).alias("address"), F.lit("decimals()").alias("call"),
        V.word(F.lit(18)).alias("result"))
    tables = run(V.raw_blocks(spark, d), V.raw_receipts(spark, d), code, answers, V.raw_traces(spark, d))
    ids = {"blocks": "hash", "transactions": "hash", "receipts": "transaction_hash", "contracts": "address", "tokens": "address", "traces": "trace_id"}
    position = F.concat_ws("_", "transaction_hash", F.col("log_index").cast("string"))
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(name).alias("entity"), (F.col(ids[name]) if name in ids else position).alias("id")) for name, df in tables.items()])


# ---------------------------------------------------------------- marketplace

def _listing_logs(spark, d):
    """One listing event per order: status decides contract and epoch, the customer the content."""
    from ..operators import market as M

    old = F.col("o_orderstatus") == "F"
    v0, v1 = M.MARKET_V0, M.MARKET_V1
    return V.table(spark, d, "orders").select(
        F.lit(0).cast("bigint").alias("log_index"), F.lit("0x").alias("transaction_hash"),
        F.when(old, F.lit(v0[1].upper().replace("0X", "0x"))).otherwise(F.lit(v1[1])).alias("address"),
        V.word(F.col("o_custkey")).alias("data"),
        F.array(F.lit(M.LISTING_TOPICS[0]), F.lit("0x0"), V.word(F.col("o_orderkey"))).alias("topics"),
        # Status P announces a version-1 listing before that version's epoch: it is ignored.
        (F.when(F.col("o_orderstatus") == "O", F.lit(v1[2])).otherwise(F.lit(v0[2])) + F.col("o_orderkey")).cast("bigint").alias("block_number"))


def _shop_documents(spark, d):
    """Listing, shop page, product list and product detail for every document row."""
    from ..functions.hexnum import content_hash

    docs = V.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    key = F.col("doc_id").cast("string")
    shop = F.concat(F.lit("S"), key)
    variants = F.array(*[F.struct(F.lit(i).alias("id"), F.concat("lang", F.lit(str(i))).alias("title"), (F.col("n_chars") + i).alias("price")) for i in (1, 2)])
    rows = F.array(
        F.struct(content_hash(V.word(F.col("doc_id"))).alias("path"), F.to_json(F.struct(
            F.col("source").alias("title"), F.col("lang").alias("category"), shop.alias("shopIpfsHash"),
            F.struct(F.col("n_chars").alias("amount"), F.lit("ETH").alias("currency")).alias("price"))).alias("body")),
        F.struct(F.concat(shop, F.lit("/index.html")).alias("path"), F.lit('<link rel="data-dir" href="data"/>').alias("body")),
        F.struct(F.concat(shop, F.lit("/data/products.json")).alias("path"), F.lit('[{"id":"p"},{"title":"no id"}]').alias("body")),
        F.struct(F.concat(shop, F.lit("/data/p/data.json")).alias("path"), F.to_json(F.struct(
            key.alias("externalId"), F.col("source").alias("title"), F.col("n_chars").alias("price"), variants.alias("variants"))).alias("body")),
    )
    return docs.select(F.inline(rows))


_LISTED = """WITH listed AS (SELECT '1-' || CASE o_orderstatus WHEN 'F' THEN '000' ELSE '001' END || '-' || o_orderkey AS listing_id,
    o_orderkey + CASE o_orderstatus WHEN 'O' THEN 8582597 ELSE 6436157 END AS block_number, d.*
    FROM orders JOIN documents d ON d.doc_id = o_custkey WHERE o_orderstatus <> 'P')"""


@query("marketplace_listings", sql=_LISTED + """
    SELECT listing_id, '' AS listing_type, lang AS category, source AS title, CAST(n_chars AS VARCHAR) AS price, 'ETH' AS currency, block_number FROM listed""")
def marketplace_listings(spark, d):
    from ..operators import market as M

    return M.marketplace_listings(_listing_logs(spark, d), _shop_documents(spark, d)).select(
        "listing_id", "listing_type", "category", "title", "price", "currency", "block_number")


@query("shop_products", sql=_LISTED + """
    SELECT listing_id || '-p' AS product_id, 'S' || doc_id || '/data/p' AS ipfs_path, CAST(doc_id AS VARCHAR) AS external_id,
           CAST(NULL AS VARCHAR) AS parent_external_id, source AS title, n_chars AS price, 'fiat-USD' AS currency FROM listed
    UNION ALL SELECT listing_id || '-' || i, 'S' || doc_id || '/data/p', NULL, CAST(doc_id AS VARCHAR), lang || i, n_chars + i, 'fiat-USD'
    FROM listed, (VALUES (1), (2)) v(i)""")
def shop_products(spark, d):
    from ..operators import market as M

    return M.shop_products(_listing_logs(spark, d), _shop_documents(spark, d)).select(
        "product_id", "ipfs_path", "external_id", "parent_external_id", "title", "price", "currency")
