"""Raw node responses to clean entity rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.hexnum import hex_to_decimal, hex_to_long
from ..functions.text import normalize_address, split_topics, to_float_or_null, to_int_or_null


def _fields(source: str, names: dict[str, str], how=lambda c: c) -> list[Column]:
    return [how(F.col(f"{source}.{raw}")).alias(clean) for raw, clean in names.items()]


def _entries(df: DataFrame, array: str | Column, *kept: str | Column) -> DataFrame:
    """``kept`` columns with ``pos`` and ``entry``, one row per element of ``array``.

    A plain explode makes the optimizer test the array's size first, and that filter moves below the
    projection that parses, so every text would be built and parsed again for it. The outer form does not.
    """
    return df.select(*kept, F.posexplode_outer(array).alias("pos", "entry")).filter("pos IS NOT NULL")


def _parsed(body: str, schema: str) -> Column:
    """``body`` parsed as JSON; an empty text has no value, as with the parser.

    The parser has no generated code, and what is merged into its argument runs without it as well. A text that is used twice
    is not merged, so an expression that makes it keeps its generated code and is evaluated once.
    """
    return F.when(F.length(body) > 0, F.from_json(body, schema))


def _opened(raw: DataFrame, value: Column, name: str) -> DataFrame:
    """``value`` as the only column, given out by a generator, which no filter passes.

    Conditions on a field, those that a join infers from its other side too, would otherwise move below
    the projection that parses, and each field in them would build and parse the text again.
    """
    return raw.select(F.explode_outer(F.array(value)).alias(name))


def open_blocks(raw: DataFrame, body: str = "body") -> DataFrame:
    """Block responses as one struct ``b``; what is made of it twice is read once."""
    return _opened(raw, _parsed(body, S.RAW_BLOCK), "b")


def open_receipts(raw: DataFrame, body: str = "body") -> DataFrame:
    """Receipt responses as one struct ``r``."""
    return _opened(raw, _parsed(body, S.RAW_RECEIPT), "r")


def parse_withdrawals(col: Column) -> Column:
    return F.transform(
        col,
        lambda w: F.struct(
            hex_to_long(w["index"]).alias("index"),
            hex_to_long(w["validatorIndex"]).alias("validator_index"),
            w["address"].alias("address"),
            hex_to_long(w["amount"]).alias("amount"),
        ),
    )


def parse_blocks(raw: DataFrame, body: str = "body") -> DataFrame:
    """One row per block. ``transaction_count`` includes entries that are bare hashes."""
    return blocks_of(open_blocks(raw, body))


def blocks_of(opened: DataFrame) -> DataFrame:
    b = "b"
    return opened.select(
        hex_to_long(F.col("b.number")).alias("number"),
        *_fields(b, {
            "hash": "hash", "parentHash": "parent_hash", "nonce": "nonce",
            "sha3Uncles": "sha3_uncles", "logsBloom": "logs_bloom",
            "transactionsRoot": "transactions_root", "stateRoot": "state_root",
            "receiptsRoot": "receipts_root",
        }),
        normalize_address(F.col("b.miner")).alias("miner"),
        *_fields(b, {"difficulty": "difficulty", "totalDifficulty": "total_difficulty"}, hex_to_decimal),
        hex_to_long(F.col("b.size")).alias("size"),
        F.col("b.extraData").alias("extra_data"),
        *_fields(b, {"gasLimit": "gas_limit", "gasUsed": "gas_used", "timestamp": "timestamp"}, hex_to_long),
        F.when(F.col("b.transactions").isNotNull(), F.size("b.transactions")).cast("bigint").alias("transaction_count"),
        hex_to_long(F.col("b.baseFeePerGas")).alias("base_fee_per_gas"),
        F.col("b.withdrawalsRoot").alias("withdrawals_root"),
        parse_withdrawals(F.col("b.withdrawals")).alias("withdrawals"),
        *_fields(b, {"blobGasUsed": "blob_gas_used", "excessBlobGas": "excess_blob_gas"}, hex_to_long),
    )


def parse_transactions(raw: DataFrame, body: str = "body") -> DataFrame:
    """One row per full transaction object; bare hashes are skipped."""
    return transactions_of(open_blocks(raw, body))


def transactions_of(opened: DataFrame) -> DataFrame:
    entries = _entries(opened, "b.transactions", hex_to_long(F.col("b.timestamp")).alias("block_timestamp"))
    # Given out by a generator, which no filter passes: a condition on a field would parse the entry again.
    tx = entries.filter(F.col("entry").startswith("{")).select(
        "block_timestamp", F.explode_outer(F.array(F.from_json("entry", S.RAW_TRANSACTION))).alias("x")
    )
    return tx.select(
        F.col("x.hash").alias("hash"),
        hex_to_long(F.col("x.nonce")).alias("nonce"),
        F.col("x.blockHash").alias("block_hash"),
        *_fields("x", {"blockNumber": "block_number", "transactionIndex": "transaction_index"}, hex_to_long),
        *_fields("x", {"from": "from_address", "to": "to_address"}, normalize_address),
        hex_to_decimal(F.col("x.value")).alias("value"),
        *_fields("x", {"gas": "gas", "gasPrice": "gas_price"}, hex_to_long),
        F.col("x.input").alias("input"),
        "block_timestamp",
        *_fields("x", {
            "maxFeePerGas": "max_fee_per_gas", "maxPriorityFeePerGas": "max_priority_fee_per_gas",
            "type": "transaction_type", "maxFeePerBlobGas": "max_fee_per_blob_gas",
        }, hex_to_long),
        F.col("x.blobVersionedHashes").alias("blob_versioned_hashes"),
    )


def parse_receipts(raw: DataFrame, body: str = "body") -> DataFrame:
    return receipts_of(open_receipts(raw, body))


def receipts_of(opened: DataFrame) -> DataFrame:
    return opened.select(
        F.col("r.transactionHash").alias("transaction_hash"),
        hex_to_long(F.col("r.transactionIndex")).alias("transaction_index"),
        F.col("r.blockHash").alias("block_hash"),
        *_fields("r", {
            "blockNumber": "block_number", "cumulativeGasUsed": "cumulative_gas_used",
            "gasUsed": "gas_used",
        }, hex_to_long),
        normalize_address(F.col("r.contractAddress")).alias("contract_address"),
        F.col("r.root").alias("root"),
        *_fields("r", {
            "status": "status", "effectiveGasPrice": "effective_gas_price", "l1Fee": "l1_fee",
            "l1GasUsed": "l1_gas_used", "l1GasPrice": "l1_gas_price",
        }, hex_to_long),
        to_float_or_null(F.col("r.l1FeeScalar")).alias("l1_fee_scalar"),
        *_fields("r", {"blobGasPrice": "blob_gas_price", "blobGasUsed": "blob_gas_used"}, hex_to_long),
    )


def parse_logs(raw: DataFrame, body: str = "body") -> DataFrame:
    """Logs of raw receipts; the emitting address keeps its letter case."""
    return logs_of(open_receipts(raw, body))


def logs_of(opened: DataFrame) -> DataFrame:
    entries = _entries(opened, "r.logs").select(F.col("entry").alias("g"))
    return entries.select(
        hex_to_long(F.col("g.logIndex")).alias("log_index"),
        F.col("g.transactionHash").alias("transaction_hash"),
        hex_to_long(F.col("g.transactionIndex")).alias("transaction_index"),
        F.col("g.blockHash").alias("block_hash"),
        hex_to_long(F.col("g.blockNumber")).alias("block_number"),
        *_fields("g", {"address": "address", "data": "data", "topics": "topics"}),
    )


def reparse_logs(rows: DataFrame) -> DataFrame:
    """Logs read back from flat text, where topics are one comma-joined string."""
    return rows.select(
        to_int_or_null(F.col("log_index")).alias("log_index"),
        "transaction_hash",
        to_int_or_null(F.col("transaction_index")).alias("transaction_index"),
        "block_hash",
        to_int_or_null(F.col("block_number")).alias("block_number"),
        "address",
        "data",
        split_topics(F.col("topics")).alias("topics"),
    )


def parse_traces(raw: DataFrame, body: str = "body") -> DataFrame:
    """Per-block trace arrays to rows; ``trace_index`` is the position in the block."""
    rows = _entries(raw, _parsed(body, f"array<{S.RAW_TRACE}>")).withColumnRenamed("entry", "x")
    kind = F.col("x.type")
    moves = kind.isin("call", "create")
    action, result = F.col("x.action"), F.col("x.result")
    return rows.select(
        F.col("x.blockNumber").alias("block_number"),
        F.col("x.transactionHash").alias("transaction_hash"),
        F.col("x.transactionPosition").alias("transaction_index"),
        F.when(moves, normalize_address(action["from"]))
        .when(kind == "suicide", normalize_address(action["address"])).alias("from_address"),
        F.when(kind == "call", normalize_address(action["to"]))
        .when(kind == "create", result["address"])
        .when(kind == "suicide", normalize_address(action["refundAddress"]))
        .when(kind == "reward", normalize_address(action["author"])).alias("to_address"),
        F.when(moves | (kind == "reward"), hex_to_decimal(action["value"]))
        .when(kind == "suicide", hex_to_decimal(action["balance"])).alias("value"),
        F.when(kind == "call", action["input"]).when(kind == "create", action["init"]).alias("input"),
        F.when(kind == "call", result["output"]).when(kind == "create", result["code"]).alias("output"),
        kind.alias("trace_type"),
        F.when(kind == "call", action["callType"]).alias("call_type"),
        F.when(kind == "reward", action["rewardType"]).alias("reward_type"),
        F.when(moves, hex_to_long(action["gas"])).alias("gas"),
        F.when(moves, hex_to_long(result["gasUsed"])).alias("gas_used"),
        F.col("x.subtraces").alias("subtraces"),
        F.coalesce(F.col("x.traceAddress"), F.array().cast("array<int>")).alias("trace_address"),
        F.when(F.col("x.error") != "", F.col("x.error")).alias("error"),
        F.col("pos").cast("bigint").alias("trace_index"),
    )
