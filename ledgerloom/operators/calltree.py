"""Nested call frames to flat traces, and traces added by protocol rules."""

from __future__ import annotations

from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frames
from ..functions.hexnum import hex_to_decimal, hex_to_long
from ..functions.text import normalize_address


def flatten_call_frames(raw: DataFrame, body: str = "body") -> DataFrame:
    """Flatten geth-style nested frames, one block per input line.

    One pass: every line is parsed once and its trees are walked with a stack, which sends out flat
    frames only; fields are converted by column expressions. ``trace_address`` is the path of
    child positions, so ordering by it gives depth-first order.
    """
    # Sent by value, so workers need no installed package.
    cloudpickle.register_pickle_by_value(frames)
    f = raw.select(body).mapInArrow(frames.walk, frames.SCHEMA)
    kind = F.lower(F.col("type"))
    is_call = kind.isin("call", "callcode", "delegatecall", "staticcall")
    return f.select(
        "block_number",
        F.lit(None).cast("string").alias("transaction_hash"),
        "transaction_index",
        normalize_address(F.col("from")).alias("from_address"),
        normalize_address(F.col("to")).alias("to_address"),
        hex_to_decimal(F.col("value")).alias("value"),
        "input",
        "output",
        F.when(kind == "selfdestruct", F.lit("suicide")).when(is_call, F.lit("call")).otherwise(kind).alias("trace_type"),
        F.when(is_call, kind).alias("call_type"),
        F.lit(None).cast("string").alias("reward_type"),
        hex_to_long(F.col("gas")).alias("gas"),
        hex_to_long(F.col("gasUsed")).alias("gas_used"),
        "subtraces",
        "trace_address",
        "error",
    )


# Fixed values of the public chain history: the block of the balance-moving fork and
# the contract that received the balances.
FORK_BLOCK = 1920000
FORK_RECEIVER = "0xbf4ed7b27f1d666546e30d74d50d173d20bca754"


def special_traces(allocation: DataFrame, kind: str) -> DataFrame:
    """Traces that no transaction produced.

    ``kind='genesis'`` reads ``(position, address, value)`` rows of the initial
    allocation; ``kind='daofork'`` reads ``(position, from_address, value)`` rows of
    the fork's state changes, all paid to the fixed receiver.
    """
    if kind == "genesis":
        block, sender, receiver = 0, F.lit(None).cast("string"), F.col("address")
    elif kind == "daofork":
        block, sender, receiver = FORK_BLOCK, F.col("from_address"), F.lit(FORK_RECEIVER)
    else:
        raise ValueError(f"unknown special trace kind {kind}")
    text = F.lit(None).cast("string")
    number = F.lit(None).cast("bigint")
    return allocation.select(
        F.lit(block).cast("bigint").alias("block_number"),
        text.alias("transaction_hash"),
        number.alias("transaction_index"),
        sender.alias("from_address"),
        receiver.alias("to_address"),
        F.col("value").cast("decimal(38,0)").alias("value"),
        text.alias("input"),
        text.alias("output"),
        F.lit(kind).alias("trace_type"),
        text.alias("call_type"),
        text.alias("reward_type"),
        number.alias("gas"),
        number.alias("gas_used"),
        number.alias("subtraces"),
        F.lit(None).cast("array<int>").alias("trace_address"),
        text.alias("error"),
        F.col("position").cast("bigint").alias("trace_index"),
    )


def with_special_traces(traces: DataFrame, *specials: DataFrame) -> DataFrame:
    """Put special traces ahead of the block's own and shift the latter's index."""
    extra = reduce(DataFrame.unionByName, specials)
    counts = extra.groupBy("block_number").agg(F.count("*").alias("_shift"))
    shifted = traces.join(counts, "block_number", "left").withColumn(
        "trace_index", F.col("trace_index") + F.coalesce("_shift", F.lit(0))
    ).drop("_shift")
    return extra.unionByName(shifted)
