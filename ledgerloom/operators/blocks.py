"""Block ranges: fixed scans, named periods and ranges by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged

# Projection and order of the four range scans.
RANGE_SCANS = {
    "transactions": (
        ["hash", "nonce", "block_hash", "block_number", "transaction_index", "from_address",
         "to_address", "value", "gas", "gas_price", "input", "block_timestamp"],
        "block_number", ["block_number", "transaction_index"]),
    "traces": (
        ["block_number", "transaction_hash", "transaction_index", "from_address", "to_address",
         "value", "trace_type", "call_type", "reward_type", "gas", "gas_used", "subtraces",
         "trace_address", "error", "status"],
        "block_number", ["block_number", "transaction_index"]),
    "blocks": (
        ["number", "hash", "parent_hash", "nonce", "miner", "difficulty", "total_difficulty",
         "size", "gas_limit", "gas_used", "timestamp", "transaction_count"],
        "number", ["number"]),
    "token_transfers": (
        ["token_address", "from_address", "to_address", "value", "transaction_hash", "log_index",
         "block_number"],
        "block_number", ["block_number", "log_index"]),
}
# Named periods of the studied chain, inclusive at both ends.
PERIODS = [
    ("dao_hack", 1917000, 1925000),
    ("pre_dao", 1800000, 1917000),
    ("post_fork", 1925000, 2500000),
    ("attack_51_v1", 7200000, 7300000),
    ("attack_51_v2", 10900000, 11000000),
    ("normal_ops", 5000000, 6000000),
]


def range_scan(df: DataFrame, table: str, start: int, end: int, ordered: bool = True) -> DataFrame:
    """Inclusive block range with the table's fixed projection and order.

    A sort samples its input first, so the rows of the range are kept in the shared folder and not computed twice.
    """
    columns, key, order = RANGE_SCANS[table]
    rows = df.filter(F.col(key).between(start, end)).select(*columns)
    return staged(rows).orderBy(*order) if ordered else rows


def periods_table(spark: SparkSession, periods=PERIODS) -> DataFrame:
    return spark.createDataFrame(periods, "period string, start_block bigint, end_block bigint")


def assign_periods(df: DataFrame, key: str, periods=PERIODS) -> DataFrame:
    """One row per period a block lies in; periods may share their end blocks.

    The period list is a handful of literals, so membership is computed in the
    projection and no join is needed.
    """
    names = [F.when(F.col(key).between(s, e), F.lit(n)) for n, s, e in periods]
    return df.withColumn("period", F.explode(F.array_compact(F.array(*names))))


def extract_period(df: DataFrame, table: str, name: str, periods=PERIODS) -> DataFrame:
    for period, start, end in periods:
        if period == name:
            return range_scan(df, table, start, end).withColumn("period", F.lit(name))
    raise ValueError(f"unknown period {name}")


def block_range_bounds(blocks: DataFrame, start: int, end: int) -> DataFrame:
    """One row with the first block at or after ``start`` and the last at or before ``end``.

    The genesis block carries timestamp 0 and takes no part in the search.
    """
    real = blocks.filter("number >= 1")
    t = F.col("timestamp")
    return real.agg(
        F.min(F.when(t >= start, F.col("number"))).alias("start_block"),
        F.max(F.when(t <= end, F.col("number"))).alias("end_block"),
        F.min(t).alias("first_time"),
        F.max(t).alias("last_time"),
    )


def block_range_for_timestamps(blocks: DataFrame, start: int, end: int) -> tuple[int, int]:
    """Block range covering a time range, with the edge rules of a date export.

    A start outside the chain's times means block 0, as does first block 1. An end
    outside them is an error, and so is a range between two neighbouring blocks.
    """
    if start > end:
        raise ValueError("start_timestamp must not be after end_timestamp")
    row = block_range_bounds(blocks, start, end).first()
    low, high = row["first_time"], row["last_time"]
    if low is None or not low <= end <= high:
        raise ValueError("the existing blocks do not completely cover the given time range")
    first = row["start_block"] if low <= start <= high else 0
    if first > row["end_block"]:
        raise ValueError("the given timestamp range does not cover any blocks")
    return (0 if first == 1 else first), row["end_block"]


def block_range_for_date(blocks: DataFrame, date: str) -> tuple[int, int]:
    spark = blocks.sparkSession
    start = spark.range(1).select(F.unix_date(F.lit(date).cast("date")) * 86400).first()[0]
    return block_range_for_timestamps(blocks, start, start + 86399)
