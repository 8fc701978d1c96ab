"""Token transfers from event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hexnum import hex_to_text
from ..functions.text import normalize_address, split_to_words, word_to_address

# Fixed value: topic of the Transfer(address,address,uint256) event.
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"


def extract_token_transfers(logs: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Transfer events as rows; indexed and unindexed arguments both count.

    Topics and data words together must number exactly four. ``tokens(address)``
    optionally restricts the result to some token contracts; it is matched on the
    lower-case address and its join strategy is left to the optimizer.
    """
    words = F.concat("topics", split_to_words(F.col("data")))
    # Words are given out by a generator, which no filter passes: the test of their number would split the data again.
    rows = (
        logs.filter(F.lower(F.get("topics", F.lit(0))) == TRANSFER_TOPIC)
        .select("address", "transaction_hash", "log_index", "block_number", F.explode_outer(F.array(words)).alias("_w"))
        .filter(F.size("_w") == 4)
    )
    arg = lambda i: F.get("_w", F.lit(i))
    out = rows.select(
        normalize_address(F.col("address")).alias("token_address"),
        word_to_address(arg(1)).alias("from_address"),
        word_to_address(arg(2)).alias("to_address"),
        hex_to_text(arg(3)).alias("value"),
        "transaction_hash",
        "log_index",
        "block_number",
    ).withColumn("value_dec", F.col("value").try_cast("decimal(38,0)"))
    if tokens is not None:
        wanted = tokens.select(normalize_address(F.col("address")).alias("token_address")).distinct()
        out = out.join(wanted, "token_address", "left_semi")
    return out
