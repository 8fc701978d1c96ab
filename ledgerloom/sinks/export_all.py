"""The whole chain export as one application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.calltree import with_special_traces
from ..operators.contracts import classify_addresses, resolve_tokens
from ..operators.enrich import require_same_cardinality
from ..operators.parse import blocks_of, logs_of, open_blocks, open_receipts, parse_traces, receipts_of, transactions_of
from ..operators.tracecalc import finish_traces, require_parents
from ..operators.transfers import extract_token_transfers
from ..session import staged


def export_all(raw_blocks: DataFrame, raw_receipts: DataFrame, code: DataFrame, call_results: DataFrame,
               raw_traces: DataFrame | None = None, specials: Sequence[DataFrame] = ()) -> dict[str, DataFrame]:
    """Every entity table from raw responses. Each raw table is parsed once, and it and its tables are kept in the shared folder.

    Raises when a transaction has no receipt or several, when its block is missing, or that of a log or transfer. Receipts are limited to the exported
    transactions, contracts to the distinct addresses that receipts created, tokens to the distinct addresses in transfers.
    With ``raw_traces`` there are traces too, ``specials`` (initial balances, moves of the fork) ahead of those of their block.
    """
    opened = staged(open_blocks(raw_blocks))
    blocks, transactions = staged(blocks_of(opened)), staged(transactions_of(opened))
    require_same_cardinality(transactions, blocks, ("block_number", "number"), "transactions")
    hashes = transactions.select(F.col("hash").alias("transaction_hash")).distinct()
    # Receipts of other transactions are rare, so whole receipts are shuffled only when their hashes say that there are some.
    answers = staged(open_receipts(raw_receipts))
    strange = answers.select(F.col("r.transactionHash").alias("transaction_hash")).join(hashes.hint("merge"), "transaction_hash", "left_anti")
    if not strange.isEmpty():
        answers = staged(answers.join(hashes.hint("merge"), F.col("r.transactionHash") == hashes["transaction_hash"], "left_semi"))
    receipts, logs = staged(receipts_of(answers)), staged(logs_of(answers))
    require_same_cardinality(transactions, receipts, ("hash", "transaction_hash"), "transactions")
    require_same_cardinality(logs, blocks, ("block_number", "number"), "logs")
    transfers = staged(extract_token_transfers(logs))
    require_same_cardinality(transfers, blocks, ("block_number", "number"), "token transfers")
    created = receipts.filter(F.col("contract_address") != "").select(F.col("contract_address").alias("address")).distinct()
    contracts = classify_addresses(created, code)
    token_addresses = transfers.select(F.col("token_address").alias("address")).distinct().select(
        "address", F.lit(True).alias("is_erc20"), F.lit(False).alias("is_erc721"),
        F.lit(None).cast("bigint").alias("block_number"),
    )
    tokens = resolve_tokens(token_addresses, call_results)
    out = {
        "blocks": blocks, "transactions": transactions, "receipts": receipts, "logs": logs,
        "token_transfers": transfers, "contracts": contracts, "tokens": tokens,
    }
    if raw_traces is not None:
        traces = staged(parse_traces(raw_traces))
        own = finish_traces(require_parents(traces))
        # The rank in a block is that of all its traces; ids and statuses are those of each trace.
        kept = [f for f in own.columns if f not in ("trace_id", "status")]
        out["traces"] = staged(with_special_traces(own, *[finish_traces(s.select(*kept)) for s in specials]) if specials else own)
    return out
