"""Explicit schemas of raw node responses and clean entity tables."""

from __future__ import annotations

# Raw responses: every quantity is hex text.
RAW_TRANSACTION = (
    "hash string, nonce string, blockHash string, blockNumber string, transactionIndex string, "
    "`from` string, `to` string, value string, gas string, gasPrice string, input string, "
    "maxFeePerGas string, maxPriorityFeePerGas string, type string, maxFeePerBlobGas string, "
    "blobVersionedHashes array<string>"
)
RAW_WITHDRAWAL = "index string, validatorIndex string, address string, amount string"
RAW_BLOCK = (
    "number string, hash string, parentHash string, nonce string, sha3Uncles string, "
    "logsBloom string, transactionsRoot string, stateRoot string, receiptsRoot string, "
    "miner string, difficulty string, totalDifficulty string, size string, extraData string, "
    "gasLimit string, gasUsed string, timestamp string, baseFeePerGas string, "
    "withdrawalsRoot string, blobGasUsed string, excessBlobGas string, "
    f"transactions array<string>, withdrawals array<struct<{RAW_WITHDRAWAL.replace(' string', ':string')}>>"
)
RAW_LOG = (
    "logIndex:string, transactionHash:string, transactionIndex:string, blockHash:string, "
    "blockNumber:string, address:string, data:string, topics:array<string>"
)
RAW_RECEIPT = (
    "transactionHash string, transactionIndex string, blockHash string, blockNumber string, "
    "cumulativeGasUsed string, gasUsed string, contractAddress string, root string, status string, "
    "effectiveGasPrice string, l1Fee string, l1GasUsed string, l1GasPrice string, "
    "l1FeeScalar string, blobGasPrice string, blobGasUsed string, "
    f"logs array<struct<{RAW_LOG}>>"
)
RAW_TRACE = (
    "struct<action:struct<callType:string,`from`:string,`to`:string,gas:string,input:string,"
    "init:string,value:string,address:string,refundAddress:string,balance:string,author:string,"
    "rewardType:string>,blockHash:string,blockNumber:bigint,error:string,"
    "result:struct<gasUsed:string,output:string,address:string,code:string>,subtraces:bigint,"
    "traceAddress:array<int>,transactionHash:string,transactionPosition:bigint,type:string>"
)
# Clean entity tables.
BLOCKS = (
    "number bigint, hash string, parent_hash string, nonce string, sha3_uncles string, "
    "logs_bloom string, transactions_root string, state_root string, receipts_root string, "
    "miner string, difficulty decimal(38,0), total_difficulty decimal(38,0), size bigint, "
    "extra_data string, gas_limit bigint, gas_used bigint, timestamp bigint, "
    "transaction_count bigint, base_fee_per_gas bigint, withdrawals_root string, "
    "withdrawals array<struct<index:bigint,validator_index:bigint,address:string,amount:bigint>>, "
    "blob_gas_used bigint, excess_blob_gas bigint"
)
TRANSACTIONS = (
    "hash string, nonce bigint, block_hash string, block_number bigint, "
    "transaction_index bigint, from_address string, to_address string, value decimal(38,0), "
    "gas bigint, gas_price bigint, input string, block_timestamp bigint, max_fee_per_gas bigint, "
    "max_priority_fee_per_gas bigint, transaction_type bigint, max_fee_per_blob_gas bigint, "
    "blob_versioned_hashes array<string>"
)
RECEIPTS = (
    "transaction_hash string, transaction_index bigint, block_hash string, block_number bigint, "
    "cumulative_gas_used bigint, gas_used bigint, contract_address string, root string, "
    "status bigint, effective_gas_price bigint, l1_fee bigint, l1_gas_used bigint, "
    "l1_gas_price bigint, l1_fee_scalar double, blob_gas_price bigint, blob_gas_used bigint"
)
LOGS = (
    "log_index bigint, transaction_hash string, transaction_index bigint, block_hash string, "
    "block_number bigint, address string, data string, topics array<string>"
)
TOKEN_TRANSFERS = (
    "token_address string, from_address string, to_address string, value string, "
    "value_dec decimal(38,0), transaction_hash string, log_index bigint, block_number bigint"
)
TRACES = (
    "block_number bigint, transaction_hash string, transaction_index bigint, from_address string, "
    "to_address string, value decimal(38,0), input string, output string, trace_type string, "
    "call_type string, reward_type string, gas bigint, gas_used bigint, subtraces bigint, "
    "trace_address array<int>, error string, status int, trace_id string, trace_index bigint"
)
CONTRACTS = (
    "address string, bytecode string, function_sighashes array<string>, is_erc20 boolean, "
    "is_erc721 boolean, block_number bigint"
)
TOKENS = (
    "address string, symbol string, name string, decimals bigint, total_supply string, block_number bigint"
)

ENTITIES = {
    "blocks": BLOCKS,
    "transactions": TRANSACTIONS,
    "receipts": RECEIPTS,
    "logs": LOGS,
    "token_transfers": TOKEN_TRANSFERS,
    "traces": TRACES,
    "contracts": CONTRACTS,
    "tokens": TOKENS,
}

# Graph side.
EDGES = (
    "edge_id bigint, src bigint, dst bigint, t bigint, value double, gas double, gas_price double, "
    "is_trace int, edge_type string"
)
