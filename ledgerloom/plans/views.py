"""Chain-shaped views derived from the supplied tables by integer arithmetic.

Each view has a twin in ``sqlviews`` for the SQL engine used as the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hexnum import long_to_hex
from ..operators.transfers import TRANSFER_TOPIC

EPOCH = "TIMESTAMP_NTZ'1970-01-01'"
OTHER_TOPIC = "0x" + "8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(col: str) -> Column:
    return F.timestamp_diff("SECOND", F.expr(EPOCH), F.col(col).cast("timestamp_ntz"))


def cents(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("bigint")


def address(col: Column) -> Column:
    return long_to_hex(col, 40)


def word(col: Column) -> Column:
    return long_to_hex(col, 64)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense multigraph in groups of 50 users with many repeated pairs; groups grow with the users."""
    user, event = F.col("user_id"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("edge_id"),
        user.alias("src"),
        (F.floor(user / 50) * 50 + (user * 7 + event * 13) % 50).alias("dst"),
        seconds("ts").alias("t"),
        F.col("value"),
        F.col("event_type").alias("edge_type"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse graph whose node space grows with the data: customers paying customers."""
    cust, order = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        order.alias("edge_id"),
        cust.alias("src"),
        F.floor((cust * 7 + order * 13) / 11).alias("dst"),
        seconds("o_orderdate").alias("t"),
        cents("o_totalprice").alias("cents"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments inside groups of eight customers: many small directed cycles."""
    cust, order = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        order.alias("edge_id"),
        cust.alias("src"),
        (F.floor(cust / 8) * 8 + (cust * 7 + order * 13) % 8).alias("dst"),
        seconds("o_orderdate").alias("t"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderpriority").alias("period"),
    )


def flow_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label 1 for both ends of a payment over 450 000, else 0."""
    ends = flows(spark, sf_dir).select(
        F.explode(F.array("src", "dst")).alias("node_id"), (F.col("value") > 450000).cast("int").alias("label"))
    return ends.groupBy("node_id").agg(F.max("label").alias("label"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of lineitem, numbered from 1 inside their order."""
    return trace_rows(spark, sf_dir).select("k", (F.col("depth") + 1).cast("bigint").alias("n"), "part", "supp", "cents", "qty", "flag")


def line_id(k: Column, n: Column) -> Column:
    """Number of a line over all orders, for orders of fewer than 1024 lines."""
    return k * 1024 + n


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        number.alias("number"),
        word(number + 1000000).alias("hash"),
        word(number + 999999).alias("parent_hash"),
        address(cust).alias("miner"),
        seconds("o_orderdate").alias("timestamp"),
        cents("o_totalprice").alias("gas_used"),
        F.col("o_orderstatus").alias("status"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("k"), F.col("n")
    return lines(spark, sf_dir).select(
        word(line_id(k, n)).alias("hash"),
        n.alias("nonce"),
        word(k + 1000000).alias("block_hash"),
        k.alias("block_number"),
        n.alias("transaction_index"),
        address(F.col("supp")).alias("from_address"),
        address(F.col("part")).alias("to_address"),
        (F.col("cents") * 1000000000).alias("value"),
        (F.col("qty") * 1000 + 21000).alias("gas"),
        (n * 1000000000).alias("gas_price"),
        F.col("flag"),
    )


def _object(**fields: Column) -> Column:
    """JSON object text from ready-made JSON values; null values are left out."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _quoted(col: Column) -> Column:
    return F.concat(F.lit('"'), col, F.lit('"'))


def _hex(col: Column) -> Column:
    return _quoted(long_to_hex(col))


def raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block responses. Blocks of status P also list one bare transaction hash."""
    tx = transactions(spark, sf_dir).select(
        F.col("block_number").alias("number"),
        _object(**{
            "hash": _quoted(F.col("hash")), "nonce": _hex(F.col("nonce")),
            "blockHash": _quoted(F.col("block_hash")), "blockNumber": _hex(F.col("block_number")),
            "transactionIndex": _hex(F.col("transaction_index")),
            "from": _quoted(F.upper("from_address")), "to": _quoted(F.col("to_address")),
            "value": _hex(F.col("value")), "gas": _hex(F.col("gas")), "gasPrice": _hex(F.col("gas_price")),
            "input": _quoted(F.lit("0x")), "type": F.when(F.col("flag") == "A", _quoted(F.lit("0x2"))),
            "blobVersionedHashes": F.when(F.col("flag") == "R", F.lit('["0x01","0x02"]')),
        }).alias("body"),
    )
    # A block holds the lines of one order.
    listed = tx.groupBy("number").agg(F.array_join(F.collect_list("body"), ",").alias("txs"))
    # The listed text compresses so well that its shuffle size would invite a broadcast.
    b = blocks(spark, sf_dir).join(listed.hint("merge"), "number", "left")
    bare = F.when(F.col("status") == "P", _quoted(word(F.col("number"))))
    return b.select(_object(**{
        "number": _hex(F.col("number")), "hash": _quoted(F.col("hash")),
        "parentHash": _quoted(F.col("parent_hash")), "miner": _quoted(F.upper("miner")),
        "difficulty": _hex(F.col("number") * 1000003), "totalDifficulty": _quoted(
            F.concat(long_to_hex(F.col("number") + 1), F.lit("0000000000000000"))),
        "size": _hex(F.lit(500)), "gasLimit": _hex(F.lit(8000000)), "gasUsed": _hex(F.col("gas_used")),
        "timestamp": _hex(F.col("timestamp")),
        "withdrawals": F.when(F.col("status") == "O", F.concat(F.lit("["), _object(
            index=_hex(F.col("number")), validatorIndex=_hex(F.lit(7)),
            address=_quoted(F.col("miner")), amount=_hex(F.col("gas_used"))), F.lit("]"))),
        "transactions": F.concat(F.lit("["), F.concat_ws(",", "txs", bare), F.lit("]")),
    }).alias("body"))


def raw_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts with two logs each.

    First log: a Transfer with its value in the data, or for flag R with everything
    in topics and the event topic in upper case. Second log: flag N a malformed
    Transfer, flag A another event, flag R no topics at all.
    """
    flag = F.col("flag")
    # Texts that stand in several places are made once, in a projection of their own.
    rows = lines(spark, sf_dir).select(
        "part", "qty", "n", "flag", word(line_id(F.col("k"), F.col("n"))).alias("tx"), word(F.col("k") + 1000000).alias("block"),
        _hex(F.col("k")).alias("number"), _hex(F.col("n")).alias("index"), F.upper(address(F.col("supp") + 1000000)).alias("emitter"),
        word(F.col("supp")).alias("sender"), word(F.col("part")).alias("receiver"), word(F.col("cents")).alias("amount"))
    n, sender, receiver, amount = F.col("n"), F.col("sender"), F.col("receiver"), F.col("amount")
    origin = {"transactionHash": _quoted(F.col("tx")), "transactionIndex": F.col("index"), "blockHash": _quoted(F.col("block")), "blockNumber": F.col("number")}
    strip = lambda c: F.substring(c, F.lit(3), F.length(c))
    upper = "0x" + TRANSFER_TOPIC[2:].upper()

    def log(index: Column, topics: Column, data: Column) -> Column:
        return _object(
            logIndex=_hex(index), **origin, address=_quoted(F.col("emitter")), data=_quoted(data),
            topics=F.concat(F.lit("["), topics, F.lit("]")),
        )

    join = lambda *c: F.concat_ws(",", *[_quoted(x) for x in c])
    first = F.when(flag == "R", log(n * 2, join(F.lit(upper), sender, receiver, amount), F.lit("0x"))).otherwise(
        log(n * 2, join(F.lit(TRANSFER_TOPIC), sender, receiver), amount))
    second = (
        F.when(flag == "R", log(n * 2 + 1, F.lit(""), F.lit("0x")))
        .when(flag == "N", log(n * 2 + 1, join(F.lit(TRANSFER_TOPIC)), F.concat(amount, strip(amount))))
        .otherwise(log(n * 2 + 1, join(F.lit(OTHER_TOPIC), sender, receiver), amount))
    )
    return rows.select(_object(**{
        **origin,
        "cumulativeGasUsed": _hex(F.col("qty") * 2000), "gasUsed": _hex(F.col("qty") * 1000),
        "contractAddress": F.when(flag == "A", _quoted(F.upper(address(F.col("part") + 2000000)))),
        "status": F.when(flag == "R", _quoted(F.lit("0x0"))).otherwise(_quoted(F.lit("0x1"))),
        "effectiveGasPrice": _hex(n * 1000000000), "l1FeeScalar": F.when(flag == "N", _quoted(F.lit("1.5"))),
        "logs": F.concat(F.lit("["), first, F.lit(","), second, F.lit("]")),
    }).alias("body"))


def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call chain per order: every line calls the next one."""
    from pyspark.sql import Window as W

    # Columns have their names and windows their columns before the shuffle, which then carries each once, and what groups by ``k`` needs no other.
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        "l_extendedprice", "l_quantity", F.col("l_returnflag").alias("flag"), "l_shipdate", F.col("l_linestatus").alias("linestatus"))
    order = W.partitionBy("k").orderBy("l_linenumber", "part", "supp", "l_extendedprice", "l_quantity", "flag", "l_shipdate")
    numbered = rows.withColumns({"depth": F.row_number().over(order), "calls": F.count("*").over(W.partitionBy("k"))})
    return numbered.select(
        "k", (F.col("depth") - 1).alias("depth"), "calls", "part", "supp", cents("l_extendedprice").alias("cents"),
        F.col("l_quantity").cast("bigint").alias("qty"), "flag", "linestatus")


def raw_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace arrays per block: the call chain, then one reward.

    Line status F makes a create, flag R an error. Depth decides the position, so the
    array is sorted by depth.
    """
    depth = F.col("depth")
    create = F.col("linestatus") == "F"
    failed = F.col("flag") == "R"
    path = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("0"), depth), ","), F.lit("]"))
    sender, target = _quoted(F.upper(address(F.col("supp")))), address(F.col("part") + 3000000)
    call = _object(**{
        "callType": _quoted(F.lit("call")), "from": sender, "to": _quoted(F.upper(target)),
        "value": _hex(F.col("cents")), "gas": _hex(F.col("qty") * 100), "input": _quoted(F.lit("0xabcd")),
    })
    made = _object(**{
        "from": sender, "init": _quoted(F.lit("0x6060")), "value": _hex(F.col("cents")), "gas": _hex(F.col("qty") * 100),
    })
    result = F.when(create, _object(gasUsed=_hex(F.col("qty")), address=_quoted(F.upper(target)), code=_quoted(bytecode("part")))).otherwise(
        _object(gasUsed=_hex(F.col("qty")), output=_quoted(F.lit("0x"))))
    body = _object(**{
        "action": F.when(create, made).otherwise(call),
        "blockNumber": F.col("k").cast("string"),
        "error": F.when(failed, _quoted(F.lit("Out of gas"))),
        "result": F.when(~failed, result),
        "subtraces": F.when(depth + 1 < F.col("calls"), F.lit("1")).otherwise(F.lit("0")),
        "traceAddress": path,
        "transactionHash": _quoted(word(F.col("k"))),
        "transactionPosition": F.lit("0"),
        "type": F.when(create, _quoted(F.lit("create"))).otherwise(_quoted(F.lit("call"))),
    })
    reward = _object(**{
        "action": _object(author=_quoted(F.upper(address(F.col("k")))), rewardType=_quoted(F.lit("block")), value=_hex(F.lit(5000000))),
        "blockNumber": F.col("k").cast("string"), "subtraces": F.lit("0"), "traceAddress": F.lit("[]"),
        "type": _quoted(F.lit("reward")),
    })
    # Calls of one transaction: bounded by the lines of an order.
    grouped = trace_rows(spark, sf_dir).select("k", F.struct("depth", body.alias("body")).alias("s")).groupBy("k").agg(
        F.array_sort(F.collect_list("s")).alias("s"))
    return grouped.select(F.concat(
        F.lit("["), F.array_join(F.col("s.body"), ","), F.lit(","), reward, F.lit("]")).alias("body"))


SELECTOR_ORDER = ["18160ddd", "70a08231", "a9059cbb", "23b872dd", "095ea7b3", "dd62ed3e", "6352211e"]


def bytecode(part: str) -> Column:
    """Dispatcher code that tests a subset of the seven selectors, chosen by key bits.

    One more PUSH4 hides inside a PUSH5's data and another one follows the first jump
    target; neither may be found.
    """
    pieces = [F.lit("0x6060604052")]
    for i, selector in enumerate(SELECTOR_ORDER):
        wanted = (F.floor(F.col(part) / (1 << i)) % 3) != 1
        pieces.append(F.when(wanted, F.lit(f"8063{selector}1461007857")).otherwise(F.lit("")))
    pieces.append(F.lit("6463deadbeef5b63cafebabe"))
    return F.concat(*pieces)


def raw_call_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested call frames per order: each line calls the next, and a static leaf."""
    frame = F.struct(
        "depth",
        F.concat(
            F.when(F.col("linestatus") == "F", F.lit('{"type":"DELEGATECALL"')).otherwise(F.lit('{"type":"CALL"')),
            F.lit(',"from":"'), F.upper(address(F.col("supp"))), F.lit('","to":"'), address(F.col("part")),
            F.lit('","value":"'), long_to_hex(F.col("cents")), F.lit('","gas":"'), long_to_hex(F.col("qty")),
            F.lit('","gasUsed":"0x5","input":"0x","output":"0x"'),
            F.when(F.col("flag") == "R", F.lit(',"error":"reverted"')).otherwise(F.lit("")),
        ).alias("head"),
    )
    grouped = trace_rows(spark, sf_dir).select("k", frame.alias("s")).groupBy("k").agg(
        F.reverse(F.array_sort(F.collect_list("s"))).alias("s"))
    leaf = '{"type":"SELFDESTRUCT","from":"0xAB","to":"0xCD","value":"0x1","gas":"0x0","gasUsed":"0x0","input":"0x"}'
    nested = F.aggregate("s", F.lit(""), lambda inner, x: F.concat(
        x["head"], F.lit(',"calls":['), F.when(inner != "", F.concat(inner, F.lit(","))).otherwise(F.lit("")),
        F.lit(leaf + "]}")))
    return grouped.select(_object(
        block_number=F.col("k").cast("string"),
        transaction_traces=F.concat(F.lit('[{"result":'), nested, F.lit("}]")),
    ).alias("body"))
