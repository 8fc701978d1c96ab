"""Temporal money-flow graph: address ids, edges and node features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, staged
from .skew import ROWS_PER_TASK, dense_index, hot_key_join, ranged

WEI = 1e18
MGAS = 1e6
GWEI = 1e9


def build_address_index(*tables: DataFrame) -> DataFrame:
    """``(address, node_id, n)``: dense ids in sorted address order.

    ``n`` counts the address's appearances and drives skew handling later. Addresses are
    numbered inside slices with sampled bounds, so shared prefixes do no harm. Every table is read
    once: both its ends come from one pass, and the distinct addresses are kept before they are sampled.
    """
    sides = [t.select(F.explode(F.array("from_address", "to_address")).alias("address")) for t in tables]
    distinct = reduce(DataFrame.unionByName, sides).groupBy("address").agg(F.count("*").alias("n"))
    slices = ranged(staged(distinct), F.col("address"))
    return dense_index(slices, "node_id", [F.col("address")], {"slice": F.col("_range")}).drop("_range")


def map_addresses(df: DataFrame, index: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add ``src`` and ``dst`` ids; rows with an unindexed endpoint are dropped."""
    for side, name in (("from_address", "src"), ("to_address", "dst")):
        other = "to_address" if side == "from_address" else "from_address"
        keyed = index.select(F.col("address").alias(side), F.col("node_id").alias(name), F.col("n").alias("_n"))
        df = hot_key_join(df, keyed, [side], "_n", [other], rows_per_task=rows_per_task).drop("_n")
    return df


def build_edges(tables: dict[str, DataFrame], index: DataFrame, zero_time: bool = False) -> DataFrame:
    """Edges of all sources, in scaled units.

    A missing gas column counts as 0. A source without a time column gets 0, unless
    it was joined to blocks first; ``zero_time`` forces 0 for those sources too.
    """
    # The index is joined twice per source: compute it once.
    index = cut(index)
    parts = []
    for kind, df in tables.items():
        has = set(df.columns)

        def amount(name: str, unit: float) -> Column:
            return F.col(name).cast("double") / unit if name in has else F.lit(0.0)

        timed = "block_timestamp" in has and not (zero_time and kind != "transaction")
        time = F.coalesce(F.col("block_timestamp").cast("bigint"), F.lit(0)) if timed else F.lit(0).cast("bigint")
        keep = ["edge_id"] if "edge_id" in has else []
        parts.append(map_addresses(df, index).select(
            *keep, "src", "dst",
            time.alias("t"),
            amount("value", WEI).alias("value"),
            amount("gas", MGAS).alias("gas"),
            amount("gas_price", GWEI).alias("gas_price"),
            F.lit(1 if kind == "trace" else 0).alias("is_trace"),
            F.lit(kind).alias("edge_type"),
        ))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def by_time(edges: DataFrame) -> DataFrame:
    return edges.orderBy("t", "edge_id") if "edge_id" in edges.columns else edges.orderBy("t")


def both_ends(edges: DataFrame, *carry: str) -> DataFrame:
    """Each edge once per endpoint: ``(node, other, out, …)``; a self-loop gives two rows."""
    sides = F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("out")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(0).alias("out")),
    )
    return edges.select(F.explode(sides).alias("s"), *carry).select("s.*", *carry)


def _log(col: Column) -> Column:
    return F.when(col > 0, F.log1p(col)).otherwise(F.lit(0.0))


def node_features(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Eight features per node over transactions and traces, parallel edges counted.

    Transfers add nothing, and three slots are reserved and stay 0. ``nodes`` adds
    zero rows for nodes without such edges.
    """
    sides = both_ends(edges.filter("edge_type <> 'token_transfer'"), "value")
    out = F.col("out") == 1
    raw = sides.groupBy(F.col("node").alias("node_id")).agg(
        F.count_if(~out).cast("double").alias("in_degree"),
        F.count_if(out).cast("double").alias("out_degree"),
        F.sum(F.when(out, F.col("value")).otherwise(0.0)).alias("total_sent"),
        F.sum(F.when(~out, F.col("value")).otherwise(0.0)).alias("total_received"),
        F.count("*").cast("double").alias("tx_count"),
    )
    if nodes is not None:
        raw = nodes.select("node_id").join(raw, "node_id", "left")
    value = lambda n: _log(F.coalesce(F.col(n), F.lit(0.0))).alias(n)
    reserved = lambda i: F.lit(0.0).alias(f"reserved_{i}")
    return raw.select(
        "node_id", value("in_degree"), value("out_degree"), value("total_sent"),
        value("total_received"), reserved(4), value("tx_count"), reserved(6), reserved(7),
    )


def node_last_time(edges: DataFrame) -> DataFrame:
    """``(node, ref, n)``: latest edge time and number of edge ends per node."""
    return both_ends(edges, "t").groupBy("node").agg(F.max("t").alias("ref"), F.count("*").alias("n"))


def subgraph_node_time(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Latest time per node over edges with both ends in ``nodes``; none gives infinity."""
    inner = induced_edges(edges, nodes)
    last = both_ends(inner, "t").groupBy(F.col("node").alias("node_id")).agg(F.max("t").cast("double").alias("last_time"))
    return nodes.select("node_id").join(last, "node_id", "left").select(
        "node_id", F.coalesce("last_time", F.lit(float("inf"))).alias("last_time")
    )


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes(node_id)``."""
    ids = nodes.select("node_id").distinct()
    return (
        edges.join(ids, F.col("src") == F.col("node_id"), "left_semi")
        .join(ids, F.col("dst") == F.col("node_id"), "left_semi")
    )


def dataset_stats(edges: DataFrame, labels: DataFrame, by: str = "period") -> DataFrame:
    """Nodes, edges, fraud share, time range and fraud-touching edges per period."""
    marked = label_edges(edges, labels, keep_sides=True)
    edge_side = marked.groupBy(by).agg(
        F.count("*").alias("edges"),
        F.min("t").alias("first_time"),
        F.max("t").alias("last_time"),
        F.sum("label").alias("fraud_edges"),
    )
    ends = both_ends(edges, by).select(by, "node").distinct()
    fraud = labels.filter("label = 1").select(F.col("node_id").alias("node"), F.lit(1).alias("_f"))
    node_side = ends.join(fraud, "node", "left").groupBy(by).agg(
        F.count("*").alias("nodes"), F.count("_f").alias("fraud_nodes")
    )
    return edge_side.join(node_side, by).withColumn(
        "fraud_percent", F.col("fraud_nodes") * 100.0 / F.col("nodes")
    )


def label_edges(edges: DataFrame, labels: DataFrame, keep_sides: bool = False) -> DataFrame:
    """Add ``label`` 1 when either endpoint is fraud.

    Only the fraud nodes are joined, which are a small part of all nodes; hub skew
    on the edge side is left to adaptive execution.
    """
    fraud = labels.filter("label = 1").select("node_id").distinct()
    src = fraud.select(F.col("node_id").alias("src"), F.lit(1).alias("_s"))
    dst = fraud.select(F.col("node_id").alias("dst"), F.lit(1).alias("_d"))
    marked = edges.join(src, "src", "left").join(dst, "dst", "left")
    label = F.greatest(F.coalesce("_s", F.lit(0)), F.coalesce("_d", F.lit(0)))
    return marked.withColumn("label", label).drop("_s", "_d")


def stream_labels(stream: DataFrame, labels: DataFrame) -> DataFrame:
    """Exact ``(src, dst, t)`` lookup, default 0."""
    keyed = labels.groupBy("src", "dst", "t").agg(F.max("label").alias("actual"))
    return stream.join(keyed, ["src", "dst", "t"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))


def neighbor_mean(edges: DataFrame, features: DataFrame, columns: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Mean of in-neighbour features per node, parallel edges counted.

    Parallel edges are first collapsed to a weight per pair, and the mean is a
    weighted sum with map-side combination, so a hub is never held in one task.
    """
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("_w"))
    degree = pairs.groupBy("src").agg(F.count("*").alias("_n"))
    keyed = degree.join(features.withColumnRenamed("node_id", "src"), "src")
    joined = hot_key_join(pairs, keyed, ["src"], "_n", ["dst"], rows_per_task=rows_per_task)
    return joined.groupBy(F.col("dst").alias("node_id")).agg(*[
        (F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(f"mean_{c}") for c in columns
    ])


def multi_period_ids(nodes: DataFrame) -> DataFrame:
    """Ids offset per period so that several graphs form one.

    ``nodes(period, node_id)`` with dense ids per period; periods are few, so their
    offsets are one small table.
    """
    from pyspark.sql import Window as W

    sizes = nodes.groupBy("period").agg((F.max("node_id") + 1).alias("_size"))
    before = W.partitionBy(F.lit(0)).orderBy("period").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("period", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return nodes.join(offsets, "period").withColumn(
        "global_id", F.col("node_id") + F.col("_offset")
    ).drop("_offset")
