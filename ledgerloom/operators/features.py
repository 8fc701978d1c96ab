"""Thirteen address features on the simple graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import both_ends
from .pagerank import pagerank


def simple_graph(edges: DataFrame) -> DataFrame:
    """Parallel edges collapsed to the last one in time (then edge id) order."""
    last = F.max_by(F.struct("t", "value"), F.struct("t", "edge_id"))
    return edges.groupBy("src", "dst").agg(last.alias("_l")).select("src", "dst", "_l.t", "_l.value")


def inter_event_stats(times: DataFrame, bucket_seconds: int = 86400) -> DataFrame:
    """Per node: mean and population deviation of gaps between its sorted times, and its span.

    ``times(node, t)``. Equal times collapse to a count first (each extra one is a
    zero gap). Gaps are summed inside day buckets and then across a node's bucket
    ends, so no task sorts a hub's whole history.
    """
    points = times.groupBy("node", "t").agg(F.count("*").alias("c")).withColumn(
        "_b", F.floor(F.col("t") / bucket_seconds)
    )
    inside = W.partitionBy("node", "_b").orderBy("t")
    gap = F.col("t") - F.lag("t").over(inside)
    buckets = points.withColumn("_g", F.coalesce(gap, F.lit(0)).cast("double")).groupBy("node", "_b").agg(
        F.sum("c").alias("n"), F.sum(F.col("_g") * F.col("_g")).alias("sq"),
        F.min("t").alias("lo"), F.max("t").alias("hi"),
    )
    bridge = F.coalesce(F.col("lo") - F.lag("hi").over(W.partitionBy("node").orderBy("_b")), F.lit(0)).cast("double")
    per_node = buckets.withColumn("_g", bridge).groupBy("node").agg(
        F.sum("n").alias("n"), (F.sum("sq") + F.sum(F.col("_g") * F.col("_g"))).alias("sq"),
        (F.max("hi") - F.min("lo")).cast("double").alias("span"),
    )
    gaps = F.col("n") - 1
    mean = F.when(gaps > 0, F.col("span") / gaps).otherwise(0.0)
    variance = F.when(gaps > 0, F.col("sq") / gaps - mean * mean).otherwise(0.0)
    return per_node.select(
        "node",
        mean.alias("inter_tx_time_mean"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("inter_tx_time_std"),
        F.col("span").alias("activity_span"),
    )


def inter_tx_times(edges: DataFrame) -> DataFrame:
    """Gap statistics per node over all its edges, parallel edges included."""
    return inter_event_stats(both_ends(edges, "t").select("node", "t"))


def address_features(edges: DataFrame, with_rank: bool = True) -> DataFrame:
    """Degrees, sums, means, counterparties, gap statistics, span and rank per node.

    On the simple graph a node's degree equals its distinct counterparties. PageRank
    is 0 without ``with_rank``; with it ``pagerank_converged`` says whether the rounds sufficed.
    """
    simple = simple_graph(edges)
    sides = both_ends(simple, "t", "value")
    out = F.col("out") == 1
    sent, got = F.when(out, F.col("value")), F.when(~out, F.col("value"))
    base = sides.groupBy("node").agg(
        F.count_if(~out).alias("in_degree"),
        F.count_if(out).alias("out_degree"),
        F.coalesce(F.sum(sent), F.lit(0.0)).alias("total_value_sent"),
        F.coalesce(F.sum(got), F.lit(0.0)).alias("total_value_received"),
        F.coalesce(F.avg(sent), F.lit(0.0)).alias("avg_value_sent"),
        F.coalesce(F.avg(got), F.lit(0.0)).alias("avg_value_received"),
        F.count("*").alias("tx_count"),
    )
    joined = base.join(inter_event_stats(sides.select("node", "t")), "node")
    result = joined.withColumns({
        "unique_out_counterparties": F.col("out_degree"),
        "unique_in_counterparties": F.col("in_degree"),
    })
    ranks = None
    if with_rank:
        ranks = pagerank(edges).select(F.col("node_id").alias("node"), "pagerank", F.col("converged").alias("pagerank_converged"))
    result = result.join(ranks, "node", "left") if ranks is not None else result.withColumn("pagerank", F.lit(0.0))
    return result.withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0))).withColumnRenamed("node", "node_id")
