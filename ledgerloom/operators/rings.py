"""Fraud rings: components of the fraud-induced graph and their timing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .graph import both_ends, induced_edges


def fraud_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    return induced_edges(edges, labels.filter("label = 1"))


def ring_members(edges: DataFrame, labels: DataFrame, min_size: int = 2) -> DataFrame:
    """``(ring_id, node_id)`` of rings with at least ``min_size`` members.

    A ring is named by its smallest member. Members stay rows: rings have no size limit.
    """
    components = connected_components(fraud_edges(edges, labels))
    sizes = components.groupBy("component").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_size)
    return components.join(sizes, "component", "left_semi").select(F.col("component").alias("ring_id"), "node_id")


def ring_summary(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Size, start, completion and distinct directed pairs per ring.

    ``edges`` are fraud-to-fraud edges. A pair's time is its last one; both ends lie in
    the same ring, so one join by source attributes it.
    """
    pairs = edges.groupBy("src", "dst").agg(F.max_by("t", F.struct("t", "edge_id")).alias("t"))
    timed = pairs.join(members.withColumnRenamed("node_id", "src"), "src").groupBy("ring_id").agg(
        F.min("t").alias("start_time"), F.max("t").alias("completion_time"), F.count("*").alias("num_edges"))
    sizes = members.groupBy("ring_id").agg(F.count("*").alias("num_members"))
    return sizes.join(timed, "ring_id")


def ring_size_stats(rings: DataFrame) -> DataFrame:
    n = F.col("num_members")
    return rings.agg(
        F.count("*").alias("rings"), F.min(n).alias("min_size"), F.max(n).alias("max_size"),
        F.avg(n).alias("mean_size"), F.sum(n).alias("total_members"))


def largest_rings(rings: DataFrame, k: int = 5) -> DataFrame:
    return rings.orderBy(F.desc("num_members"), "ring_id").limit(k)


def ring_neighbourhood(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Per ring, all nodes one edge away from it that are not members."""
    touching = both_ends(edges).select("node", "other").distinct().join(
        members.withColumnRenamed("node_id", "node"), "node"
    ).select("ring_id", F.col("other").alias("node_id")).distinct()
    return touching.join(members, ["ring_id", "node_id"], "left_anti")


def ring_activity(members: DataFrame, numbered: DataFrame, total: int, blocks: int = 20) -> DataFrame:
    """Activity of each ring member over equal blocks of the edge sequence.

    ``numbered`` edges carry a 0-based ``seq``; counts are divided by the member's
    busiest block.
    """
    size = max(total // blocks, 1)
    block = F.least(F.floor(F.col("seq") / size), F.lit(blocks - 1))
    ends = both_ends(numbered.withColumn("block", block), "block")
    counts = ends.join(members.withColumnRenamed("node_id", "node"), "node", "left_semi").groupBy("node", "block").agg(
        F.count("*").alias("n"))
    peaks = counts.groupBy("node").agg(F.max("n").alias("peak"))
    return counts.join(peaks, "node").select(
        F.col("node").alias("node_id"), "block", "n", (F.col("n") / F.col("peak")).alias("activity"))
