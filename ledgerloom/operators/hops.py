"""Subgraphs around seeds: k-hop neighbourhoods, distances and position encoding."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged, unstage

ANCHORS = 16


def k_hop_nodes(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """``(seed, node_id)``: nodes that reach the seed in at most ``hops`` steps, and the seed.

    All seeds advance together; every step joins on the frontier's node and removes
    duplicates, so a hub's fan-in is expanded once per seed that reaches it.
    """
    pairs = edges.select("src", "dst").distinct()
    reached = seeds.select(F.col("node_id").alias("seed"), "node_id").distinct()
    frontier = reached
    for _ in range(hops):
        frontier = frontier.join(pairs.withColumnRenamed("dst", "node_id"), "node_id").select(
            "seed", F.col("src").alias("node_id")).distinct()
        reached = reached.unionByName(frontier).distinct()
    return reached


def limit_nodes(nodes: DataFrame, limit: int) -> DataFrame:
    """The lowest ``limit`` node ids per seed."""
    rank = F.row_number().over(W.partitionBy("seed").orderBy("node_id"))
    return nodes.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")


def subgraph_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(seed, src, dst, …)``: per seed the edges with both ends in its node set."""
    return edges.join(nodes.withColumnRenamed("node_id", "src"), "src").join(
        nodes.withColumnRenamed("node_id", "dst"), ["seed", "dst"], "left_semi"
    ).select("seed", *edges.columns)


def subgraphs(edges: DataFrame, seeds: DataFrame, hops: int = 2, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each seed's neighbourhood; tiny ones (<3 nodes or <2 edges) are dropped.

    The neighbourhood is whole unless the caller asks for its ``limit`` lowest node ids.
    """
    near = k_hop_nodes(edges, seeds, hops)
    nodes = staged(near if limit is None else limit_nodes(near, limit))
    inner = staged(subgraph_edges(nodes, edges))
    enough_edges = inner.groupBy("seed").agg(F.count("*").alias("_n")).filter("_n >= 2").select("seed")
    enough_nodes = nodes.groupBy("seed").agg(F.count("*").alias("_n")).filter("_n >= 3").select("seed")
    kept = enough_nodes.join(enough_edges, "seed")
    return nodes.join(kept, "seed", "left_semi"), inner.join(kept, "seed", "left_semi")


def anchors(sub_edges: DataFrame, nodes: DataFrame, k: int = ANCHORS) -> DataFrame:
    """``(seed, anchor, slot)``: the k nodes of highest degree per seed, lower id first on ties.

    The subgraph is undirected and simple for degrees; a self-loop adds two.
    """
    simple = sub_edges.select("seed", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = simple.select("seed", F.explode(F.array("a", "b")).alias("node_id")).groupBy("seed", "node_id").agg(
        F.count("*").alias("_d"))
    ranked = nodes.join(degree, ["seed", "node_id"], "left").withColumn(
        "slot", F.row_number().over(W.partitionBy("seed").orderBy(F.coalesce("_d", F.lit(0)).desc(), "node_id")) - 1)
    return ranked.filter(F.col("slot") < k).select("seed", F.col("node_id").alias("anchor"), "slot")


def distance_table(sub_edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(seed, word, node_id, dists)`` over undirected edges; ``dists[b]`` is the distance to source ``32 * word + b``.

    Bit-parallel breadth-first search: the sources of a seed (column ``slot``, from 0) are bits of one mask per node, so
    a round sends one mask along an edge whatever the number of sources, joins the state once and
    keeps one row per (seed, node). Bits that a node sees for the first time are the next round's front. A row
    holds a mask for each round that brought it bits; the distances come from these at the end. Only the last round's rows are kept.
    """
    links = staged(sub_edges.select("seed", F.explode(F.array(
        F.struct(F.col("src").alias("node_id"), F.col("dst").alias("next")),
        F.struct(F.col("dst").alias("node_id"), F.col("src").alias("next")),
    )).alias("s")).select("seed", "s.*").filter("node_id <> next").distinct())
    word = F.floor(F.col("slot") / 32)
    starts = sources.select("seed", word.alias("word"), F.col("anchor").alias("node_id"), F.expr("shiftleft(1L, CAST(slot % 32 AS INT))").alias("mask"))
    at_start = starts.groupBy("seed", "word", "node_id").agg(F.bit_or("mask").alias("fresh"))
    words = starts.select("seed", "word").distinct()
    every = links.select("seed", "node_id").distinct().join(words, "seed").unionByName(at_start.select("seed", "node_id", "word")).distinct()
    met = lambda dist: F.when(F.col("fresh") != 0, F.array(F.struct(F.lit(dist).alias("dist"), F.col("fresh").alias("mask")))).otherwise(F.array())
    state = every.join(at_start, ["seed", "word", "node_id"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0).cast("bigint")))
    state = staged(state.select("seed", "word", "node_id", F.col("fresh").alias("seen"), "fresh", met(0).alias("met")))
    for dist in itertools.count(1):
        told = state.filter("fresh <> 0").join(links, ["seed", "node_id"]).groupBy("seed", "word", F.col("next").alias("node_id")).agg(F.bit_or("fresh").alias("_told"))
        fresh = F.coalesce("_told", F.lit(0)).bitwiseAND(F.bitwise_not("seen"))
        moved = state.drop("fresh").join(told, ["seed", "word", "node_id"], "left").withColumn("fresh", fresh)
        last, state = state, staged(moved.select("seed", "word", "node_id", F.col("seen").bitwiseOR(F.col("fresh")).alias("seen"), "fresh", F.concat("met", met(dist)).alias("met")))
        unstage(last)
        if state.filter("fresh <> 0").isEmpty():
            unstage(links)
            at = lambda i: F.get(F.filter("met", lambda m: F.getbit(m["mask"], i) == 1), F.lit(0))["dist"]
            return state.select("seed", "word", "node_id", F.transform(F.sequence(F.lit(0), F.lit(31)), at).alias("dists"))


def hop_distances(sub_edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(seed, anchor, node_id, dist)`` over undirected edges, all sources at once; nodes out of reach give no row."""
    if "slot" not in sources.columns:
        sources = sources.select("seed", "anchor").distinct().withColumn("slot", F.row_number().over(W.partitionBy("seed").orderBy("anchor")) - 1)
    found = distance_table(sub_edges, sources).select("seed", "word", "node_id", F.posexplode("dists").alias("_b", "dist")).filter("dist IS NOT NULL")
    found = found.withColumn("slot", F.col("word") * 32 + F.col("_b"))
    return found.join(sources.select("seed", "anchor", "slot"), ["seed", "slot"]).select("seed", "anchor", "node_id", "dist")


def position_encoding(nodes: DataFrame, sub_edges: DataFrame, k: int = ANCHORS, unreachable: str = "near") -> DataFrame:
    """Proximity of each node to its subgraph's anchors, one column per slot.

    Proximity is ``1 - distance / largest distance`` in the subgraph. An unreachable
    anchor counts as distance 0 (``near``) or as the number of nodes (``far``). If all
    distances are 0 they are returned as they are. ``k`` is 32 at most, one bit of the search each.
    """
    if k > 32:
        raise ValueError("at most 32 anchors")
    points = anchors(sub_edges, nodes, k)
    found = distance_table(sub_edges, points).select("seed", "node_id", "dists")
    sizes = points.groupBy("seed").agg(F.count("*").alias("_points"))
    rows = nodes.join(sizes, "seed").join(found, ["seed", "node_id"], "left")
    missing = F.lit(0)
    if unreachable == "far":
        rows = rows.join(nodes.groupBy("seed").agg(F.count("*").cast("int").alias("_size")), "seed")
        missing = F.col("_size")
    # A slot without an anchor is a column of zeros before scaling.
    rows = rows.select("seed", "node_id", *[F.when(F.lit(i) < F.col("_points"), F.coalesce(F.get("dists", F.lit(i)), missing)).otherwise(0).alias(f"_d{i}") for i in range(k)])
    rows = staged(rows)
    top = rows.groupBy("seed").agg(F.max(F.greatest(*[F.col(f"_d{i}") for i in range(k)]) if k > 1 else F.col("_d0")).alias("_top"))
    value = lambda i: F.col(f"_d{i}").cast("double")
    return rows.join(top, "seed").select("seed", "node_id", *[
        F.when(F.col("_top") > 0, F.greatest(1.0 - value(i) / F.col("_top"), F.lit(0.0))).otherwise(value(i)).alias(f"pe_{i}")
        for i in range(k)
    ])


def subgraph_pool_features(nodes: DataFrame, sub_edges: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, deviation, maximum and minimum of each feature per subgraph, and its shape."""
    sizes = sub_edges.groupBy("seed").agg(F.count("*").alias("num_edges"))
    rows = nodes.join(features, "node_id")
    per_feature = [f(c).alias(f"{n}_{c}") for c in columns for n, f in
                   (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max), ("min", F.min))]
    # Overall moments from per-row sums: every node contributes len(columns) values.
    total, squares = sum(F.col(c) for c in columns), sum(F.col(c) * F.col(c) for c in columns)
    m = F.count("*") * len(columns)
    pooled = rows.groupBy("seed").agg(
        *per_feature, F.count("*").alias("num_nodes"), (F.sum(total) / m).alias("overall_mean"),
        F.sqrt(F.greatest((F.sum(squares) - F.sum(total) * F.sum(total) / m) / (m - 1), F.lit(0.0))).alias("overall_std"))
    return pooled.join(sizes, "seed", "left").withColumn("num_edges", F.coalesce("num_edges", F.lit(0))).withColumn(
        "edge_density", F.col("num_edges") / F.greatest(F.col("num_nodes"), F.lit(1)))
