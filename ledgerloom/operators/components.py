"""Connected components and strongly connected components by label rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node_id, component)``, the component named by its smallest node.

    Alternates two star contractions on the edge set: every node first points its
    larger neighbours, then its smaller ones, to the smallest node it knows. The
    edge set shrinks to one star per component in about log² rounds. Minima combine
    map-side. A hub's edges meet one row in an inner join, which adaptive execution
    splits when it is skewed.
    """
    links = cut(_pairs(edges))
    known = links.select(F.explode(F.array("src", "dst")).alias("node_id"))
    if nodes is not None:
        known = known.unionByName(nodes.select("node_id"))
    stars = links.filter("src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    before = None
    while True:
        stars = cut(_contract(_contract(stars, larger=True), larger=False))
        # Done when the edge set no longer changes: one fingerprint row per round.
        now = stars.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    labels = stars.groupBy(F.col("u").alias("node_id")).agg(F.min("v").alias("component"))
    return known.distinct().join(labels, "node_id", "left").select(
        "node_id", F.coalesce("component", "node_id").alias("component")
    )


def _contract(stars: DataFrame, larger: bool) -> DataFrame:
    """One star contraction of links ``(u, v)`` with u > v."""
    if larger:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = stars
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(smallest, "u")
    if larger:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            smallest.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def strong_components(edges: DataFrame) -> DataFrame:
    """``(node_id, component)`` for nodes in strongly connected components of two or more.

    In every round each node learns the smallest node that reaches it and the smallest
    it reaches. Where both agree, the node lies on a cycle with that node, so the
    component is found. Edges between nodes that disagree in either value cannot lie in
    one component and go; the rest repeats. The smallest node of every remaining part is
    settled in each round.
    """
    links = cut(_trim(_pairs(edges).filter("src <> dst")))
    found: DataFrame | None = None
    while not links.isEmpty():
        colours = _two_way_minima(links)
        settled = colours.filter("f = b").select("node_id", F.col("f").alias("component"))
        found = settled if found is None else found.unionByName(settled)
        open_nodes = colours.filter("f <> b")
        src = open_nodes.select(F.col("node_id").alias("src"), F.col("f").alias("_fs"), F.col("b").alias("_bs"))
        dst = open_nodes.select(F.col("node_id").alias("dst"), F.col("f").alias("_fd"), F.col("b").alias("_bd"))
        inside = links.join(src, "src").join(dst, "dst").filter("_fs = _fd AND _bs = _bd").select("src", "dst")
        links = cut(_trim(inside))
    if found is None:
        return edges.select(F.col("src").alias("node_id"), F.col("dst").alias("component")).filter(F.lit(False))
    sized = found.groupBy("component").agg(F.count("*").alias("_n")).filter("_n > 1").select("component")
    return found.join(sized, "component", "left_semi").select("node_id", "component")


def _trim(links: DataFrame) -> DataFrame:
    """Drop edges into nodes without outgoing edges and out of nodes without incoming ones."""
    heads = links.select(F.col("src").alias("dst")).distinct()
    tails = links.select(F.col("dst").alias("src")).distinct()
    return links.join(heads, "dst", "left_semi").join(tails, "src", "left_semi").select("src", "dst")


def _two_way_minima(links: DataFrame) -> DataFrame:
    """``(node_id, f, b)``: smallest node reaching each node, and smallest node it reaches."""
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    state = cut(nodes.select("node_id", F.col("node_id").alias("f"), F.col("node_id").alias("b")))
    frontier = state
    none = F.lit(None).cast("bigint")
    while True:
        # Only nodes that changed send their values on.
        forward = links.join(frontier.withColumnRenamed("node_id", "src"), "src").select(
            F.col("dst").alias("node_id"), F.col("f"), none.alias("b"))
        backward = links.join(frontier.withColumnRenamed("node_id", "dst"), "dst").select(
            F.col("src").alias("node_id"), none.alias("f"), F.col("b"))
        news = forward.unionByName(backward).groupBy("node_id").agg(F.min("f").alias("_f"), F.min("b").alias("_b"))
        merged = cut(state.join(news, "node_id", "left").select(
            "node_id", F.least("f", "_f").alias("f"), F.least("b", "_b").alias("b"),
            (F.coalesce(F.col("_f") < F.col("f"), F.lit(False)) | F.coalesce(F.col("_b") < F.col("b"), F.lit(False))).alias("_changed")))
        frontier = merged.filter("_changed").select("node_id", "f", "b")
        state = merged.select("node_id", "f", "b")
        if frontier.isEmpty():
            return state
