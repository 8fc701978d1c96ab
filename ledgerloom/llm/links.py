"""Connected components of undirected links in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``(v, root)`` for every end of a link ``(a, b)``; the root is the smallest member.

    A round gives every vertex the smallest label among its neighbours and itself, hooks the
    old label's vertex on too, and jumps one pointer. Both sides of the joins are plain
    tables, so a vertex with very many links is split by the skew join.
    """
    links = cut(links.filter("a <> b").select("a", "b").distinct())
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("_m")).select("v", F.least("v", "_m").alias("root")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), F.col("root").alias("_r")), "b").groupBy(F.col("a").alias("v")).agg(F.min("_r").alias("_r"))
        told = labels.join(near, "v")
        # The vertex a label points at learns of a smaller one from each of its followers.
        hooks = told.filter("_r < root").groupBy(F.col("root").alias("v")).agg(F.min("_r").alias("_h"))
        lower = cut(told.join(hooks, "v", "left").select("v", "root", F.least("root", "_r", "_h").alias("_l")))
        up = lower.select(F.col("v").alias("_l"), F.col("_l").alias("_u"))
        labels = cut(lower.join(up, "_l", "left").select("v", F.coalesce("_u", "_l").alias("_n"), "root").select(
            "v", F.col("_n").alias("root"), (F.col("_n") < F.col("root")).alias("_moved")))
        if labels.filter("_moved").isEmpty():
            return labels.select("v", "root")
        labels = labels.select("v", "root")
