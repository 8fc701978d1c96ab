"""Seeded samples, splits and augmentations.

Order by a seeded hash replaces a random generator: the same rows give the same
choice whatever the partitioning, also when a lost task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged
from .hops import hop_distances

# Sample sizes, rates and split shares.
SEEDS_PER_CLASS = 150
MIN_PER_CLASS = 5
TRAIN_SHARE, VAL_SHARE, TRAIN_AND_VAL_SHARE = 0.70, 0.15, 0.85
MASK_RATE = 0.2
DROP_RATE = 0.1
CROP_RATIO = 0.8
MIN_SUBSET = 8

_RANGE = 1 << 53


def unit_hash(seed: int, *columns: str) -> Column:
    """Uniform number in [0, 1) from the row's own columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(_RANGE)) / F.lit(float(_RANGE))


def lowest_hash(df: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """``n`` rows with the lowest hash, for small ``n``: a top-k, merged in one task."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), *key)).orderBy("_h", *key).limit(n).drop("_h")


def cap_edges(edges: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """A sample of ``cap`` edges for a caller who asks for one: the lowest in hash order.

    The cap is large, so ranks come from bucketed running sums instead of a top-k.
    """
    return hash_rank(edges, "edge_id", seed, []).filter(F.col("rank") < cap).drop("rank", "total")


def balanced_seeds(labels: DataFrame, per_class: int, seed: int = 42) -> DataFrame:
    """Up to ``per_class`` labelled nodes of each class. A class of fewer than five cannot be learned from: an error."""
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    if min(counts.get(0, 0), counts.get(1, 0), per_class) < MIN_PER_CLASS:
        raise ValueError(f"each class needs {MIN_PER_CLASS} nodes; there are {counts}")
    parts = [lowest_hash(labels.filter(F.col("label") == c), per_class, seed, ["node_id"]) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def hash_rank(df: DataFrame, key: str, seed: int, within: list[str]) -> DataFrame:
    """``rank`` (0-based) and group size ``total`` in hash order inside each group.

    Groups may be large, so ranks come from bucketed running sums over the hash.
    """
    from .skew import dense_index

    hashed = df.withColumn("_h", unit_hash(seed, key))
    ranked = dense_index(hashed, "rank", [F.col("_h"), F.col(key)], {
        "coarse": F.floor(F.col("_h") * 1024), "fine": F.floor(F.col("_h") * 1048576)}, within)
    if within:
        joined = ranked.join(df.groupBy(*within).agg(F.count("*").alias("total")), within)
    else:
        joined = ranked.withColumn("total", F.lit(df.count()).cast("bigint"))
    return joined.drop("_h")


def split_70_15_15(df: DataFrame, key: str, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """Add ``part``: train, val or test by hash rank, per class if ``stratify`` is given."""
    ranked = hash_rank(df, key, seed, [stratify] if stratify else [])
    first = F.floor(F.col("total") * TRAIN_SHARE)
    # The plain split floors each share by itself, the stratified one their sum.
    second = F.floor(F.col("total") * TRAIN_AND_VAL_SHARE) if stratify else first + F.floor(F.col("total") * VAL_SHARE)
    part = F.when(F.col("rank") < first, F.lit("train")).when(F.col("rank") < second, F.lit("val")).otherwise(F.lit("test"))
    return ranked.withColumn("part", part).drop("rank", "total")


def scarce_subset(labels: DataFrame, share: float, key: str = "node_id", seed: int = 42, at_least: int = MIN_SUBSET) -> DataFrame:
    """Balanced subset of a labelled table: max(share of all rows, minimum), half of it fraud."""
    wanted = max(int(labels.count() * share), at_least)
    fraud = max(2, wanted // 2)
    quota = F.when(F.col("label") == 1, F.lit(fraud)).otherwise(F.lit(wanted - fraud))
    return hash_rank(labels, key, seed, ["label"]).filter(F.col("rank") < quota).drop("rank", "total")


def mask_features(features: DataFrame, columns: list[str], rate: float = MASK_RATE, seed: int = 42) -> DataFrame:
    """Each cell becomes 0 with probability ``rate``."""
    return features.withColumns({
        c: F.when(unit_hash(seed + i, "seed", "node_id") < rate, F.lit(0.0)).otherwise(F.col(c)) for i, c in enumerate(columns)})


def drop_edges(sub_edges: DataFrame, rate: float = DROP_RATE, seed: int = 42) -> DataFrame:
    """Each edge goes with probability ``rate``; a subgraph always keeps one edge."""
    h = unit_hash(seed, "seed", "edge_id")
    marked = sub_edges.withColumn("_h", h)
    best = marked.groupBy("seed").agg(F.max(F.struct("_h", "edge_id")).alias("_best"))
    return marked.join(best, "seed").filter(
        (F.col("_h") >= rate) | (F.col("edge_id") == F.col("_best.edge_id"))).drop("_h", "_best")


def drop_nodes(nodes: DataFrame, sub_edges: DataFrame, rate: float = DROP_RATE, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Each node goes with probability ``rate``, with its edges; at least two nodes stay.

    Subgraphs under three nodes are left alone.
    """
    h = unit_hash(seed, "seed", "node_id")
    ranked = nodes.withColumn("_h", h).withColumns({
        "_r": F.row_number().over(W.partitionBy("seed").orderBy(F.desc("_h"), "node_id")),
        "_n": F.count("*").over(W.partitionBy("seed"))})
    kept = ranked.filter((F.col("_h") >= rate) | (F.col("_r") <= 2) | (F.col("_n") < 3)).drop("_h", "_r", "_n")
    return kept, _inside(kept, sub_edges)


def crop(nodes: DataFrame, sub_edges: DataFrame, ratio: float = CROP_RATIO, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Breadth-first crop from a hashed start node to ``ratio`` of the subgraph's nodes.

    A subgraph stays whole when it is no larger than the target, or when the crop would
    leave fewer than two nodes or no edge.
    """
    h = unit_hash(seed, "seed", "node_id")
    starts = nodes.groupBy("seed").agg(F.min_by("node_id", h).alias("anchor"))
    dist = hop_distances(sub_edges, starts)
    sizes = nodes.groupBy("seed").agg(
        F.count("*").alias("_n"), F.greatest(F.floor(F.count("*") * ratio), F.lit(2)).alias("_keep"))
    order = W.partitionBy("seed").orderBy("dist", h, "node_id")
    cut_nodes = staged(dist.withColumn("_r", F.row_number().over(order)).join(sizes.filter("_n > _keep"), "seed").filter(
        "_r <= _keep").select("seed", "node_id"))
    cut_edges = _inside(cut_nodes, sub_edges)
    good = cut_nodes.groupBy("seed").agg(F.count("*").alias("_n")).filter("_n >= 2").join(
        cut_edges.select("seed").distinct(), "seed").select("seed")
    kept = cut_nodes.join(good, "seed", "left_semi").unionByName(nodes.select("seed", "node_id").join(good, "seed", "left_anti"))
    inner = cut_edges.join(good, "seed", "left_semi").unionByName(
        sub_edges.select(cut_edges.columns).join(good, "seed", "left_anti"))
    return kept, inner


def combined(nodes: DataFrame, sub_edges: DataFrame, features: DataFrame, columns: list[str], seed: int = 42):
    """All augmentations in sequence: mask, edge dropout, node dropout, crop. What a step leaves is kept, since the next one reads it often."""
    masked = mask_features(features, columns, seed=seed)
    kept, inner = drop_nodes(nodes, staged(drop_edges(sub_edges, seed=seed)), seed=seed)
    kept, inner = crop(staged(kept), staged(inner), seed=seed)
    return kept, inner, masked.join(kept, ["seed", "node_id"], "left_semi")


def _inside(nodes: DataFrame, sub_edges: DataFrame) -> DataFrame:
    src = nodes.withColumnRenamed("node_id", "src")
    dst = nodes.withColumnRenamed("node_id", "dst")
    return sub_edges.join(src, ["seed", "src"], "left_semi").join(dst, ["seed", "dst"], "left_semi")
