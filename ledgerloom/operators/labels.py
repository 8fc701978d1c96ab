"""Fraud labels from known addresses, heuristics and structure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import strong_components

# Publicly documented addresses of the 2016 exploit, and the periods in
# which they count.
KNOWN_ADDRESSES = [
    "0xf4c64518ea10f995918a454158c6b61407ea345c",
    "0xc0ee9db1a9e07ca63e4ff0d5fb6f86bf68d47b89",
    "0x304a554a310c7e546dfe434669c62820b7d83490",
    "0x914d1b8b43e92723e64fd0a06f5bdb8dd9b10c79",
    "0x4a574510c7014e4ae985403536074abe582adfc8",
    "0xb136707642a4ea12fb4bae820f03d2562ebff487",
    "0x2ef47100e0787b915105fd5e3f4ff6752079d5cb",
    "0xac0e15a038eedfc68ba3c35c73fed5be4a07afb5",
    "0xda4a4626d3e16e094de3225a751aab7128e96526",
]
KNOWN_PERIODS = ["dao_hack", "pre_dao", "post_fork"]

# Thresholds of the heuristic and structural rules.
CYCLE_LIMIT = 10
LAYER_DEGREE = 20
LAYER_RATIO = (0.3, 3.0)
RING_SIZES = (3, 50)
RING_DENSITY = 0.3


def known_labels(index: DataFrame, period: str, addresses=KNOWN_ADDRESSES, periods=KNOWN_PERIODS) -> DataFrame:
    """Indexed nodes whose address is known, in the periods where that counts."""
    wanted = F.col("address").isin(list(addresses)) if period in periods else F.lit(False)
    return index.filter(wanted).select("node_id")


def self_loop_nodes(edges: DataFrame) -> DataFrame:
    return edges.filter("src = dst").select(F.col("src").alias("node_id")).distinct()


def cycle_heavy_nodes(patterns: DataFrame, limit: int = CYCLE_LIMIT) -> DataFrame:
    return patterns.filter(F.col("cycle_2") + F.col("cycle_3") > limit).select("node_id")


def layering_nodes(features: DataFrame, degree: int = LAYER_DEGREE, ratio: tuple[float, float] = LAYER_RATIO) -> DataFrame:
    """High and similar in and out degree on the simple graph."""
    share = F.col("out_degree") / F.greatest(F.col("in_degree"), F.lit(1))
    return features.filter(
        (F.col("out_degree") > degree) & (F.col("in_degree") > degree) & (share > ratio[0]) & (share < ratio[1])
    ).select("node_id")


def component_density(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Size and density per component; density counts distinct directed edges, self-loops too."""
    src = components.select(F.col("node_id").alias("src"), F.col("component").alias("_cs"))
    dst = components.select(F.col("node_id").alias("dst"), F.col("component").alias("_cd"))
    inner = edges.select("src", "dst").distinct().join(src, "src").join(dst, "dst").filter("_cs = _cd")
    counts = inner.groupBy(F.col("_cs").alias("component")).agg(F.count("*").alias("edges"))
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.join(counts, "component").withColumn(
        "density", F.col("edges") / (F.col("size") * (F.col("size") - 1)))


def dense_component_nodes(edges: DataFrame, sizes: tuple[int, int] = RING_SIZES, density: float = RING_DENSITY) -> DataFrame:
    components = strong_components(edges)
    dense = component_density(edges, components).filter(
        F.col("size").between(*sizes) & (F.col("density") > density))
    return components.join(dense, "component", "left_semi").select("node_id")


def generate_labels(
    nodes: DataFrame,
    edges: DataFrame,
    patterns: DataFrame,
    features: DataFrame,
    known: DataFrame | None = None,
    **thresholds,
) -> DataFrame:
    """``(node_id, label, known, heuristic, structural)``; positive in any layer is fraud."""
    take = lambda *names: {k: thresholds[k] for k in names if k in thresholds}
    cycles = {"limit": thresholds["cycle_limit"]} if "cycle_limit" in thresholds else {}
    layers = {"known": [] if known is None else [known], "heuristic": [
        self_loop_nodes(edges), cycle_heavy_nodes(patterns, **cycles),
        layering_nodes(features, **take("degree", "ratio")),
    ], "structural": [dense_component_nodes(edges, **take("sizes", "density"))]}
    flags = [nodes.select("node_id", *[F.lit(False).alias(n) for n in layers])]
    for name, parts in layers.items():
        for part in parts:
            flags.append(part.select("node_id", *[F.lit(n == name).alias(n) for n in layers]))
    merged = reduce(DataFrame.unionByName, flags).groupBy("node_id").agg(*[F.max(n).alias(n) for n in layers])
    hit = F.col("known") | F.col("heuristic") | F.col("structural")
    return merged.withColumn("label", hit.cast("int"))


def label_summary(labels: DataFrame) -> DataFrame:
    total = labels.agg(
        *[F.count_if(F.col(n)).alias(n) for n in ("known", "heuristic", "structural")],
        F.count_if(F.col("label") == 1).alias("fraud"), F.count("*").alias("nodes"))
    return total.withColumn("fraud_percent", F.col("fraud") * 100.0 / F.col("nodes"))
