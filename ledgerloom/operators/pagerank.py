"""PageRank by joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .skew import ROWS_PER_TASK

# Damping, round limit and tolerance per node.
DAMPING = 0.85
MAX_ROUNDS = 50
TOLERANCE = 1e-6


def pagerank(
    edges: DataFrame,
    damping: float = DAMPING,
    max_rounds: int = MAX_ROUNDS,
    tolerance: float = TOLERANCE,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``(node_id, pagerank, converged)`` over distinct edges, self-loops kept.

    Each round sends ``rank / out_degree`` along the edges and sums at the targets,
    with map-side combination. The edges of a hub carry a fixed salt and its rank is
    repeated per salt. Dangling rank is shared equally. The last iterate is returned
    whether or not it converged, with a flag.
    """
    pairs = edges.select("src", "dst").distinct()
    splits = F.ceil(F.col("degree") / rows_per_task).cast("int")
    out = cut(pairs.groupBy("src").agg(F.count("*").alias("degree")))
    # At most edges / rows_per_task nodes are split.
    hot = out.filter(F.col("degree") > rows_per_task).select("src", splits.alias("_s"))
    salted = cut(pairs.join(F.broadcast(hot), "src", "left").select(
        "src", "dst", F.pmod(F.xxhash64("dst"), F.coalesce("_s", F.lit(1))).cast("int").alias("salt")))
    nodes = salted.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    n = nodes.count()
    ranks = cut(
        nodes.join(out.withColumnRenamed("src", "node_id"), "node_id", "left")
        .select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.lit(1.0 / max(n, 1)).alias("rank"), F.lit(0.0).alias("delta"))
    )
    converged = n == 0
    for _ in range(max_rounds if n else 0):
        # One small aggregate per round: movement since the last one, and dangling rank.
        lost, moved = ranks.agg(
            F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("rank"))), F.lit(0.0)), F.sum("delta")).first()
        if moved and moved < n * tolerance:
            converged = True
            break
        senders = ranks.filter("degree > 0").select(
            F.col("node_id").alias("src"), (F.col("rank") / F.col("degree")).alias("share"),
            F.explode(F.sequence(F.lit(0), splits - 1)).alias("salt"))
        arriving = salted.join(senders, ["src", "salt"]).groupBy(F.col("dst").alias("node_id")).agg(
            F.sum("share").alias("arrived"))
        new = (F.coalesce("arrived", F.lit(0.0)) + lost / n) * damping + (1 - damping) / n
        ranks = cut(ranks.join(arriving, "node_id", "left").select(
            "node_id", "degree", new.alias("rank"), F.abs(new - F.col("rank")).alias("delta")))
    else:
        converged = converged or ranks.agg(F.sum("delta")).first()[0] < n * tolerance
    return ranks.select("node_id", F.col("rank").alias("pagerank"), F.lit(converged).alias("converged"))
