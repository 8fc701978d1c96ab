"""Time-bounded fraud patterns per node: cycles, fans, bursts, chains and stars.

Patterns are counted, never listed. Parallel edges of one second collapse to a
weight, and temporal conditions become range frames over a node pair (or triple)
inside a few hours, so a group holds at most one row per second and role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .graph import both_ends, node_last_time
from .skew import ROWS_PER_TASK, hot_key_join

# Time limits in seconds and degree thresholds.
GAP = 3600
WINDOW = 21600
BURST_WINDOW = 300
BURST_EDGES = 10
FAN_DEGREES = (3, 5)
EVICT_EVERY = 10_000
PATTERN_COLUMNS = [
    "cycle_2", "cycle_3", "cycle_4", "fan_out_3", "fan_out_5", "fan_in_3", "fan_in_5",
    "chain_3", "chain_5", "star_3", "star_5", "burst",
]
# Extension mode: nodes on the path and time limit per declared template.
CHAIN_LIMITS = {"chain_3": (3, 3600), "chain_5": (5, 14400)}
CYCLE_4_LIMIT = 14400
STAR_LIMITS = {"star_3": (3, 7200), "star_5": (5, 14400)}


def collapse(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, second) with the number of parallel edges."""
    return edges.groupBy("src", "dst", "t").agg(F.count("*").alias("c"))


def time_of_rank(edges: DataFrame, rank: int) -> int | None:
    """Time of the ``rank``-th edge (1-based) in time order.

    Two counting passes: per day, then per second of the day that holds the rank.
    The running sums cover at most the number of days and 86 400 seconds.
    """
    def locate(counts: DataFrame, key: str, wanted: int) -> tuple[int, int] | None:
        up_to = W.partitionBy(F.lit(0)).orderBy(key).rowsBetween(W.unboundedPreceding, 0)
        row = (
            counts.withColumn("_cum", F.sum("n").over(up_to)).filter(F.col("_cum") >= wanted)
            .orderBy(key).select(key, F.col("_cum") - F.col("n")).first()
        )
        return None if row is None else (row[0], row[1])

    day = F.floor(F.col("t") / 86400)
    found = locate(edges.groupBy(day.alias("day")).agg(F.count("*").alias("n")), "day", rank)
    if found is None:
        return None
    inside = edges.filter(day == found[0]).groupBy("t").agg(F.count("*").alias("n"))
    return locate(inside, "t", rank - found[1])[0]


def evict(edges: DataFrame, window: int = WINDOW, every: int = EVICT_EVERY) -> DataFrame:
    """Edges still held after time-ordered insertion with periodic eviction.

    Every ``every`` insertions, edges older than the newest time minus ``window`` go.
    The last eviction is the strictest, so one cut-off time reproduces all of them.
    """
    total = edges.count()
    if total < every:
        return edges
    newest = time_of_rank(edges, total // every * every)
    return edges.filter(F.col("t") >= newest - window)


def _attach_ref(edges: DataFrame, refs: DataFrame, side: str, rows_per_task: int) -> DataFrame:
    other = "dst" if side == "src" else "src"
    keyed = refs.select(F.col("node").alias(side), "ref", F.col("n").alias("_n"))
    return hot_key_join(edges, keyed, [side], "_n", [other, "t"], rows_per_task=rows_per_task).drop("_n")


def pair_patterns(weighted: DataFrame, refs: DataFrame, gap: int = GAP, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """cycle_2, fans and burst per node.

    ``weighted`` comes from ``collapse``. Rows far from the node's reference time are
    dropped right after the join, so a (node, other) group spans at most three gaps.
    """
    sides = both_ends(weighted, "t", "c")
    keyed = refs.select("node", "ref", F.col("n").alias("_n"))
    near = hot_key_join(sides, keyed, ["node"], "_n", ["other", "t"], rows_per_task=rows_per_task).drop("_n")
    out = F.col("out") == 1
    close = F.abs(F.col("ref") - F.col("t")) <= gap
    # Return edges may come up to one gap after the last admissible first edge.
    near = near.filter(
        F.when(out, close).otherwise((F.col("t") >= F.col("ref") - gap) & (F.col("t") <= F.col("ref") + 2 * gap))
    )
    later = W.partitionBy("node", "other").orderBy("t").rangeBetween(1, gap)
    back = F.coalesce(F.sum(F.when(~out, F.col("c"))).over(later), F.lit(0))
    scored = near.withColumn("_pairs", F.when(out, F.col("c") * back).otherwise(F.lit(0)))
    burst = F.abs(F.col("ref") - F.col("t")) <= BURST_WINDOW
    per_pair = scored.groupBy("node", "other").agg(
        F.sum("_pairs").alias("pairs"),
        F.max(F.when(out & close, F.lit(1)).otherwise(F.lit(0))).alias("sends"),
        F.max(F.when(~out & close, F.lit(1)).otherwise(F.lit(0))).alias("gets"),
        F.sum(F.when(burst, F.col("c")).otherwise(F.lit(0))).alias("recent"),
    )
    at_least = lambda name, k: F.when(F.sum(name) >= k, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return per_pair.groupBy("node").agg(
        F.sum("pairs").alias("cycle_2"),
        *[at_least("sends", k).alias(f"fan_out_{k}") for k in FAN_DEGREES],
        *[at_least("gets", k).alias(f"fan_in_{k}") for k in FAN_DEGREES],
        at_least("recent", BURST_EDGES).alias("burst"),
    )


def cycle_2_everywhere(weighted: DataFrame, gap: int) -> DataFrame:
    """Two-cycles per starting node over all start times.

    The pair's rows are split into buckets of one gap, each also holding the next
    bucket's return edges, so a pair that trades for years is still many small groups.
    """
    bucket = F.floor(F.col("t") / gap)
    # An edge starts cycles in its own bucket and ends them in its own or the previous one.
    roles = weighted.withColumn("r", F.explode(F.array(
        F.struct(F.col("src").alias("n"), F.col("dst").alias("b"), F.lit(1).alias("first"), bucket.alias("k")),
        F.struct(F.col("dst").alias("n"), F.col("src").alias("b"), F.lit(0).alias("first"), bucket.alias("k")),
        F.struct(F.col("dst").alias("n"), F.col("src").alias("b"), F.lit(0).alias("first"), (bucket - 1).alias("k")),
    ))).select("r.*", "t", "c")
    later = W.partitionBy("n", "b", "k").orderBy("t").rangeBetween(1, gap)
    back = F.coalesce(F.sum(F.when(F.col("first") == 0, F.col("c"))).over(later), F.lit(0))
    counted = roles.withColumn("_p", F.when(F.col("first") == 1, F.col("c") * back).otherwise(F.lit(0)))
    return counted.groupBy(F.col("n").alias("node_id")).agg(F.sum("_p").alias("cycle_2")).filter("cycle_2 > 0")


def orient(pairs: DataFrame) -> DataFrame:
    """Distinct pairs ``(k, x, y)``, x < y, as ``(k, low, high)`` from the endpoint of lower degree."""
    degree = pairs.select("k", F.explode(F.array("x", "y")).alias("v")).groupBy("k", "v").agg(F.count("*").alias("d"))
    ranked = pairs.join(degree.select("k", F.col("v").alias("x"), F.col("d").alias("dx")), ["k", "x"]).join(
        degree.select("k", F.col("v").alias("y"), F.col("d").alias("dy")), ["k", "y"]
    )
    x_first = F.col("dx") <= F.col("dy")
    return ranked.select(
        "k", F.when(x_first, F.col("x")).otherwise(F.col("y")).alias("low"),
        F.when(x_first, F.col("y")).otherwise(F.col("x")).alias("high"),
    )


def triangles(oriented: DataFrame) -> DataFrame:
    """Undirected triangles ``(k, a, b, c)`` per time window.

    Both edges of a wedge start at its vertex of lowest degree, so a hub starts few
    wedges and their total stays within the number of pairs to the power 1.5.
    """
    left = oriented.select("k", F.col("low").alias("a"), F.col("high").alias("b"))
    right = oriented.select("k", F.col("low").alias("a"), F.col("high").alias("c"))
    closing = oriented.select("k", F.least("low", "high").alias("b"), F.greatest("low", "high").alias("c"))
    return left.join(right, ["k", "a"]).filter("b < c").join(closing, ["k", "b", "c"], "left_semi")


def cycle_3_counts(weighted: DataFrame, refs: DataFrame, gap: int = GAP, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Three-cycles n→b→c→n per node, with c ≠ n; b may equal n or c.

    Windows of two gaps, each also holding the next window's edges, contain every
    cycle whose first edge lies in the window's own half. Structure is found on
    distinct pairs per window; multiplicities then come from running sums over each
    candidate's three edge lists.
    """
    span = 2 * gap
    bucket = F.floor(F.col("t") / span)
    first = cut(_attach_ref(weighted, refs, "src", rows_per_task).filter(
        F.abs(F.col("ref") - F.col("t")) <= gap
    ).select(bucket.alias("k"), F.col("src").alias("x"), F.col("dst").alias("y"), "t", "c"))
    # Keep a window's edges only where they touch a first edge: the second edge leaves
    # its target, the third one enters its source.
    spread = weighted.select(
        F.explode(F.array(bucket, bucket - 1)).alias("k"), F.col("src").alias("x"), F.col("dst").alias("y"), "t", "c")
    second = spread.join(first.select("k", F.col("y").alias("x")).distinct(), ["k", "x"], "left_semi")
    third = spread.join(first.select("k", F.col("x").alias("y")).distinct(), ["k", "y"], "left_semi")
    columns = ["k", "x", "y", "t", "c", "role"]
    lists = cut(
        first.withColumn("role", F.lit(1)).select(columns)
        .unionByName(second.withColumn("role", F.lit(2)).select(columns))
        .unionByName(third.withColumn("role", F.lit(3)).select(columns))
    )

    pairs = lists.filter("x <> y").select("k", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    oriented = cut(orient(pairs))
    turns = [("a", "b", "c"), ("a", "c", "b"), ("b", "a", "c"), ("b", "c", "a"), ("c", "a", "b"), ("c", "b", "a")]
    proper = triangles(oriented).select("k", F.inline(F.array(*[
        F.struct(F.col(x).alias("n"), F.col(y).alias("b"), F.col(z).alias("far")) for x, y, z in turns
    ])))
    # Degenerate cycles run through a self-loop at the start or at the far node.
    loops = lists.filter("x = y").select("k", F.col("x").alias("loop")).distinct()
    mates = oriented.select("k", F.inline(F.array(
        F.struct(F.col("low").alias("loop"), F.col("high").alias("mate")),
        F.struct(F.col("high").alias("loop"), F.col("low").alias("mate")),
    )))
    looped = mates.join(loops, ["k", "loop"]).select("k", F.inline(F.array(
        F.struct(F.col("loop").alias("n"), F.col("loop").alias("b"), F.col("mate").alias("far")),
        F.struct(F.col("mate").alias("n"), F.col("loop").alias("b"), F.col("loop").alias("far")),
    )))

    # A candidate meets its three edge lists in one join.
    wanted = proper.unionByName(looped).select("k", "n", "b", "far", F.inline(F.array(
        F.struct(F.lit(1).alias("role"), F.col("n").alias("x"), F.col("b").alias("y")),
        F.struct(F.lit(2).alias("role"), F.col("b").alias("x"), F.col("far").alias("y")),
        F.struct(F.lit(3).alias("role"), F.col("far").alias("x"), F.col("n").alias("y")),
    )))
    events = wanted.join(lists, ["k", "role", "x", "y"])

    def weight(role: int) -> Column:
        return F.when(F.col("role") == role, F.col("c")).otherwise(F.lit(0))

    # For a first edge at s: sum over second edges u in (s, s+gap] of
    # c2 * (third edges up to s+2gap - third edges up to u).
    base = W.partitionBy("k", "n", "b", "far").orderBy("t")
    events = events.withColumn("_closed", F.sum(weight(3)).over(base.rangeBetween(W.unboundedPreceding, 0)))
    ahead = base.rangeBetween(1, gap)
    until = F.col("_closed") + F.coalesce(F.sum(weight(3)).over(base.rangeBetween(1, 2 * gap)), F.lit(0))
    seconds = F.coalesce(F.sum(weight(2)).over(ahead), F.lit(0))
    spent = F.coalesce(F.sum(weight(2) * F.col("_closed")).over(ahead), F.lit(0))
    counted = events.withColumn("_n", weight(1) * (until * seconds - spent))
    return counted.groupBy(F.col("n").alias("node")).agg(F.sum("_n").alias("cycle_3")).filter("cycle_3 > 0")


def pattern_features(
    edges: DataFrame,
    refs: DataFrame | None = None,
    evicting: bool = False,
    extended: bool = False,
    gap: int = GAP,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Twelve pattern features per node.

    By default each node is scored at its own last time over all edges; ``evicting`` keeps only
    those a periodically evicted index would hold.
    Slots whose patterns are declared but not counted in that mode are 0;
    ``extended`` counts them too.
    """
    if refs is None:
        refs = node_last_time(edges)
    held = evict(edges) if evicting else edges
    weighted = collapse(held)
    pairs = pair_patterns(weighted, refs, gap, rows_per_task)
    triples = cycle_3_counts(weighted, refs, gap, rows_per_task)
    joined = refs.select("node").join(pairs, "node", "left").join(triples, "node", "left")
    if extended:
        for name, df in extended_patterns(weighted, refs).items():
            joined = joined.join(df.withColumnRenamed("count", name), "node", "left")
    have = set(joined.columns)
    return joined.select(F.col("node").alias("node_id"), *[
        (F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0)).cast("bigint").alias(c) for c in PATTERN_COLUMNS
    ])


def temporal_chains(weighted: DataFrame, refs: DataFrame, nodes: int, limit: int) -> DataFrame:
    """Number of simple paths with rising times starting at each node.

    The first edge starts no earlier than the node's reference time minus ``limit``
    and the whole path fits in ``limit`` seconds. Each step joins on the path's end
    and a time bucket of that length, and partial paths with the same set of nodes
    and last time collapse to a weight.
    """
    return _walk(weighted, refs, nodes, limit).groupBy(F.col("start").alias("node")).agg(F.sum("c").alias("count"))


def _walk(weighted: DataFrame, refs: DataFrame, nodes: int, limit: int) -> DataFrame:
    first = _attach_ref(weighted, refs, "src", ROWS_PER_TASK).filter(
        (F.abs(F.col("ref") - F.col("t")) <= limit) & (F.col("src") != F.col("dst"))
    )
    paths = first.select(
        F.col("src").alias("start"), F.array("src", "dst").alias("path"), F.col("dst").alias("end"),
        F.col("t").alias("t0"), F.col("t").alias("t1"), "c",
    )
    bucket = F.floor(F.col("t") / limit)
    step = weighted.filter("src <> dst").select(
        F.explode(F.array(bucket, bucket - 1)).alias("k"), F.col("src").alias("end"),
        F.col("dst").alias("next"), F.col("t").alias("t2"), F.col("c").alias("c2"),
    )
    for _ in range(nodes - 2):
        grown = paths.withColumn("k", F.floor(F.col("t0") / limit)).join(step, ["k", "end"]).filter(
            (F.col("t2") > F.col("t1")) & (F.col("t2") <= F.col("t0") + limit)
            & ~F.array_contains("path", F.col("next"))
        )
        paths = grown.groupBy(
            "start", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("end"),
            "t0", F.col("t2").alias("t1"),
        ).agg(F.sum(F.col("c") * F.col("c2")).alias("c"))
    return paths


def cycle_4_counts(weighted: DataFrame, refs: DataFrame, limit: int = CYCLE_4_LIMIT) -> DataFrame:
    """Closed four-node chains within the time limit."""
    paths = _walk(weighted, refs, 4, limit)
    bucket = F.floor(F.col("t") / limit)
    closing = weighted.select(
        F.explode(F.array(bucket, bucket - 1)).alias("k"), F.col("src").alias("end"),
        F.col("dst").alias("start"), F.col("t").alias("t2"), F.col("c").alias("c2"),
    )
    closed = paths.withColumn("k", F.floor(F.col("t0") / limit)).join(closing, ["k", "end", "start"]).filter(
        (F.col("t2") > F.col("t1")) & (F.col("t2") <= F.col("t0") + limit)
    )
    return closed.groupBy(F.col("start").alias("node")).agg(F.sum(F.col("c") * F.col("c2")).alias("count"))


def star_flags(weighted: DataFrame, refs: DataFrame, spokes: int, limit: int) -> DataFrame:
    """1 for hubs that send to and hear back from at least ``spokes`` nodes in time."""
    sides = both_ends(weighted.filter("src <> dst"), "t", "c")
    keyed = refs.select("node", "ref", F.col("n").alias("_n"))
    near = hot_key_join(sides, keyed, ["node"], "_n", ["other", "t"]).drop("_n").filter(
        F.col("t").between(F.col("ref") - limit, F.col("ref") + limit)
    )
    out = F.col("out") == 1
    later = W.partitionBy("node", "other").orderBy("t").rangeBetween(1, limit)
    answered = near.withColumn("_back", F.count(F.when(~out, F.lit(1))).over(later)).filter(out & (F.col("_back") > 0))
    return answered.groupBy("node", "other").agg(F.lit(1).alias("_x")).groupBy("node").agg(
        F.when(F.count("*") >= spokes, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("count")
    )


def extended_patterns(weighted: DataFrame, refs: DataFrame) -> dict[str, DataFrame]:
    found = {"cycle_4": cycle_4_counts(weighted, refs)}
    for name, (nodes, limit) in CHAIN_LIMITS.items():
        found[name] = temporal_chains(weighted, refs, nodes, limit)
    for name, (spokes, limit) in STAR_LIMITS.items():
        found[name] = star_flags(weighted, refs, spokes, limit)
    return found
