"""Queries of the graph half: patterns, features, labels, rings and subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components, features, graph, hops, labels, pagerank, patterns, rings, sampling, sequence
from . import views as V
from .registry import query

GAP = patterns.GAP

_HELD = """, cut AS (
    SELECT CASE WHEN count(*) >= 10000 THEN (
        SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) AS rn FROM edges)
        WHERE rn = (SELECT count(*) // 10000 * 10000 FROM edges)) - 21600 ELSE -1 END AS low FROM edges),
held AS (SELECT * FROM edges WHERE t >= (SELECT low FROM cut))"""
_ALL = ", held AS (SELECT * FROM edges)"
_C2 = """(SELECT r.node, count(*) AS n FROM refs r JOIN held a ON a.src = r.node AND abs(r.ref - a.t) <= 3600
          JOIN held b ON b.src = a.dst AND b.dst = a.src AND b.t > a.t AND b.t - a.t <= 3600 GROUP BY r.node)"""
_C3 = """(SELECT r.node, count(*) AS n FROM refs r JOIN held a ON a.src = r.node AND abs(r.ref - a.t) <= 3600
          JOIN held b ON b.src = a.dst AND b.dst <> a.src AND b.t > a.t AND b.t - a.t <= 3600
          JOIN held c ON c.src = b.dst AND c.dst = a.src AND c.t > b.t AND c.t - a.t <= 7200 GROUP BY r.node)"""
_OUT = """(SELECT r.node, count(DISTINCT a.dst) AS n FROM refs r JOIN held a ON a.src = r.node AND abs(r.ref - a.t) <= 3600 GROUP BY r.node)"""
_IN = """(SELECT r.node, count(DISTINCT a.src) AS n FROM refs r JOIN held a ON a.dst = r.node AND abs(r.ref - a.t) <= 3600 GROUP BY r.node)"""
_BURST = """(SELECT r.node, count(*) AS n FROM refs r JOIN (
            SELECT src AS node, t FROM held UNION ALL SELECT dst, t FROM held) a ON a.node = r.node AND abs(r.ref - a.t) <= 300 GROUP BY r.node)"""


def _pattern_sql(held: str) -> str:
    flag = lambda v, k: f"CAST(CASE WHEN coalesce({v}.n, 0) >= {k} THEN 1 ELSE 0 END AS BIGINT)"
    zero = "CAST(0 AS BIGINT)"
    return f"""{held}
    SELECT r.node AS node_id, coalesce(c2.n, 0) AS cycle_2, coalesce(c3.n, 0) AS cycle_3, {zero} AS cycle_4,
           {flag('o', 3)} AS fan_out_3, {flag('o', 5)} AS fan_out_5, {flag('i', 3)} AS fan_in_3, {flag('i', 5)} AS fan_in_5,
           {zero} AS chain_3, {zero} AS chain_5, {zero} AS star_3, {zero} AS star_5, {flag('b', 10)} AS burst
    FROM refs r LEFT JOIN {_C2} c2 USING (node) LEFT JOIN {_C3} c3 USING (node) LEFT JOIN {_OUT} o USING (node)
    LEFT JOIN {_IN} i USING (node) LEFT JOIN {_BURST} b USING (node)"""


@query("pattern_features", views="edges refs", sql=_pattern_sql(_ALL))
def pattern_features(spark: SparkSession, d: str) -> DataFrame:
    return patterns.pattern_features(V.edges(spark, d))


@query("pattern_features_evicted", views="edges refs", sql=_pattern_sql(_HELD))
def pattern_features_evicted(spark: SparkSession, d: str) -> DataFrame:
    return patterns.pattern_features(V.edges(spark, d), evicting=True)


@query("pattern_features_unevicted", views="edges refs", sql=_pattern_sql(_ALL))
def pattern_features_unevicted(spark, d):
    return patterns.pattern_features(V.edges(spark, d), evicting=False)


@query("cycle_2_pairs", views="edges", sql="""
    SELECT a.src AS node_id, count(*) AS cycle_2 FROM edges a
    JOIN edges b ON b.src = a.dst AND b.dst = a.src AND b.t > a.t AND b.t - a.t <= 86400 GROUP BY a.src""")
def cycle_2_pairs(spark, d):
    """Two-cycles over all starts with a one-day gap."""
    return patterns.cycle_2_everywhere(patterns.collapse(V.edges(spark, d)), 86400)


@query("cycle_3_flows", views="circles", sql="""
    , refs AS (SELECT node, max(t) AS ref FROM (SELECT src AS node, t FROM circles UNION ALL SELECT dst, t FROM circles) GROUP BY node)
    SELECT r.node AS node_id, count(*) AS cycle_3 FROM refs r JOIN circles a ON a.src = r.node AND abs(r.ref - a.t) <= 15552000
    JOIN circles b ON b.src = a.dst AND b.dst <> a.src AND b.t > a.t AND b.t - a.t <= 15552000
    JOIN circles c ON c.src = b.dst AND c.dst = a.src AND c.t > b.t AND c.t - a.t <= 31104000 GROUP BY r.node""")
def cycle_3_flows(spark, d):
    """Three-cycles of the payment circles with a gap of 180 days."""
    e = V.circles(spark, d)
    return patterns.cycle_3_counts(patterns.collapse(e), graph.node_last_time(e), 15552000).withColumnRenamed("node", "node_id")


@query("fan_patterns", views="edges refs", sql=f"""{_ALL}
    SELECT r.node AS node_id, CAST(CASE WHEN o.n >= 3 THEN 1 ELSE 0 END AS BIGINT) AS fan_out_3,
           CAST(CASE WHEN i.n >= 3 THEN 1 ELSE 0 END AS BIGINT) AS fan_in_3
    FROM refs r LEFT JOIN {_OUT} o USING (node) LEFT JOIN {_IN} i USING (node)""")
def fan_patterns(spark, d):
    e = V.edges(spark, d)
    return patterns.pair_patterns(patterns.collapse(e), graph.node_last_time(e)).select(
        F.col("node").alias("node_id"), "fan_out_3", "fan_in_3")


@query("temporal_burst", views="edges refs", sql=f"""{_ALL}
    SELECT r.node AS node_id, CAST(CASE WHEN b.n >= 10 THEN 1 ELSE 0 END AS BIGINT) AS burst FROM refs r LEFT JOIN {_BURST} b USING (node)""")
def temporal_burst(spark, d):
    e = V.edges(spark, d)
    return patterns.pair_patterns(patterns.collapse(e), graph.node_last_time(e)).select(F.col("node").alias("node_id"), "burst")


_CIRCLE_REFS = """, refs AS (SELECT node, max(t) AS ref FROM (SELECT src AS node, t FROM circles UNION ALL SELECT dst, t FROM circles) GROUP BY node)"""
_LIMIT = 94608000


@query("temporal_chains", views="circles", sql=f"""{_CIRCLE_REFS}
    SELECT r.node AS node_id, count(*) AS chain_3 FROM refs r
    JOIN circles a ON a.src = r.node AND a.dst <> a.src AND abs(r.ref - a.t) <= {_LIMIT}
    JOIN circles b ON b.src = a.dst AND b.dst <> b.src AND b.dst <> a.src AND b.t > a.t AND b.t <= a.t + {_LIMIT} GROUP BY r.node""")
def temporal_chains(spark, d):
    e = V.circles(spark, d)
    return patterns.temporal_chains(patterns.collapse(e), graph.node_last_time(e), 3, _LIMIT).select(
        F.col("node").alias("node_id"), F.col("count").alias("chain_3"))


@query("temporal_cycle_4", views="circles", sql=f"""{_CIRCLE_REFS}
    SELECT r.node AS node_id, count(*) AS cycle_4 FROM refs r
    JOIN circles a ON a.src = r.node AND a.dst <> a.src AND abs(r.ref - a.t) <= {_LIMIT}
    JOIN circles b ON b.src = a.dst AND b.dst NOT IN (a.src, a.dst) AND b.t > a.t AND b.t <= a.t + {_LIMIT}
    JOIN circles c ON c.src = b.dst AND c.dst NOT IN (a.src, a.dst, b.dst) AND c.t > b.t AND c.t <= a.t + {_LIMIT}
    JOIN circles e ON e.src = c.dst AND e.dst = a.src AND e.t > c.t AND e.t <= a.t + {_LIMIT} GROUP BY r.node""")
def temporal_cycle_4(spark, d):
    e = V.circles(spark, d)
    return patterns.cycle_4_counts(patterns.collapse(e), graph.node_last_time(e), _LIMIT).select(
        F.col("node").alias("node_id"), F.col("count").alias("cycle_4"))


@query("star_flags", views="circles", sql=f"""{_CIRCLE_REFS}
    , spokes AS (SELECT DISTINCT r.node, a.dst FROM refs r JOIN circles a ON a.src = r.node AND a.dst <> a.src AND abs(r.ref - a.t) <= {_LIMIT}
        JOIN circles b ON b.src = a.dst AND b.dst = a.src AND b.t > a.t AND b.t <= a.t + {_LIMIT} AND abs(r.ref - b.t) <= {_LIMIT})
    SELECT node AS node_id, CAST(CASE WHEN count(*) >= 2 THEN 1 ELSE 0 END AS BIGINT) AS star FROM spokes GROUP BY node""")
def star_flags(spark, d):
    e = V.circles(spark, d)
    return patterns.star_flags(patterns.collapse(e), graph.node_last_time(e), 2, _LIMIT).select(
        F.col("node").alias("node_id"), F.col("count").alias("star"))


@query("eviction", views="edges", sql=f"{_HELD} SELECT edge_id, src, dst, t FROM held")
def eviction(spark, d):
    return patterns.evict(V.edges(spark, d)).select("edge_id", "src", "dst", "t")


@query("node_last_time", views="refs", sql="SELECT node AS node_id, ref AS last_time FROM refs")
def node_last_time(spark, d):
    return graph.node_last_time(V.edges(spark, d)).select(F.col("node").alias("node_id"), F.col("ref").alias("last_time"))


# ---------------------------------------------------------------- graph construction

def _transactions(spark, d):
    return V.transactions(spark, d).join(
        V.blocks(spark, d).select(F.col("number").alias("block_number"), F.col("timestamp").alias("block_timestamp")), "block_number")


_INDEX = """, index AS (SELECT address, row_number() OVER (ORDER BY address) - 1 AS node_id, n FROM (
    SELECT address, count(*) AS n FROM (SELECT from_address AS address FROM transactions UNION ALL SELECT to_address FROM transactions) GROUP BY address))"""


@query("address_index", views="transactions", sql=f"{_INDEX} SELECT address, node_id FROM index")
def address_index(spark, d):
    return graph.build_address_index(V.transactions(spark, d)).select("address", "node_id")


@query("map_addresses", views="transactions", sql=f"""{_INDEX}
    SELECT t.hash, a.node_id AS src, b.node_id AS dst FROM transactions t
    JOIN index a ON a.address = t.from_address JOIN index b ON b.address = t.to_address""")
def map_addresses(spark, d):
    tx = V.transactions(spark, d)
    return graph.map_addresses(tx, graph.build_address_index(tx)).select("hash", "src", "dst")


@query("edge_features", views="transactions blocks transfers", sql="""
    , index AS (SELECT address, row_number() OVER (ORDER BY address) - 1 AS node_id FROM (
        SELECT from_address AS address FROM transactions UNION SELECT to_address FROM transactions))
    SELECT a.node_id AS src, b.node_id AS dst, s.t, round(s.value * 1e6, 6) AS micro_value, s.gas, s.gas_price,
           CAST(0 AS INTEGER) AS is_trace, s.edge_type FROM (
        SELECT from_address, to_address, bl.timestamp AS t, CAST(value AS DOUBLE) / 1e18 AS value, CAST(gas AS DOUBLE) / 1e6 AS gas,
               CAST(gas_price AS DOUBLE) / 1e9 AS gas_price, 'transaction' AS edge_type
        FROM transactions x JOIN blocks bl ON bl.number = x.block_number
        UNION ALL SELECT from_address, to_address, CAST(0 AS BIGINT), CAST(value AS DOUBLE) / 1e18, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), 'token_transfer' FROM transfers) s
    JOIN index a ON a.address = s.from_address JOIN index b ON b.address = s.to_address""")
def edge_features(spark, d):
    from .chain_queries import _transfers

    tx = _transactions(spark, d)
    built = graph.build_edges({"transaction": tx, "token_transfer": _transfers(spark, d)}, graph.build_address_index(tx))
    return built.withColumn("micro_value", F.round(F.col("value") * 1e6, 6)).drop("value")


_SIDES = """, sides AS (SELECT src AS node, dst AS other, 1 AS o, t, value FROM {v} UNION ALL SELECT dst, src, 0, t, value FROM {v})"""


@query("node_features", views="edges", sql=_SIDES.format(v="edges") + """
    SELECT node AS node_id, round(ln(1 + count(*) FILTER (o = 0)), 6) AS in_degree, round(ln(1 + count(*) FILTER (o = 1)), 6) AS out_degree,
           round(ln(1 + coalesce(sum(value) FILTER (o = 1), 0)), 6) AS total_sent, round(ln(1 + coalesce(sum(value) FILTER (o = 0), 0)), 6) AS total_received,
           round(ln(1 + count(*)), 6) AS tx_count FROM sides GROUP BY node""")
def node_features(spark, d):
    f = graph.node_features(V.edges(spark, d))
    return f.select("node_id", *[F.round(c, 6).alias(c) for c in ("in_degree", "out_degree", "total_sent", "total_received", "tx_count")])


_SIMPLE = """, simple AS (SELECT src, dst, t, value FROM (
    SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY t DESC, edge_id DESC) AS rn FROM {v}) WHERE rn = 1)"""
_GAPS = """, gaps AS (SELECT node, t, t - lag(t) OVER (PARTITION BY node ORDER BY t) AS g FROM sides)"""


@query("address_features", views="circles", sql=_SIMPLE.format(v="circles") + _SIDES.format(v="simple") + _GAPS + """
    SELECT s.node AS node_id, s.in_degree, s.out_degree, s.sent AS total_value_sent, s.received AS total_value_received,
           s.avg_sent AS avg_value_sent, s.avg_received AS avg_value_received, s.tx_count, s.out_degree AS unique_out_counterparties,
           s.in_degree AS unique_in_counterparties, round(coalesce(g.m, 0), 4) AS inter_tx_time_mean, round(coalesce(g.s, 0), 1) AS inter_tx_time_std,
           s.span AS activity_span FROM (
        SELECT node, count(*) FILTER (o = 0) AS in_degree, count(*) FILTER (o = 1) AS out_degree, count(*) AS tx_count,
               round(coalesce(sum(value) FILTER (o = 1), 0), 2) AS sent, round(coalesce(sum(value) FILTER (o = 0), 0), 2) AS received,
               round(coalesce(avg(value) FILTER (o = 1), 0), 6) AS avg_sent, round(coalesce(avg(value) FILTER (o = 0), 0), 6) AS avg_received,
               CAST(max(t) - min(t) AS DOUBLE) AS span FROM sides GROUP BY node) s
    JOIN (SELECT node, avg(g) AS m, stddev_pop(g) AS s FROM gaps GROUP BY node) g USING (node)""")
def address_features(spark, d):
    f = features.address_features(V.circles(spark, d), with_rank=False)
    digits = {"total_value_sent": 2, "total_value_received": 2, "avg_value_sent": 6, "avg_value_received": 6,
              "inter_tx_time_mean": 4, "inter_tx_time_std": 1}
    return f.withColumns({c: F.round(c, n) for c, n in digits.items()}).drop("pagerank")


@query("address_features_ranked")
def address_features_ranked(spark, d):
    """With PageRank to convergence."""
    return features.address_features(V.circles(spark, d))


@query("inter_tx_times", views="edges", sql=_SIDES.format(v="edges") + _GAPS + """
    SELECT node AS node_id, round(coalesce(avg(g), 0), 4) AS inter_tx_time_mean, round(coalesce(stddev_pop(g), 0), 3) AS inter_tx_time_std,
           CAST(max(t) - min(t) AS DOUBLE) AS activity_span FROM gaps GROUP BY node""")
def inter_tx_times(spark, d):
    f = features.inter_tx_times(V.edges(spark, d))
    return f.select(F.col("node").alias("node_id"), F.round("inter_tx_time_mean", 4).alias("inter_tx_time_mean"),
                    F.round("inter_tx_time_std", 3).alias("inter_tx_time_std"), "activity_span")


@query("edges_by_time", views="edges", sql="SELECT edge_id, src, dst, t FROM edges ORDER BY t, edge_id")
def edges_by_time(spark, d):
    return graph.by_time(V.edges(spark, d)).select("edge_id", "src", "dst", "t")


@query("edge_union", views="edges flows", sql="""
    SELECT 'events' AS edge_type, src, dst, t FROM edges UNION ALL SELECT 'orders', src, dst, t FROM flows""")
def edge_union(spark, d):
    a = V.edges(spark, d).select(F.lit("events").alias("edge_type"), "src", "dst", "t")
    return a.unionByName(V.flows(spark, d).select(F.lit("orders").alias("edge_type"), "src", "dst", "t"))


@query("subgraph_node_time", views="flows flow_labels fraud_edges", sql="""
    SELECT n.node_id, coalesce(max(e.t), CAST('infinity' AS DOUBLE)) AS last_time FROM (SELECT node_id FROM flow_labels WHERE label = 1) n
    LEFT JOIN (SELECT src AS node, CAST(t AS DOUBLE) AS t FROM fraud_edges UNION ALL SELECT dst, CAST(t AS DOUBLE) FROM fraud_edges) e
    ON e.node = n.node_id GROUP BY n.node_id""")
def subgraph_node_time(spark, d):
    fraud = V.flow_labels(spark, d).filter("label = 1")
    return graph.subgraph_node_time(fraud, V.flows(spark, d))


@query("induced_edges", views="fraud_edges", sql="SELECT edge_id, src, dst FROM fraud_edges")
def induced_edges(spark, d):
    return rings.fraud_edges(V.flows(spark, d), V.flow_labels(spark, d)).select("edge_id", "src", "dst")


@query("dataset_stats", views="flows flow_labels", sql="""
    , marked AS (SELECT f.*, CASE WHEN a.label = 1 OR b.label = 1 THEN 1 ELSE 0 END AS hit FROM flows f
        JOIN flow_labels a ON a.node_id = f.src JOIN flow_labels b ON b.node_id = f.dst),
    ends AS (SELECT DISTINCT priority, node FROM (SELECT priority, src AS node FROM flows UNION ALL SELECT priority, dst FROM flows))
    SELECT e.priority, e.edges, e.first_time, e.last_time, e.fraud_edges, n.nodes, n.fraud_nodes,
           round(n.fraud_nodes * 100.0 / n.nodes, 6) AS fraud_percent
    FROM (SELECT priority, count(*) AS edges, min(t) AS first_time, max(t) AS last_time, CAST(sum(hit) AS BIGINT) AS fraud_edges FROM marked GROUP BY priority) e
    JOIN (SELECT priority, count(*) AS nodes, count(*) FILTER (label = 1) AS fraud_nodes FROM ends JOIN flow_labels ON node_id = node GROUP BY priority) n USING (priority)""")
def dataset_stats(spark, d):
    return graph.dataset_stats(V.flows(spark, d), V.flow_labels(spark, d), "priority").withColumn(
        "fraud_percent", F.round(F.col("fraud_percent").cast("double"), 6))


@query("edge_labels", views="flows flow_labels", sql="""
    SELECT f.edge_id, CAST(CASE WHEN a.label = 1 OR b.label = 1 THEN 1 ELSE 0 END AS INTEGER) AS label FROM flows f
    JOIN flow_labels a ON a.node_id = f.src JOIN flow_labels b ON b.node_id = f.dst""")
def edge_labels(spark, d):
    return graph.label_edges(V.flows(spark, d), V.flow_labels(spark, d)).select("edge_id", "label")


@query("stream_labels", views="flows", sql="""
    , known AS (SELECT DISTINCT src, dst, t FROM flows WHERE priority = '1-URGENT')
    SELECT f.edge_id, CAST(CASE WHEN k.src IS NULL THEN 0 ELSE 1 END AS INTEGER) AS actual FROM flows f
    LEFT JOIN known k ON k.src = f.src AND k.dst = f.dst AND k.t = f.t""")
def stream_labels(spark, d):
    e = V.flows(spark, d)
    known = e.filter("priority = '1-URGENT'").select("src", "dst", "t", F.lit(1).alias("label"))
    return graph.stream_labels(e, known).select("edge_id", "actual")


@query("neighbor_mean", views="circles", sql="""
    , f AS (SELECT src AS node_id, CAST(count(*) AS DOUBLE) AS x FROM circles GROUP BY src)
    SELECT c.dst AS node_id, round(avg(f.x), 6) AS mean_x FROM circles c JOIN f ON f.node_id = c.src GROUP BY c.dst""")
def neighbor_mean(spark, d):
    e = V.circles(spark, d)
    f = e.groupBy(F.col("src").alias("node_id")).agg(F.count("*").cast("double").alias("x"))
    return graph.neighbor_mean(e, f, ["x"]).withColumn("mean_x", F.round("mean_x", 6))


@query("multi_period_ids", views="flows", sql="""
    , n AS (SELECT DISTINCT priority AS period, src AS node_id FROM flows),
    s AS (SELECT period, max(node_id) + 1 AS size FROM n GROUP BY period)
    SELECT n.period, n.node_id, CAST(n.node_id + coalesce((SELECT sum(size) FROM s WHERE s.period < n.period), 0) AS BIGINT) AS global_id FROM n""")
def multi_period_ids(spark, d):
    nodes = V.flows(spark, d).select(F.col("priority").alias("period"), F.col("src").alias("node_id")).distinct()
    return graph.multi_period_ids(nodes)


# ---------------------------------------------------------------- order and splits

@query("edge_seq", views="edges", sql="SELECT edge_id, row_number() OVER (ORDER BY t, edge_id) - 1 AS seq FROM edges")
def edge_seq(spark, d):
    return sequence.edge_seq(V.edges(spark, d)).select("edge_id", "seq")


@query("edge_seq_same_time", views="flows", sql="""
    SELECT edge_id, row_number() OVER (ORDER BY t, edge_id) - 1 AS seq FROM (
        SELECT edge_id, CASE WHEN status = 'P' THEN 0 ELSE t END AS t FROM flows)""")
def edge_seq_same_time(spark, d):
    """A third of the edges lacks a time and shares second 0."""
    e = V.flows(spark, d).withColumn("t", F.when(F.col("status") == "P", F.lit(0)).otherwise(F.col("t")))
    return sequence.edge_seq(e).select("edge_id", "seq")


@query("last_write_wins", views="flows", sql="""
    SELECT src, dst, edge_id, t FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY t DESC, edge_id DESC) AS rn FROM flows) WHERE rn = 1""")
def last_write_wins(spark, d):
    return sequence.last_write_wins(V.flows(spark, d).select("src", "dst", "edge_id", "t"))


@query("warmup_split", views="edges", sql="""
    SELECT edge_id, CASE WHEN seq < CAST(floor(0.6 * n) AS BIGINT) THEN 'train' ELSE 'eval' END AS phase FROM (
        SELECT edge_id, row_number() OVER (ORDER BY t, edge_id) - 1 AS seq, count(*) OVER () AS n FROM edges)""")
def warmup_split(spark, d):
    return sequence.warmup_split(V.edges(spark, d)).select("edge_id", "phase")


@query("replay_evaluated", views="edges", sql="""
    SELECT edge_id FROM (SELECT edge_id, row_number() OVER (ORDER BY t, edge_id) AS rn FROM edges) WHERE rn >= 500""")
def replay_evaluated(spark, d):
    return sequence.replay_evaluated(V.edges(spark, d), 500).select("edge_id")


@query("holdout", views="flows", sql="""
    SELECT node_id, CASE WHEN rn <= CAST(floor(0.8 * n) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM (
        SELECT node_id, row_number() OVER (ORDER BY node_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT src AS node_id FROM flows))""")
def holdout(spark, d):
    nodes = V.flows(spark, d).select(F.col("src").alias("node_id")).distinct()
    return sequence.holdout(nodes, [F.col("node_id")], {
        "wide": F.floor(F.col("node_id") / (1 << 30)), "block": F.floor(F.col("node_id") / (1 << 15))}).select("node_id", "part")


@query("snapshots", views="sub_edges", sql="""
    SELECT seed, edge_id, CAST(least(pos // greatest(n // 4, 1), 3) AS BIGINT) AS snapshot FROM (
        SELECT seed, edge_id, row_number() OVER (PARTITION BY seed ORDER BY t, edge_id) - 1 AS pos, count(*) OVER (PARTITION BY seed) AS n FROM sub_edges)""")
def snapshots(spark, d):
    return sequence.snapshots(_subgraphs(spark, d)[1]).select("seed", "edge_id", "snapshot")


# ---------------------------------------------------------------- labels

_THRESHOLDS = dict(degree=3, ratio=(0.3, 3.0), sizes=(3, 50), density=0.3)


@query("self_loop_labels", views="circles", sql="SELECT DISTINCT src AS node_id FROM circles WHERE src = dst")
def self_loop_labels(spark, d):
    return labels.self_loop_nodes(V.circles(spark, d))


@query("cycle_heavy_labels", views="circles", sql=_CIRCLE_REFS + ", held AS (SELECT * FROM circles)" + f"""
    SELECT node AS node_id FROM refs LEFT JOIN {_C2} c2 USING (node) LEFT JOIN {_C3} c3 USING (node)
    WHERE coalesce(c2.n, 0) + coalesce(c3.n, 0) > 1""".replace("3600", "15552000").replace("7200", "31104000"))
def cycle_heavy_labels(spark, d):
    """Cycles of the payment circles with a gap of 180 days."""
    return labels.cycle_heavy_nodes(patterns.pattern_features(V.circles(spark, d), evicting=False, gap=15552000), 1)


_LAYER = """(SELECT node AS node_id FROM (
    SELECT node, count(*) FILTER (o = 1) AS od, count(*) FILTER (o = 0) AS id FROM sides GROUP BY node)
    WHERE od > 3 AND id > 3 AND od / CAST(id AS DOUBLE) > 0.3 AND od / CAST(id AS DOUBLE) < 3.0)"""
_PAIRS = """, pairs AS (SELECT DISTINCT src, dst FROM circles),
    sides AS (SELECT src AS node, 1 AS o FROM pairs UNION ALL SELECT dst, 0 FROM pairs)"""


@query("layering_labels", views="circles", sql=f"{_PAIRS} SELECT node_id FROM {_LAYER}")
def layering_labels(spark, d):
    f = features.address_features(V.circles(spark, d), with_rank=False)
    return labels.layering_nodes(f, 3)


@query("known_labels", views="transactions", sql=f"""{_INDEX}
    SELECT node_id FROM index WHERE address IN ('0x0000000000000000000000000000000000000005', '0x0000000000000000000000000000000000000007', '0xnone')""")
def known_labels(spark, d):
    index = graph.build_address_index(V.transactions(spark, d))
    known = [f"0x{n:040x}" for n in (5, 7)] + ["0xnone"]
    return labels.known_labels(index, "dao_hack", known)


@query("strong_components", views="strong", sql="SELECT node_id, component FROM strong")
def strong_components(spark, d):
    return components.strong_components(V.circles(spark, d))


@query("component_density", views="densities", sql="SELECT component, size, edges, round(density, 9) AS density FROM densities")
def component_density(spark, d):
    e = V.circles(spark, d)
    return labels.component_density(e, components.strong_components(e)).withColumn("density", F.round("density", 9))


@query("dense_component_labels", views="densities strong", sql="""
    SELECT s.node_id FROM strong s JOIN densities x USING (component) WHERE x.size BETWEEN 3 AND 50 AND x.density > 0.3""")
def dense_component_labels(spark, d):
    return labels.dense_component_nodes(V.circles(spark, d))


_CIRCLE_HELD = """, refs AS (SELECT node, max(t) AS ref FROM (SELECT src AS node, t FROM circles UNION ALL SELECT dst, t FROM circles) GROUP BY node),
    held AS (SELECT * FROM circles)"""
_LABELS = f"""{_CIRCLE_HELD}{_PAIRS},
    nodes AS (SELECT DISTINCT node AS node_id FROM sides),
    flags AS (SELECT n.node_id, n.node_id IN (SELECT src FROM pairs WHERE src = dst) OR n.node_id IN (SELECT node_id FROM {_LAYER}) OR n.node_id IN (
            SELECT node FROM refs LEFT JOIN {_C2} c2 USING (node) LEFT JOIN {_C3} c3 USING (node) WHERE coalesce(c2.n, 0) + coalesce(c3.n, 0) > 10) AS heuristic,
        n.node_id IN (SELECT s.node_id FROM strong s JOIN densities x USING (component) WHERE x.size BETWEEN 3 AND 50 AND x.density > 0.3) AS structural,
        n.node_id % 97 = 0 AS known FROM nodes n)"""


def _labels(spark, d):
    e = V.circles(spark, d)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    known = nodes.filter("node_id % 97 = 0")
    return labels.generate_labels(
        nodes, e, patterns.pattern_features(e, evicting=False), features.address_features(e, with_rank=False), known, **_THRESHOLDS)


@query("generate_labels", views="circles densities strong", sql=f"""{_LABELS}
    SELECT node_id, known, heuristic, structural, CAST(known OR heuristic OR structural AS INTEGER) AS label FROM flags""")
def generate_labels(spark, d):
    return _labels(spark, d)


@query("label_summary", views="circles densities strong", sql=f"""{_LABELS}
    SELECT count(*) FILTER (known) AS known, count(*) FILTER (heuristic) AS heuristic, count(*) FILTER (structural) AS structural,
           count(*) FILTER (known OR heuristic OR structural) AS fraud, count(*) AS nodes,
           round(count(*) FILTER (known OR heuristic OR structural) * 100.0 / count(*), 6) AS fraud_percent FROM flags""")
def label_summary(spark, d):
    return labels.label_summary(_labels(spark, d)).withColumn("fraud_percent", F.round(F.col("fraud_percent").cast("double"), 6))


# ---------------------------------------------------------------- rings

def _rings(spark, d):
    e, l = V.flows(spark, d), V.flow_labels(spark, d)
    members = rings.ring_members(e, l)
    return members, rings.ring_summary(members, rings.fraud_edges(e, l))


@query("connected_components", views="components", sql="SELECT node_id, component FROM components")
def connected_components(spark, d):
    return components.connected_components(rings.fraud_edges(V.flows(spark, d), V.flow_labels(spark, d)))


@query("fraud_rings", views="ring_members", sql="SELECT ring_id, node_id FROM ring_members")
def fraud_rings(spark, d):
    return _rings(spark, d)[0]


@query("ring_summary", views="rings", sql="SELECT * FROM rings")
def ring_summary(spark, d):
    return _rings(spark, d)[1]


@query("ring_size_stats", views="rings", sql="""
    SELECT count(*) AS rings, min(num_members) AS min_size, max(num_members) AS max_size, round(avg(num_members), 9) AS mean_size,
           CAST(sum(num_members) AS BIGINT) AS total_members FROM rings""")
def ring_size_stats(spark, d):
    return rings.ring_size_stats(_rings(spark, d)[1]).withColumn("mean_size", F.round("mean_size", 9))


@query("largest_rings", views="rings", sql="SELECT ring_id, num_members FROM rings ORDER BY num_members DESC, ring_id LIMIT 5")
def largest_rings(spark, d):
    return rings.largest_rings(_rings(spark, d)[1]).select("ring_id", "num_members")


@query("ring_neighbourhood", views="ring_members flows", sql="""
    , und AS (SELECT src AS a, dst AS b FROM flows UNION SELECT dst, src FROM flows),
    near AS (SELECT DISTINCT m.ring_id, u.b AS node_id FROM ring_members m JOIN und u ON u.a = m.node_id)
    SELECT n.ring_id, n.node_id FROM near n LEFT JOIN ring_members x ON x.ring_id = n.ring_id AND x.node_id = n.node_id WHERE x.node_id IS NULL""")
def ring_neighbourhood(spark, d):
    return rings.ring_neighbourhood(_rings(spark, d)[0], V.flows(spark, d))


@query("ring_activity", views="ring_members flows", sql="""
    , s AS (SELECT *, row_number() OVER (ORDER BY t, edge_id) - 1 AS seq, count(*) OVER () AS n FROM flows),
    b AS (SELECT src, dst, least(seq // greatest(n // 20, 1), 19) AS block FROM s),
    c AS (SELECT node, block, count(*) AS n FROM (SELECT src AS node, block FROM b UNION ALL SELECT dst, block FROM b)
          WHERE node IN (SELECT node_id FROM ring_members) GROUP BY node, block)
    SELECT node AS node_id, block, n, round(n / CAST(max(n) OVER (PARTITION BY node) AS DOUBLE), 9) AS activity FROM c""")
def ring_activity(spark, d):
    e = sequence.edge_seq(V.flows(spark, d))
    return rings.ring_activity(_rings(spark, d)[0], e, e.count()).withColumn("activity", F.round("activity", 9))


# ---------------------------------------------------------------- subgraphs

def _seeds(spark, d):
    return V.circles(spark, d).select(F.col("src").alias("node_id")).distinct()


def _subgraphs(spark, d, *columns):
    """Subgraphs of all senders; their edges have all ``columns`` of the table, or those that are named."""
    e = V.circles(spark, d)
    return hops.subgraphs(e.select(*columns) if columns else e, _seeds(spark, d))


@query("k_hop_nodes", views="hood", sql="SELECT seed, node_id FROM hood")
def k_hop_nodes(spark, d):
    return hops.k_hop_nodes(V.circles(spark, d), _seeds(spark, d))


@query("limited_subgraphs", views="hood", sql="""
    SELECT seed, node_id FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY node_id) AS rn FROM hood) WHERE rn <= 300""")
def limited_subgraphs(spark, d):
    return hops.limit_nodes(hops.k_hop_nodes(V.circles(spark, d), _seeds(spark, d)), 300)


@query("subgraph_edges", views="sub_edges", sql="SELECT seed, edge_id, src, dst FROM sub_edges")
def subgraph_edges(spark, d):
    return _subgraphs(spark, d)[1].select("seed", "edge_id", "src", "dst")


@query("anchors", views="anchor_points", sql="SELECT seed, anchor, CAST(slot AS INTEGER) AS slot FROM anchor_points")
def anchors(spark, d):
    nodes, inner = _subgraphs(spark, d)
    return hops.anchors(inner, nodes)


@query("hop_distances", views="distances", sql="SELECT seed, anchor, node_id, dist FROM distances")
def hop_distances(spark, d):
    nodes, inner = _subgraphs(spark, d)
    return hops.hop_distances(inner, hops.anchors(inner, nodes))


def _encoding_sql(missing: str) -> str:
    slots = ", ".join(
        f"round(CASE WHEN top > 0 THEN greatest(1.0 - d{i} / CAST(top AS DOUBLE), 0) ELSE d{i} END, 9) AS pe_{i}" for i in range(16))
    wide = ", ".join(f"CAST(coalesce(max(dist) FILTER (slot = {i}), 0) AS DOUBLE) AS d{i}" for i in range(16))
    return f""", sizes AS (SELECT seed, count(*) AS n FROM sub_nodes GROUP BY seed),
    filled AS (SELECT n.seed, n.node_id, a.slot, coalesce(x.dist, {missing}) AS dist FROM sub_nodes n JOIN anchor_points a USING (seed) JOIN sizes z USING (seed)
        LEFT JOIN distances x ON x.seed = n.seed AND x.anchor = a.anchor AND x.node_id = n.node_id),
    wide AS (SELECT seed, node_id, {wide} FROM filled GROUP BY seed, node_id),
    tops AS (SELECT seed, max(dist) AS top FROM filled GROUP BY seed)
    SELECT seed, node_id, {slots} FROM wide JOIN tops USING (seed)"""


def _encoding(spark, d, mode):
    nodes, inner = _subgraphs(spark, d, "edge_id", "src", "dst")
    pe = hops.position_encoding(nodes, inner, unreachable=mode)
    return pe.select("seed", "node_id", *[F.round(f"pe_{i}", 9).alias(f"pe_{i}") for i in range(16)])


@query("position_encoding", views="distances", sql=_encoding_sql("0"))
def position_encoding(spark, d):
    return _encoding(spark, d, "near")


@query("position_encoding_far", views="distances", sql=_encoding_sql("z.n"))
def position_encoding_far(spark, d):
    return _encoding(spark, d, "far")


@query("subgraph_pool_features", views="sub_nodes sub_edges", sql="""
    , f AS (SELECT node_id, CAST(count(*) AS DOUBLE) AS x, CAST(max(node_id) % 7 AS DOUBLE) AS y FROM sub_nodes GROUP BY node_id),
    r AS (SELECT s.seed, f.x, f.y FROM sub_nodes s JOIN f USING (node_id)),
    flat AS (SELECT seed, x AS v FROM r UNION ALL SELECT seed, y FROM r)
    SELECT a.seed, round(a.mean_x, 6) AS mean_x, round(a.std_x, 6) AS std_x, a.max_x, a.min_x, a.n AS num_nodes, e.n AS num_edges,
           round(e.n / CAST(a.n AS DOUBLE), 6) AS edge_density, round(o.m, 6) AS overall_mean, round(o.s, 5) AS overall_std
    FROM (SELECT seed, avg(x) AS mean_x, stddev_samp(x) AS std_x, max(x) AS max_x, min(x) AS min_x, count(*) AS n FROM r GROUP BY seed) a
    JOIN (SELECT seed, count(*) AS n FROM sub_edges GROUP BY seed) e USING (seed)
    JOIN (SELECT seed, avg(v) AS m, stddev_samp(v) AS s FROM flat GROUP BY seed) o USING (seed)""")
def subgraph_pool_features(spark, d):
    nodes, inner = _subgraphs(spark, d)
    f = nodes.groupBy("node_id").agg(F.count("*").cast("double").alias("x")).withColumn("y", (F.col("node_id") % 7).cast("double"))
    p = hops.subgraph_pool_features(nodes, inner, f, ["x", "y"])
    digits = {"mean_x": 6, "std_x": 6, "edge_density": 6, "overall_mean": 6, "overall_std": 5}
    return p.withColumns({c: F.round(c, n) for c, n in digits.items()}).select(
        "seed", "mean_x", "std_x", "max_x", "min_x", "num_nodes", "num_edges", "edge_density", "overall_mean", "overall_std")


# ---------------------------------------------------------------- PageRank

# Rounds of the SQL twin; far past the point where both stop moving.
_ROUNDS = 120


def _pagerank_sql() -> str:
    steps = []
    for i in range(1, _ROUNDS + 1):
        prev = f"r{i - 1}"
        steps.append(f"""r{i} AS MATERIALIZED (SELECT n.node_id, n.deg,
            (coalesce(a.s, 0) + (SELECT coalesce(sum(r) FILTER (deg = 0), 0) FROM {prev}) / (SELECT count(*) FROM nodes)) * 0.85
            + 0.15 / (SELECT count(*) FROM nodes) AS r FROM nodes n
            LEFT JOIN (SELECT p.dst, sum(x.r / x.deg) AS s FROM pairs p JOIN {prev} x ON x.node_id = p.src GROUP BY p.dst) a ON a.dst = n.node_id)""")
    return """, pairs AS (SELECT DISTINCT src, dst FROM circles),
    nodes AS (SELECT v.node_id, coalesce(o.deg, 0) AS deg FROM (SELECT src AS node_id FROM pairs UNION SELECT dst FROM pairs) v
        LEFT JOIN (SELECT src, count(*) AS deg FROM pairs GROUP BY src) o ON o.src = v.node_id),
    r0 AS (SELECT node_id, deg, CAST(1.0 AS DOUBLE) / (SELECT count(*) FROM nodes) AS r FROM nodes), """ + ",\n".join(steps) + f"""
    SELECT node_id, round(r * 1e6, 4) AS micro_rank FROM r{_ROUNDS}"""


@query("pagerank", views="circles", sql=_pagerank_sql())
def pagerank_rounds(spark, d):
    """Rounds until the ranks stand still."""
    ranks = pagerank.pagerank(V.circles(spark, d), max_rounds=4 * _ROUNDS, tolerance=1e-15)
    return ranks.select("node_id", F.round(F.col("pagerank") * 1e6, 4).alias("micro_rank"))


# ---------------------------------------------------------------- sampling (seeded hashes: no SQL twin)

@query("balanced_seeds")
def balanced_seeds(spark, d):
    return sampling.balanced_seeds(V.flow_labels(spark, d), sampling.SEEDS_PER_CLASS)


@query("capped_edges", views="edges", sql="SELECT count(*) // 2 AS n, count(DISTINCT edge_id) // 2 AS ids FROM edges")
def capped_edges(spark, d):
    """A sample of half the edges."""
    e = V.edges(spark, d)
    return sampling.cap_edges(e, e.count() // 2).agg(F.count("*").alias("n"), F.count_distinct("edge_id").alias("ids"))


@query("split_sizes", views="flow_labels", sql="""
    , n AS (SELECT label, count(*) AS n FROM flow_labels GROUP BY label)
    SELECT label, CAST(floor(0.7 * n) AS BIGINT) AS train, CAST(floor(0.85 * n) AS BIGINT) - CAST(floor(0.7 * n) AS BIGINT) AS val,
           n - CAST(floor(0.85 * n) AS BIGINT) AS test FROM n""")
def split_sizes(spark, d):
    parts = sampling.split_70_15_15(V.flow_labels(spark, d), "node_id", stratify="label")
    return parts.groupBy("label").agg(*[F.count_if(F.col("part") == p).alias(p) for p in ("train", "val", "test")])


@query("random_split", views="flow_labels", sql="""
    , n AS (SELECT count(*) AS n FROM flow_labels)
    SELECT CAST(floor(0.7 * n) AS BIGINT) AS train, CAST(floor(0.15 * n) AS BIGINT) AS val, n - CAST(floor(0.7 * n) AS BIGINT) - CAST(floor(0.15 * n) AS BIGINT) AS test FROM n""")
def random_split(spark, d):
    parts = sampling.split_70_15_15(V.flow_labels(spark, d), "node_id")
    return parts.agg(*[F.count_if(F.col("part") == p).alias(p) for p in ("train", "val", "test")])


@query("scarce_subset", views="flow_labels", sql="""
    , w AS (SELECT greatest(CAST(floor(count(*) * 0.05) AS BIGINT), 8) AS w FROM flow_labels)
    SELECT label, CASE WHEN label = 1 THEN greatest(2, w // 2) ELSE w - greatest(2, w // 2) END AS n FROM (SELECT DISTINCT label FROM flow_labels), w""")
def scarce_subset(spark, d):
    return sampling.scarce_subset(V.flow_labels(spark, d), 0.05).groupBy("label").agg(F.count("*").alias("n"))


@query("mask_features")
def mask_features(spark, d):
    nodes, _ = _subgraphs(spark, d)
    f = nodes.withColumns({"x": F.lit(1.0), "y": F.lit(1.0)})
    return sampling.mask_features(f, ["x", "y"])


@query("drop_edges")
def drop_edges(spark, d):
    return sampling.drop_edges(_subgraphs(spark, d)[1])


@query("drop_nodes")
def drop_nodes(spark, d):
    return sampling.drop_nodes(*_subgraphs(spark, d))[1]


@query("crop_subgraphs")
def crop_subgraphs(spark, d):
    return sampling.crop(*_subgraphs(spark, d))[0]


@query("combined_augmentation")
def combined_augmentation(spark, d):
    nodes, inner = _subgraphs(spark, d, "edge_id", "src", "dst")
    f = nodes.withColumn("x", F.lit(1.0))
    return sampling.combined(nodes, inner, f, ["x"])[2]
