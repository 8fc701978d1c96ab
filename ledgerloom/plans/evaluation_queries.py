"""Queries of the evaluation and model families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..evaluation import curves, metrics
from ..models import tiers
from ..operators import features, graph, patterns, rings, sequence
from . import views as V
from .graph_queries import _rings
from .registry import query


def _scored(spark, d):
    """Events as scored rows: value is the score, an even hour of day the truth."""
    return V.table(spark, d, "events").select(
        "event_id", F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("label"),
        F.col("event_type"), (F.col("user_id") % 4).cast("string").alias("config"))


_SCORED = """WITH scored AS (SELECT event_id, value AS score, CAST(event_type = 'error' AS INTEGER) AS label, event_type,
    CAST(user_id % 4 AS VARCHAR) AS config FROM events),
counts AS (SELECT score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM scored GROUP BY score),
points AS (SELECT score, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
    CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n FROM counts WINDOW w AS (ORDER BY score DESC)),
curve AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS prec, tp / CAST(p AS DOUBLE) AS tpr, fp / CAST(n AS DOUBLE) AS fpr FROM points)"""


@query("roc_curve", sql=_SCORED + " SELECT score, tp, fp, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM curve")
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return curves.curve(_scored(spark, d)).select("score", "tp", "fp", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("pr_curve", sql=_SCORED + " SELECT score, round(prec, 9) AS precision, round(tpr, 9) AS recall FROM curve")
def pr_curve(spark, d):
    return curves.curve(_scored(spark, d)).select("score", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("auc_roc", sql=_SCORED + """
    SELECT round(sum(neg * (tp - pos) + neg * pos / 2.0) / (CAST(max(p) AS DOUBLE) * max(n)), 9) AS auc_roc FROM curve""")
def auc_roc(spark, d):
    return curves.auc_roc(curves.curve(_scored(spark, d))).select(F.round("auc_roc", 9).alias("auc_roc"))


@query("pr_auc", sql=_SCORED + """
    , steps AS (SELECT tpr, prec, coalesce(lag(tpr) OVER (ORDER BY score DESC), 0) AS r0, coalesce(lag(prec) OVER (ORDER BY score DESC), 1) AS p0 FROM curve)
    SELECT round(sum((tpr - r0) * (prec + p0) / 2), 9) AS pr_auc FROM steps""")
def pr_auc(spark, d):
    return curves.pr_auc(curves.curve(_scored(spark, d))).select(F.round("pr_auc", 9).alias("pr_auc"))


@query("average_precision", sql=_SCORED + " SELECT round(sum(pos / CAST(p AS DOUBLE) * prec), 9) AS average_precision FROM curve")
def average_precision(spark, d):
    return curves.average_precision(curves.curve(_scored(spark, d))).select(F.round("average_precision", 9).alias("average_precision"))


@query("youden_threshold", sql=_SCORED + " SELECT score AS threshold FROM curve ORDER BY round(tpr - fpr, 12) DESC, score DESC LIMIT 1")
def youden_threshold(spark, d):
    return curves.youden_threshold(curves.curve(_scored(spark, d)))


@query("pr_optimal_threshold", sql=_SCORED + """
    SELECT score AS threshold, round(2 * tp / CAST(tp + fp + p AS DOUBLE), 9) AS f1 FROM curve
    ORDER BY round(2 * tp / CAST(tp + fp + p AS DOUBLE), 12) DESC, score LIMIT 1""")
def pr_optimal_threshold(spark, d):
    return curves.pr_optimal_threshold(curves.curve(_scored(spark, d))).withColumn("f1", F.round("f1", 9))


@query("auc_per_config", sql="""
    WITH s AS (SELECT CAST(user_id % 4 AS VARCHAR) AS config, value AS score, CAST(event_type = 'error' AS INTEGER) AS label FROM events),
    c AS (SELECT config, score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY config, score),
    q AS (SELECT *, sum(pos) OVER (PARTITION BY config ORDER BY score DESC) AS tp FROM c)
    SELECT config, round(CAST(sum(neg * (tp - pos) + neg * pos / 2.0) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 9) AS auc_roc FROM q GROUP BY config""")
def auc_per_config(spark, d):
    by = ["config"]
    return curves.auc_roc(curves.curve(_scored(spark, d), by=by), by).withColumn("auc_roc", F.round("auc_roc", 9))


def _judged(spark, d):
    return V.table(spark, d, "events").select(
        (F.col("value") > 50).cast("int").alias("predicted"), (F.col("event_type") == "error").cast("int").alias("actual"),
        F.col("value").alias("latency_ms"), (F.col("user_id") % 250).alias("num_nodes"), "event_type")


_JUDGED = """WITH judged AS (SELECT CAST(value > 50 AS INTEGER) AS predicted, CAST(event_type = 'error' AS INTEGER) AS actual, value AS latency_ms,
    user_id % 250 AS num_nodes, event_type FROM events)"""
_COUNTS = """SELECT count(*) FILTER (predicted = 1 AND actual = 1) AS tp, count(*) FILTER (predicted = 1 AND actual = 0) AS fp,
    count(*) FILTER (predicted = 0 AND actual = 0) AS tn, count(*) FILTER (predicted = 0 AND actual = 1) AS fn FROM judged"""


@query("confusion_counts", sql=f"{_JUDGED} {_COUNTS}")
def confusion_counts(spark, d):
    return metrics.confusion(_judged(spark, d))


@query("confusion_metrics", sql=f"""{_JUDGED}, c AS ({_COUNTS})
    SELECT round(tp / CAST(tp + fp AS DOUBLE), 9) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 9) AS recall,
           round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 9) AS f1,
           round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc,
           round((tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE), 9) AS accuracy FROM c""")
def confusion_metrics(spark, d):
    m = metrics.confusion_metrics(metrics.confusion(_judged(spark, d)))
    return m.select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "mcc", "accuracy")])


@query("confusion_no_positives", sql="""
    SELECT CAST(0 AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, count(*) AS tn, CAST(0 AS BIGINT) AS fn, CAST(0 AS DOUBLE) AS precision,
           CAST(0 AS DOUBLE) AS recall, CAST(0 AS DOUBLE) AS f1, CAST(0 AS DOUBLE) AS mcc, CAST(1 AS DOUBLE) AS accuracy FROM events""")
def confusion_no_positives(spark, d):
    """Nothing predicted and nothing true: every undefined ratio is 0."""
    none = _judged(spark, d).withColumns({"predicted": F.lit(0), "actual": F.lit(0)})
    return metrics.confusion_metrics(metrics.confusion(none))


@query("latency_summary", sql=_JUDGED + """
    SELECT event_type, count(*) AS total_processed, round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95,
           round(quantile_cont(latency_ms, 0.99), 6) AS latency_p99, round(avg(latency_ms), 6) AS latency_mean, round(stddev_pop(latency_ms), 6) AS latency_std,
           round(count(*) / greatest(sum(latency_ms) / 1000, 0.001), 6) AS throughput_per_sec FROM judged GROUP BY event_type""")
def latency_summary(spark, d):
    s = metrics.latency_summary(_judged(spark, d), by=["event_type"])
    return s.select("event_type", "total_processed", *[F.round(c, 6).alias(c) for c in s.columns if c not in ("event_type", "total_processed")])


@query("latency_by_size", sql=_JUDGED + """
    , b AS (SELECT *, CASE WHEN num_nodes < 10 THEN '<10' WHEN num_nodes < 50 THEN '10-50' WHEN num_nodes < 100 THEN '50-100'
        WHEN num_nodes < 200 THEN '100-200' ELSE '200+' END AS bucket FROM judged)
    SELECT bucket, count(*) AS total_processed, round(avg(num_nodes), 6) AS avg_nodes, round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50,
           round(quantile_cont(latency_ms, 0.99), 6) AS latency_p99 FROM b GROUP BY bucket""")
def latency_by_size(spark, d):
    return metrics.latency_by_size(_judged(spark, d)).select(
        "bucket", "total_processed", *[F.round(c, 6).alias(c) for c in ("avg_nodes", "latency_p50", "latency_p99")])


@query("accuracy_at_latency", sql=_JUDGED + """
    SELECT CAST(b AS DOUBLE) AS budget_ms, count(latency_ms) AS rows, round(coalesce(avg(CASE WHEN predicted = actual THEN 1.0 WHEN latency_ms IS NOT NULL THEN 0.0 END), 0), 9) AS accuracy
    FROM (VALUES (5), (10), (25), (50), (100), (250), (500)) v(b) LEFT JOIN judged ON latency_ms <= b GROUP BY b""")
def accuracy_at_latency(spark, d):
    return metrics.accuracy_at_latency(_judged(spark, d)).withColumn("accuracy", F.round("accuracy", 9))


@query("tier_availability", sql="""
    WITH tiers AS (SELECT event_type AS tier, quantile_cont(value, 0.5) / 10 AS p50, round(avg(value) / 100, 6) AS auc, round(stddev_pop(value) / 100, 6) AS f1 FROM events GROUP BY event_type),
    g AS (SELECT tier, CAST(b AS DOUBLE) AS budget_ms, CASE WHEN p50 <= b THEN auc ELSE 0 END AS auc, CASE WHEN p50 <= b THEN f1 ELSE 0 END AS f1 FROM tiers,
        (VALUES (0.01), (0.05), (0.1), (0.2), (0.5), (1.0), (2.0), (5.0), (10.0), (25.0), (50.0), (100.0), (250.0), (500.0)) v(b))
    SELECT tier, budget_ms, auc, f1 FROM g UNION ALL SELECT 'cascade', budget_ms, max(auc), max(f1) FROM g GROUP BY budget_ms""")
def tier_availability(spark, d):
    t = V.table(spark, d, "events").groupBy(F.col("event_type").alias("tier")).agg(
        (F.percentile("value", 0.5) / 10).alias("p50_ms"), F.round(F.avg("value") / 100, 6).alias("auc"),
        F.round(F.stddev_pop("value") / 100, 6).alias("f1"))
    return metrics.tier_availability(t)


_CASCADE = """WITH s AS (SELECT event_id, (user_id * 37 % 100) / 100.0 AS s1, (event_id * 53 % 100) / 100.0 AS s2, ((user_id + event_id) * 17 % 100) / 100.0 AS s3 FROM events),
    r AS (SELECT event_id, CAST(s1 AS DOUBLE) AS s1, CAST(s2 AS DOUBLE) AS s2, CAST(s3 AS DOUBLE) AS s3,
        CASE WHEN s1 < 0.5 THEN 'SAFE' WHEN s2 < 0.5 THEN 'SUSPICIOUS' WHEN s3 >= 0.5 THEN 'FRAUD_RING' ELSE 'LIKELY_FRAUD' END AS result FROM s)"""


def _cascade_rows(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    rows = V.table(spark, d, "events").select(
        "event_id", ((u * 37) % 100 / 100).alias("tier1_score"), ((e * 53) % 100 / 100).alias("tier2_score"), (((u + e) * 17) % 100 / 100).alias("tier3_score"))
    return tiers.decide(rows)


@query("cascade_decisions", sql=_CASCADE + """
    SELECT event_id, result, CASE result WHEN 'SAFE' THEN round(1 - s1, 9) WHEN 'SUSPICIOUS' THEN s2 ELSE s3 END AS confidence,
           CAST(CASE result WHEN 'SAFE' THEN 1 WHEN 'SUSPICIOUS' THEN 2 ELSE 3 END AS INTEGER) AS tier_reached FROM r""")
def cascade_decisions(spark, d):
    return _cascade_rows(spark, d).select("event_id", "result", F.round("confidence", 9).alias("confidence"), "tier_reached")


@query("tier_distribution", sql=_CASCADE + """
    , c AS (SELECT count(*) AS total, count(*) FILTER (result = 'SAFE') AS safe, count(*) FILTER (result = 'SUSPICIOUS') AS suspicious,
        count(*) FILTER (result = 'FRAUD_RING') AS fraud_ring, count(*) FILTER (result = 'LIKELY_FRAUD') AS likely_fraud FROM r)
    SELECT *, round(1 - (total - safe) / CAST(total AS DOUBLE), 9) AS tier1_filter_rate,
           round(1 - (total - safe - suspicious) / CAST(total - safe AS DOUBLE), 9) AS tier2_filter_rate FROM c""")
def tier_distribution(spark, d):
    t = metrics.tier_distribution(_cascade_rows(spark, d))
    return t.withColumns({c: F.round(c, 9) for c in ("tier1_filter_rate", "tier2_filter_rate")})


def _runs(spark, d):
    """Runs: one per (event type, day), with mean and largest value as metrics."""
    return V.table(spark, d, "events").groupBy(
        F.col("event_type").alias("config"), F.dayofmonth(F.col("ts").cast("date")).cast("bigint").alias("seed")
    ).agg(F.avg("value").alias("auc"), F.max("value").alias("f1"))


_RUNS = """WITH runs AS (SELECT event_type AS config, CAST(day(ts) AS BIGINT) AS seed, avg(value) AS auc, max(value) AS f1 FROM events GROUP BY ALL)"""


@query("runs_summary", sql=_RUNS + """
    , long AS (SELECT config, 'auc' AS metric, auc AS v FROM runs UNION ALL SELECT config, 'f1', f1 FROM runs)
    SELECT config, metric, count(*) AS runs, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM long GROUP BY config, metric""")
def runs_summary(spark, d):
    return metrics.runs_summary(_runs(spark, d), ["auc", "f1"]).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("paired_comparison", sql=_RUNS + """
    , long AS (SELECT config, seed, 'auc' AS metric, auc AS v FROM runs UNION ALL SELECT config, seed, 'f1', f1 FROM runs),
    p AS (SELECT a.metric, a.v AS x, b.v AS y FROM long a JOIN long b ON a.seed = b.seed AND a.metric = b.metric AND a.config = 'click' AND b.config = 'view'),
    s AS (SELECT metric, count(*) AS n, avg(x) AS ma, avg(y) AS mb, avg(x - y) AS d, stddev_samp(x - y) AS sd, sqrt((var_samp(x) + var_samp(y)) / 2) AS pooled FROM p GROUP BY metric)
    SELECT metric, n, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(d, 6) AS diff, round(d / (sd / sqrt(n)), 6) AS t_stat, round(d / pooled, 6) AS cohens_d,
           CASE WHEN abs(d / pooled) < 0.2 THEN 'negligible' WHEN abs(d / pooled) < 0.5 THEN 'small' WHEN abs(d / pooled) < 0.8 THEN 'medium' ELSE 'large' END AS effect_size,
           round(d - 2.045230 * sd / sqrt(n), 6) AS ci_low, round(d + 2.045230 * sd / sqrt(n), 6) AS ci_high FROM s""")
def paired_comparison(spark, d):
    """Thirty common days, so 29 degrees of freedom."""
    p = metrics.paired_comparison(_runs(spark, d), "click", "view", ["auc", "f1"])
    numbers = ["mean_a", "mean_b", "diff", "t_stat", "cohens_d", "ci_low", "ci_high"]
    return p.select("metric", "n", "effect_size", *[F.round(c, 6).alias(c) for c in numbers])


# ---------------------------------------------------------------- ring timeliness

def _detections(spark, d):
    """First time each fraud node sends or receives more than 300 000."""
    e = V.flows(spark, d).withColumn("score", F.col("value") / 500000)
    return metrics.first_detection(e, V.flow_labels(spark, d), 0.6)


_DETECT = """, det AS (SELECT node AS node_id, min(t) AS detection_time FROM (
        SELECT src AS node, t FROM flows WHERE value / 500000 >= 0.6 UNION ALL SELECT dst, t FROM flows WHERE value / 500000 >= 0.6)
    WHERE node IN (SELECT node_id FROM flow_labels WHERE label = 1) GROUP BY node)"""
_SEEN = _DETECT + """, seen AS (SELECT m.ring_id, m.node_id, det.detection_time AS dt, r.start_time AS st, r.completion_time AS ct, r.num_members
    FROM ring_members m JOIN rings r USING (ring_id) LEFT JOIN det USING (node_id)),
    per_ring AS (SELECT ring_id, count(*) AS members, count(*) FILTER (dt < ct) AS early FROM seen GROUP BY ring_id)"""


@query("first_detection", views="flows flow_labels", sql=_DETECT + " SELECT node_id, detection_time FROM det")
def first_detection(spark, d):
    return _detections(spark, d)


@query("detections_of_rings", views="rings ring_members flow_labels", sql=_SEEN + " SELECT ring_id, node_id, dt AS detection_time FROM seen WHERE dt IS NOT NULL")
def detections_of_rings(spark, d):
    members, _ = _rings(spark, d)
    return _detections(spark, d).join(members, "node_id").select("ring_id", "node_id", "detection_time")


@query("rdt", views="rings ring_members flow_labels", sql=_SEEN + """
    SELECT round(count(*) FILTER (dt < ct) / CAST(count(*) AS DOUBLE), 9) AS rdt,
           round(sum(CASE WHEN ct > st AND dt < ct THEN least((ct - dt) / CAST(ct - st AS DOUBLE), 1.0) ELSE 0 END) / count(*) FILTER (ct > st), 9) AS rdt_weighted
    FROM seen WHERE dt IS NOT NULL""")
def rdt(spark, d):
    members, summary = _rings(spark, d)
    found = _detections(spark, d).join(members, "node_id")
    return metrics.rdt(found, summary).select(F.round("rdt", 9).alias("rdt"), F.round("rdt_weighted", 9).alias("rdt_weighted"))


@query("ring_rdt", views="rings ring_members flow_labels", sql=_SEEN + """
    SELECT ring_id, members, early AS detected_before_completion, round(early / CAST(members AS DOUBLE), 9) AS rdt FROM per_ring""")
def ring_rdt(spark, d):
    members, summary = _rings(spark, d)
    return metrics.ring_rdt(members, summary, _detections(spark, d)).withColumn("rdt", F.round("rdt", 9))


@query("ring_rates", views="rings ring_members flow_labels", sql=_SEEN + """
    SELECT count(*) AS rings, count(*) FILTER (early > 0) AS rings_detected, round(count(*) FILTER (early > 0) / CAST(count(*) AS DOUBLE), 9) AS ring_rate,
           round(coalesce(count(*) FILTER (early > 0 AND members <= 3) / CAST(nullif(count(*) FILTER (members <= 3), 0) AS DOUBLE), 0), 9) AS small_ring_rate,
           round(coalesce(count(*) FILTER (early > 0 AND members >= 5) / CAST(nullif(count(*) FILTER (members >= 5), 0) AS DOUBLE), 0), 9) AS large_ring_rate,
           round(avg(early / CAST(members AS DOUBLE)), 9) AS mean_rdt FROM per_ring""")
def ring_rates(spark, d):
    members, summary = _rings(spark, d)
    r = metrics.ring_rates(metrics.ring_rdt(members, summary, _detections(spark, d)))
    return r.withColumns({c: F.round(c, 9) for c in ("ring_rate", "small_ring_rate", "large_ring_rate", "mean_rdt")})


@query("detection_coverage", views="flows flow_labels", sql=_DETECT + """
    SELECT count(det.node_id) AS detected, count(*) AS fraud_nodes, round(count(det.node_id) / CAST(count(*) AS DOUBLE), 9) AS coverage
    FROM flow_labels l LEFT JOIN det USING (node_id) WHERE l.label = 1""")
def detection_coverage(spark, d):
    return metrics.detection_coverage(_detections(spark, d), V.flow_labels(spark, d)).withColumn("coverage", F.round("coverage", 9))


# ---------------------------------------------------------------- models

@query("edge_vectors", views="circles", sql="""
    , refs AS (SELECT node, max(t) AS ref FROM (SELECT src AS node, t FROM circles UNION ALL SELECT dst, t FROM circles) GROUP BY node),
    o AS (SELECT r.node, count(DISTINCT a.dst) AS n FROM refs r JOIN circles a ON a.src = r.node AND abs(r.ref - a.t) <= 3600 GROUP BY r.node)
    SELECT c.edge_id, c.value, CAST(c.t % 86400 AS DOUBLE) AS second_of_day,
           CAST(CASE WHEN a.n >= 3 THEN 1 ELSE 0 END AS DOUBLE) AS src_fan_out_3, CAST(CASE WHEN b.n >= 3 THEN 1 ELSE 0 END AS DOUBLE) AS dst_fan_out_3
    FROM circles c LEFT JOIN o a ON a.node = c.src LEFT JOIN o b ON b.node = c.dst""")
def edge_vectors(spark, d):
    e = V.circles(spark, d)
    return tiers.edge_vectors(e, patterns.pattern_features(e, evicting=False)).select(
        "edge_id", "value", "second_of_day", "src_fan_out_3", "dst_fan_out_3")


@query("class_weights", views="flow_labels", sql="""
    SELECT label, round((SELECT count(*) FROM flow_labels) / (2.0 * count(*)), 9) AS weight FROM flow_labels GROUP BY label""")
def class_weights(spark, d):
    return tiers.class_weights(V.flow_labels(spark, d)).select("label", F.round(F.col("weight").cast("double"), 9).alias("weight"))


def _training_rows(spark, d):
    """Labelled edges with tier-1 inputs, staged once for the many passes of training."""
    from ..session import staged

    e = V.circles(spark, d)
    marked = graph.label_edges(e, V.flow_labels(spark, d))
    vectors = tiers.edge_vectors(marked, patterns.pattern_features(e, evicting=False), graph.node_features(e.withColumn("edge_type", F.lit("tx"))))
    return staged(vectors)


@query("train_tier1")
def train_tier1(spark, d):
    """Boosted trees on the first 60 % of edges by time, evaluated on the rest."""
    columns = tiers.vector_columns(True)
    rows = sequence.warmup_split(_training_rows(spark, d))
    model = tiers.train_boosted(rows.filter("phase = 'train'"), columns)
    return tiers.evaluate(tiers.score(model, rows.filter("phase = 'eval'"), columns))


def _fold(seed: int = 1):
    """Six tenths of the nodes, by hash, are for fitting."""
    return F.pmod(F.xxhash64("node_id", F.lit(seed)), F.lit(10)) < 6


def _node_rows(spark, d):
    e = V.circles(spark, d).withColumn("edge_type", F.lit("tx"))
    f = tiers.two_hop_features(e, graph.node_features(e))
    return f.join(V.flow_labels(spark, d), "node_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def _node_scores(rows, seed: int = 1):
    columns = tiers.two_hop_columns()
    model = tiers.train_logistic(rows.filter(_fold(seed)), columns)
    return tiers.score(model, rows.withColumn("fitted", _fold(seed)), columns).select("node_id", "score", "label", "fitted")


@query("node_scorer")
def node_scorer(spark, d):
    """Two-hop means and a logistic model, fitted on six tenths of the nodes."""
    return _node_scores(_node_rows(spark, d))


def _subgraph_scores(spark, d, seeds):
    """Pooled two-hop subgraph features of each seed, scored by boosted trees fitted on six tenths of all senders."""
    from ..session import cut

    e = V.circles(spark, d).withColumn("edge_type", F.lit("tx"))
    every = e.select(F.col("src").alias("node_id")).distinct()
    pooled, inputs = tiers.pooled_subgraphs(e, graph.node_features(e), every)
    rows = cut(pooled.join(V.flow_labels(spark, d), "node_id", "left").withColumn("label", F.coalesce("label", F.lit(0))))
    model = tiers.train_boosted(rows.filter(_fold()), inputs)
    return tiers.score(model, rows.join(seeds, "node_id", "left_semi"), inputs).select("node_id", "score")


@query("subgraph_scorer")
def subgraph_scorer(spark, d):
    seeds = V.circles(spark, d).select(F.col("src").alias("node_id")).distinct()
    return _subgraph_scores(spark, d, seeds)


@query("ring_members")
def ring_members(spark, d):
    """The members of every subgraph that the fitted tier 3 takes for a ring."""
    from ..session import cut

    e = V.circles(spark, d).withColumn("edge_type", F.lit("tx"))
    scores = cut(_subgraph_scores(spark, d, e.select(F.col("src").alias("node_id")).distinct()))
    return tiers.ring_members(e, scores)


_NEAR = """
    , link AS (SELECT DISTINCT src, dst FROM circles),
    seeds AS (SELECT DISTINCT src AS seed FROM circles),
    near AS (SELECT seed, seed AS node FROM seeds UNION SELECT s.seed, a.src FROM seeds s JOIN link a ON a.dst = s.seed
        UNION SELECT s.seed, b.src FROM seeds s JOIN link a ON a.dst = s.seed JOIN link b ON b.dst = a.src),
    inner_edges AS (SELECT n.seed, count(*) AS m FROM near n JOIN circles c ON c.src = n.node JOIN near o ON o.seed = n.seed AND o.node = c.dst GROUP BY n.seed),
    big AS (SELECT seed FROM near GROUP BY seed HAVING count(*) >= 3 INTERSECT SELECT seed FROM inner_edges WHERE m >= 2)"""


@query("ring_member_rows", views="circles", sql=_NEAR + """
    SELECT n.seed, n.node AS member, (n.seed * 29 + 7) % 100 / CAST(100 AS DOUBLE) AS score FROM near n JOIN big USING (seed) WHERE (n.seed * 29 + 7) % 100 >= 50""")
def ring_member_rows(spark, d):
    """Ring members under given seed scores: every sender's two-hop node set where its score says so."""
    e = V.circles(spark, d)
    scores = e.select(F.col("src").alias("node_id")).distinct().withColumn("score", (F.col("node_id") * 29 + 7) % 100 / F.lit(100.0))
    return tiers.ring_members(e, scores)


@query("cascade_rules", views="circles", sql="""
    , s AS (SELECT edge_id, (edge_id * 37) % 100 / CAST(100 AS DOUBLE) AS s1, greatest(CASE WHEN src % 7 = 0 THEN 50 ELSE src * 13 % 100 END, CASE WHEN dst % 7 = 0 THEN 50 ELSE dst * 13 % 100 END) / CAST(100 AS DOUBLE) AS s2,
        CASE WHEN src % 5 = 0 THEN 0 ELSE (src * 29 + 7) % 100 END / CAST(100 AS DOUBLE) AS s3 FROM circles)
    SELECT edge_id, CASE WHEN s1 < 0.3 THEN 'SAFE' WHEN s2 < 0.4 THEN 'SUSPICIOUS' WHEN s3 >= 0.5 THEN 'FRAUD_RING' ELSE 'LIKELY_FRAUD' END AS result,
        CASE WHEN s1 < 0.3 THEN 1 - s1 WHEN s2 < 0.4 THEN s2 ELSE s3 END AS confidence, CAST(CASE WHEN s1 < 0.3 THEN 1 WHEN s2 < 0.4 THEN 2 ELSE 3 END AS INTEGER) AS tier_reached FROM s""")
def cascade_rules(spark, d):
    """The cascade on given scores; nodes in steps of seven are unknown to tier 2, senders in steps of five to tier 3."""
    e = V.circles(spark, d)
    ends = e.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    nodes = ends.filter("node_id % 7 <> 0").withColumn("score", F.col("node_id") * 13 % 100 / F.lit(100.0))
    rings = lambda seeds: seeds.filter("node_id % 5 <> 0").withColumn("score", (F.col("node_id") * 29 + 7) % 100 / F.lit(100.0))
    scored = e.withColumn("tier1_score", F.col("edge_id") * 37 % 100 / F.lit(100.0))
    return tiers.cascade(scored, nodes, rings, 0.3, 0.4, 0.5).select("edge_id", "result", "confidence", "tier_reached")


@query("cascade")
def cascade(spark, d):
    """All three tiers, each on the edges that reach it; tier 1 is fitted on the first 60 % of edges, tiers 2 and 3 on six tenths of the nodes."""
    from ..session import cut

    columns = tiers.vector_columns(True)
    rows = cut(sequence.warmup_split(_training_rows(spark, d)))
    model = tiers.train_boosted(rows.filter("phase = 'train'"), columns)
    scored = tiers.score(model, rows, columns, "tier1_score").select("edge_id", "src", "dst", "t", "label", "phase", "tier1_score")
    nodes = _node_scores(_node_rows(spark, d)).select("node_id", "score")
    out = tiers.cascade(cut(scored), cut(nodes), lambda seeds: _subgraph_scores(spark, d, seeds))
    return out.select("edge_id", "label", "phase", "result", "confidence", "tier_reached")


@query("cross_period")
def cross_period(spark, d):
    """Every period but the last trains, the last one tests."""
    rows = _training_rows(spark, d)
    periods = [r[0] for r in rows.select("period").distinct().orderBy("period").collect()]
    return tiers.cross_period(rows, tiers.vector_columns(True), periods[:-1], periods[-1])


@query("repeat_runs")
def repeat_runs(spark, d):
    """Three runs, each with its own seeded split of the nodes and its own fit, one row of metrics each."""
    from ..session import cut

    rows = cut(_node_rows(spark, d))
    return tiers.repeat_runs(lambda s: tiers.evaluate(_node_scores(rows, s).filter("NOT fitted")), [1, 2, 3])
