import pytest
from pyspark.sql import functions as F

from ledgerloom.evaluation import curves, metrics
from ledgerloom.models import tiers


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, label int")


def areas(spark, rows):
    points = curves.curve(scored(spark, rows))
    return [f(points).first()[0] for f in (curves.auc_roc, curves.average_precision, curves.pr_auc)]


def test_areas(spark):
    assert areas(spark, [(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)]) == [1.0, 1.0, 1.0]
    auc, ap, pr = areas(spark, [(0.5, 1), (0.5, 0), (0.5, 1), (0.5, 0)])
    assert (auc, ap, pr) == (0.5, 0.5, 0.75)
    auc, ap, _ = areas(spark, [(0.8, 0), (0.7, 1), (0.6, 0), (0.5, 1)])
    assert auc == 0.25 and abs(ap - 0.5) < 1e-12


def test_curve_with_an_outlier_and_ties(spark):
    rows = [(1e12, 0)] + [((i * 7 % 50) / 100, i % 3 % 2) for i in range(200)]
    got = {r.score: (r.tp, r.fp) for r in curves.curve(scored(spark, rows)).collect()}
    want = {s: (sum(y for x, y in rows if x >= s), sum(1 - y for x, y in rows if x >= s)) for s, _ in rows}
    assert got == want


def test_thresholds(spark):
    points = curves.curve(scored(spark, [(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)]))
    assert curves.youden_threshold(points).first()[0] == 0.9
    best = curves.pr_optimal_threshold(points).first()
    assert best.threshold == 0.7 and abs(best.f1 - 0.8) < 1e-9
    one_class = curves.curve(scored(spark, [(0.9, 1), (0.8, 1)]))
    assert curves.youden_threshold(one_class).first()[0] == 0.3


def test_timeliness(spark):
    rings = spark.createDataFrame([(1, 0, 100), (2, 50, 50)], "ring_id bigint, start_time bigint, completion_time bigint")
    found = lambda rows: spark.createDataFrame(rows, "ring_id bigint, node_id bigint, detection_time bigint")
    assert tuple(metrics.rdt(found([]), rings).first()) == (0.0, 0.0)
    assert tuple(metrics.rdt(found([(1, 1, -50), (1, 2, 0)]), rings).first()) == (1.0, 1.0)
    assert tuple(metrics.rdt(found([(1, 1, 50), (1, 2, 100), (2, 3, 10), (9, 9, 0)]), rings).first()) == pytest.approx((2 / 3, 0.25))


def test_ring_rates(spark):
    members = spark.createDataFrame([(1, n) for n in range(3)] + [(2, n) for n in range(10, 15)], "ring_id bigint, node_id bigint")
    rings = spark.createDataFrame([(1, 0, 10), (2, 0, 10)], "ring_id bigint, start_time bigint, completion_time bigint")
    seen = spark.createDataFrame([(0, 5), (1, 10), (10, 11)], "node_id bigint, detection_time bigint")
    per_ring = metrics.ring_rdt(members, rings, seen)
    assert {r.ring_id: (r.members, r.detected_before_completion) for r in per_ring.collect()} == {1: (3, 1), 2: (5, 0)}
    r = metrics.ring_rates(per_ring).first()
    assert (r.ring_rate, r.small_ring_rate, r.large_ring_rate) == (0.5, 1.0, 0.0)


def test_paired_comparison(spark):
    runs = spark.createDataFrame([("a", i, 1.0 + i) for i in range(4)] + [("b", i, 0.5 + i * 1.1) for i in range(4)], "config string, seed bigint, auc double")
    r = metrics.paired_comparison(runs, "a", "b", ["auc"]).first()
    diffs = [0.5 - 0.1 * i for i in range(4)]
    mean = sum(diffs) / 4
    sd = (sum((d - mean) ** 2 for d in diffs) / 3) ** 0.5
    assert abs(r.t_stat - mean / (sd / 2)) < 1e-9 and r.effect_size == "small"
    assert abs(r.ci_high - (mean + 3.182446 * sd / 2)) < 1e-6


def test_cascade_only_scores_escalated_rows(spark):
    rows = spark.createDataFrame([(0, 1, 2, 0.1), (1, 1, 2, 0.9), (2, 3, 4, 0.9), (3, 5, 6, 0.9)], "edge_id bigint, src bigint, dst bigint, tier1_score double")
    nodes = spark.createDataFrame([(1, 0.2), (2, 0.3), (3, 0.9), (6, 0.1)], "node_id bigint, score double")
    asked = []

    def third(seeds):
        asked.extend(sorted(r[0] for r in seeds.collect()))
        return seeds.select("node_id", F.lit(0.7).alias("score")).filter("node_id = 3")

    got = {r.edge_id: (r.result, round(r.confidence, 6), r.tier_reached) for r in tiers.cascade(rows, nodes, third).collect()}
    assert got == {0: ("SAFE", 0.9, 1), 1: ("SUSPICIOUS", 0.3, 2), 2: ("FRAUD_RING", 0.7, 3), 3: ("LIKELY_FRAUD", 0.0, 3)}
    assert asked == [3, 5]


def test_boosted_trees_learn_a_rare_class(spark):
    rows = spark.range(400).select((F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 20 >= 18).cast("int").alias("label"))
    model = tiers.train_boosted(rows, ["x"], rounds=3, depth=2)
    assert tiers.evaluate(tiers.score(model, rows, ["x"])).first().auc_roc == 1.0
    assert {r.label: round(r.weight, 4) for r in tiers.class_weights(rows).collect()} == {0: 0.5556, 1: 5.0}


def test_percentiles_equal_the_aggregate(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1.0, 1.0, rng.random() * 100, None])) for _ in range(3000)]
    rows += [("one", 5.0), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r.g: tuple(r)[1:] for r in metrics.percentiles(df, "x", shares, ["g"]).collect()}
    want = {r.g: tuple(r.p) for r in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, shares.values()))).alias("p")).collect() if r.p}
    assert set(got) == set(want) == {"a", "b", None, "one", "two"}
    for g, values in got.items():
        assert values == pytest.approx(want[g], abs=1e-9)
    whole = metrics.percentiles(df, "x", shares).first()
    assert tuple(whole) == pytest.approx(tuple(df.agg(F.percentile("x", F.array(*map(F.lit, shares.values())))).first()[0]), abs=1e-9)
    assert metrics.latency_summary(df.withColumnRenamed("x", "latency_ms"), by=["g"]).count() == 6
    assert metrics.latency_summary(df.withColumnRenamed("x", "latency_ms")).first().latency_p50 == pytest.approx(whole.p50)


def test_ring_members_are_those_of_senders_that_score(spark):
    edges = spark.createDataFrame([(0, 1, 2, 0), (1, 3, 1, 1), (2, 4, 3, 2), (3, 5, 4, 3), (4, 8, 9, 4)], "edge_id bigint, src bigint, dst bigint, t bigint")
    scores = spark.createDataFrame([(1, 0.9), (3, 0.2), (8, 0.9), (2, 0.5)], "node_id bigint, score double")
    got = sorted(tuple(r)[:2] for r in tiers.ring_members(edges, scores).collect())
    # 4 reaches 1 by way of 3; 8 has too small a neighbourhood.
    assert got == [(1, 1), (1, 3), (1, 4), (2, 1), (2, 2), (2, 3)]
