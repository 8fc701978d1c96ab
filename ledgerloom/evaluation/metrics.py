"""Confusion metrics, latency summaries, ring detection timeliness and run comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_key_join, prefix_sums, ranged

# Latency budgets in milliseconds, size classes and effect limits.
LATENCY_BUDGETS = [5, 10, 25, 50, 100, 250, 500]
TIER_BUDGETS = [0.01, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]
SMALL_RING, LARGE_RING = 3, 5
# Two-sided 95 % points of Student's t for 1 to 30 degrees of freedom (public table).
T_95 = [
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139,
    2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963,
    2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
]
Z_95 = 1.959963985


def _critical_t(df: Column) -> Column:
    """Tabled value, or the usual expansion around the normal point beyond the table."""
    z = Z_95
    expanded = F.lit(z) + F.lit((z**3 + z) / 4) / df + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / (df * df)
    return F.coalesce(F.get(F.array(*map(F.lit, T_95)), (df - 1).cast("int")), expanded)


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(rows: DataFrame, predicted: str = "predicted", actual: str = "actual", by: list[str] | None = None) -> DataFrame:
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    return rows.groupBy(*(by or [])).agg(
        F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"),
        F.count_if(~p & ~a).alias("tn"), F.count_if(~p & a).alias("fn"))


def confusion_metrics(counts: DataFrame) -> DataFrame:
    """F1, precision, recall, MCC and accuracy; 0 wherever a denominator is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.withColumns({
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": _ratio(tp * tn - fp * fn, spread),
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
    })


def tier_distribution(detections: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per outcome and the share of edges each tier filters out."""
    is_ = lambda r: F.count_if(F.col("result") == r)
    counts = detections.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), is_("SAFE").alias("safe"), is_("SUSPICIOUS").alias("suspicious"),
        is_("FRAUD_RING").alias("fraud_ring"), is_("LIKELY_FRAUD").alias("likely_fraud"))
    past_1 = F.col("total") - F.col("safe")
    past_2 = past_1 - F.col("suspicious")
    rate = lambda kept, of: F.coalesce(1 - F.try_divide(kept, of), F.lit(0.0))
    return counts.withColumns({
        "tier1_filter_rate": rate(past_1, F.col("total")),
        "tier2_filter_rate": rate(past_2, past_1),
    })


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation per group, one column per entry of ``shares``.

    Equal values are counted first, the distinct ones numbered in slices with sampled bounds, and of a group only the
    rows at the wanted ranks are looked at, so no task sees a whole group. Null values do not count;
    a group of nulls only gives no row. Null group keys are groups of their own.
    """
    by = by or []
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key.alias("_k"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    slices = ranged(counts, F.col("_k"), F.col("_v"))
    run = prefix_sums(slices, [F.col("_v")], {"_upto": "_n"}, {"slice": F.col("_range")}, ["_k"]).drop("_range")
    totals = slices.groupBy("_k").agg(F.sum("_n").alias("_total"), F.count("*").alias("_rows"))
    held = hot_key_join(run, totals, ["_k"], "_rows", ["_v"])
    place = {name: (F.col("_total") - 1) * share for name, share in shares.items()}
    at = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col("_v")))
    ends = held.groupBy("_k").agg(F.first("_total").alias("_total"), *[
        at(end(p)).alias(f"_{side}_{name}") for name, p in place.items() for side, end in (("low", F.floor), ("high", F.ceil))])
    low, high = lambda n: F.col(f"_low_{n}").cast("double"), lambda n: F.col(f"_high_{n}").cast("double")
    return ends.select(*([f"_k.{c}" for c in by]), *[(low(n) + (high(n) - low(n)) * (p - F.floor(p))).alias(n) for n, p in place.items()])


def latency_summary(rows: DataFrame, latency: str = "latency_ms", by: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, mean, population deviation, throughput."""
    out = rows.groupBy(*(by or [])).agg(
        F.count("*").alias("total_processed"), F.avg(latency).alias("latency_mean"),
        F.stddev_pop(latency).alias("latency_std"),
        (F.count("*") / F.greatest(F.sum(latency) / 1000, F.lit(0.001))).alias("throughput_per_sec"))
    at = percentiles(rows, latency, {"latency_p50": 0.5, "latency_p95": 0.95, "latency_p99": 0.99}, by)
    # Both sides have one row per group.
    same = F.lit(True)
    for c in by or []:
        same = same & out[c].eqNullSafe(at[c])
    return out.join(at, same, "left").select(*[out[c] for c in out.columns], "latency_p50", "latency_p95", "latency_p99")


def size_bucket(n: Column) -> Column:
    return (
        F.when(n < 10, "<10").when(n < 50, "10-50").when(n < 100, "50-100").when(n < 200, "100-200").otherwise("200+")
    )


def latency_by_size(rows: DataFrame) -> DataFrame:
    """Latency summary per node-count bucket, with the rows of each."""
    bucketed = rows.withColumn("bucket", size_bucket(F.col("num_nodes")))
    return latency_summary(bucketed, by=["bucket"]).join(
        bucketed.groupBy("bucket").agg(F.avg("num_nodes").alias("avg_nodes")), "bucket"
    )


def runs_summary(runs: DataFrame, metrics: list[str], by: str = "config") -> DataFrame:
    """Mean and population deviation over runs, one row per configuration and metric."""
    long = runs.unpivot([by], metrics, "metric", "value")
    return long.groupBy(by, "metric").agg(
        F.count("value").alias("runs"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def paired_comparison(runs: DataFrame, a: str, b: str, metrics: list[str]) -> DataFrame:
    """Two configurations compared over shared seeds, one row per metric."""
    long = runs.unpivot(["config", "seed"], metrics, "metric", "value")
    pairs = long.filter(F.col("config").isin(a, b)).groupBy("metric", "seed").agg(
        F.max(F.when(F.col("config") == a, F.col("value"))).alias("x"),
        F.max(F.when(F.col("config") == b, F.col("value"))).alias("y"),
    ).dropna()
    d = F.col("x") - F.col("y")
    s = pairs.groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"), F.avg(d).alias("diff"),
        F.stddev_samp(d).alias("_sd"), F.var_samp("x").alias("_vx"), F.var_samp("y").alias("_vy"))
    n = F.col("n")
    error = F.col("_sd") / F.sqrt(n)
    pooled = F.sqrt((F.col("_vx") + F.col("_vy")) / 2)
    effect = F.abs("cohens_d")
    critical = _critical_t(n - 1)
    return s.withColumns({
        "comparison": F.lit(f"{a} vs {b}"),
        "t_stat": F.when(n >= 3, F.try_divide(F.col("diff"), error)),
        "cohens_d": F.when(n >= 2, _ratio(F.col("diff"), pooled)),
    }).withColumns({
        "effect_size": F.when(effect < 0.2, "negligible").when(effect < 0.5, "small").when(effect < 0.8, "medium")
        .when(effect.isNotNull(), "large"),
        "ci_low": F.when(n >= 2, F.col("diff") - critical * error),
        "ci_high": F.when(n >= 2, F.col("diff") + critical * error),
    }).drop("_sd", "_vx", "_vy")


def rdt(detections: DataFrame, completions: DataFrame) -> DataFrame:
    """Ring detection timeliness, plain and weighted, as one row.

    Only detections of known rings count. Plain: share strictly before completion.
    Weighted: remaining share of the ring's duration, at most 1; late ones count 0 and
    rings without duration are left out.
    """
    joined = detections.join(completions, "ring_id")
    early = F.col("detection_time") < F.col("completion_time")
    duration = F.col("completion_time") - F.col("start_time")
    left = F.when(early, F.least((F.col("completion_time") - F.col("detection_time")) / duration, F.lit(1.0))).otherwise(0.0)
    return joined.agg(
        _ratio(F.count_if(early), F.count("*")).alias("rdt"),
        _ratio(F.sum(F.when(duration > 0, left)), F.count_if(duration > 0)).alias("rdt_weighted"))


def first_detection(scored: DataFrame, labels: DataFrame, threshold: float | Column) -> DataFrame:
    """``(node_id, detection_time)``: earliest flagged edge per fraud node."""
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold
    flagged = scored.filter(F.col("score") >= limit).select(F.explode(F.array("src", "dst")).alias("node_id"), "t")
    first = flagged.groupBy("node_id").agg(F.min("t").alias("detection_time"))
    return first.join(labels.filter("label = 1").select("node_id"), "node_id", "left_semi")


def ring_rdt(members: DataFrame, rings: DataFrame, detections: DataFrame) -> DataFrame:
    """Per ring: members, those detected before completion, and their share of all members."""
    seen = members.join(detections, "node_id", "left").join(rings.select("ring_id", "completion_time"), "ring_id")
    early = F.count_if(F.col("detection_time") < F.col("completion_time"))
    return seen.groupBy("ring_id").agg(F.count("*").alias("members"), early.alias("detected_before_completion")).withColumn(
        "rdt", F.col("detected_before_completion") / F.col("members"))


def ring_rates(per_ring: DataFrame) -> DataFrame:
    """Share of rings with any early detection: all, small and large ones."""
    hit = F.col("detected_before_completion") > 0
    small, large = F.col("members") <= SMALL_RING, F.col("members") >= LARGE_RING
    return per_ring.agg(
        F.count("*").alias("rings"), F.count_if(hit).alias("rings_detected"),
        _ratio(F.count_if(hit), F.count("*")).alias("ring_rate"),
        _ratio(F.count_if(hit & small), F.count_if(small)).alias("small_ring_rate"),
        _ratio(F.count_if(hit & large), F.count_if(large)).alias("large_ring_rate"),
        F.coalesce(F.avg("rdt"), F.lit(0.0)).alias("mean_rdt"))


def detection_coverage(detections: DataFrame, labels: DataFrame) -> DataFrame:
    """Detected fraud nodes over all fraud nodes."""
    fraud = labels.filter("label = 1").select("node_id")
    seen = fraud.join(detections.select("node_id", F.lit(1).alias("_d")), "node_id", "left")
    return seen.agg(F.count("_d").alias("detected"), F.count("*").alias("fraud_nodes")).withColumn(
        "coverage", _ratio(F.col("detected"), F.col("fraud_nodes")))


def accuracy_at_latency(rows: DataFrame, budgets: list[float] = LATENCY_BUDGETS) -> DataFrame:
    """Per budget: accuracy among rows within it, 0 if there are none. One pass."""
    within = [F.col("latency_ms") <= b for b in budgets]
    right = F.col("predicted") == F.col("actual")
    sums = rows.agg(*[F.count_if(w).alias(f"n{i}") for i, w in enumerate(within)],
                    *[F.count_if(w & right).alias(f"r{i}") for i, w in enumerate(within)])
    points = F.array(*[F.struct(F.lit(float(b)).alias("budget_ms"), F.col(f"n{i}").alias("rows"),
                                _ratio(F.col(f"r{i}"), F.col(f"n{i}")).alias("accuracy")) for i, b in enumerate(budgets)])
    return sums.select(F.explode(points).alias("p")).select("p.*")


def tier_availability(tiers: DataFrame, budgets: list[float] = TIER_BUDGETS) -> DataFrame:
    """Per budget the metric of every tier that is fast enough, and the best of them.

    ``tiers(tier, p50_ms, auc, f1)`` has one row per tier, so exploding the budgets on it
    stays tiny.
    """
    grid = tiers.withColumn("budget_ms", F.explode(F.array(*[F.lit(float(b)) for b in budgets])))
    fits = F.col("p50_ms") <= F.col("budget_ms")
    pick = lambda c: F.when(fits, F.col(c)).otherwise(0.0)
    scored = grid.withColumns({"auc": pick("auc"), "f1": pick("f1")})
    best = scored.groupBy("budget_ms").agg(F.max("auc").alias("auc"), F.max("f1").alias("f1")).withColumn("tier", F.lit("cascade"))
    return scored.select("tier", "budget_ms", "auc", "f1").unionByName(best)
