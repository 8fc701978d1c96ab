"""Three scorers on Spark ML and the cascade that chains them."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..evaluation.curves import auc_roc, average_precision, curve
from ..evaluation.metrics import confusion, confusion_metrics
from ..operators.graph import neighbor_mean
from ..operators.hops import subgraph_pool_features, subgraphs
from ..operators.patterns import PATTERN_COLUMNS
from ..operators.skew import ROWS_PER_TASK, hot_key_join

# Tree depth, rounds, rate, thresholds and the weight limit for nodes.
DEPTH, ROUNDS, RATE = 6, 100, 0.1
MAX_POS_WEIGHT = 100.0
UNKNOWN_SCORE = 0.5
FEATURES = ["in_degree", "out_degree", "total_sent", "total_received", "reserved_4", "tx_count", "reserved_6", "reserved_7"]


def edge_vectors(edges: DataFrame, patterns: DataFrame, features: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Edges with the tier-1 inputs of both endpoints; unknown nodes count as zeros.

    Online: 12 + 12 pattern counts, value and second of the day. With ``features``:
    pattern counts and node features of both ends instead.
    """
    table, names = patterns, list(PATTERN_COLUMNS)
    if features is not None:
        table, names = patterns.join(features, "node_id", "full"), names + FEATURES
    out = edges
    for side, other in (("src", "dst"), ("dst", "src")):
        load = edges.groupBy(side).agg(F.count("*").alias("_n"))
        keyed = load.join(table.withColumnRenamed("node_id", side), side, "left").select(
            side, "_n", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(f"{side}_{c}") for c in names])
        out = hot_key_join(out, keyed, [side], "_n", [other, "t"], rows_per_task=rows_per_task).drop("_n")
    if features is None:
        out = out.withColumn("second_of_day", (F.col("t") % 86400).cast("double"))
    return out


def vector_columns(with_features: bool) -> list[str]:
    names = PATTERN_COLUMNS + (FEATURES if with_features else [])
    both = [f"{side}_{c}" for side in ("src", "dst") for c in names]
    return both if with_features else [*both, "value", "second_of_day"]


def class_weights(labels: DataFrame, label: str = "label") -> DataFrame:
    """``(label, weight)`` with weight n / (2 n_class): one row per class."""
    counts = labels.groupBy(label).agg(F.count("*").alias("n"))
    return counts.select(label, (F.lit(labels.count()) / (2.0 * F.col("n"))).alias("weight"))


def positive_weight(labels: DataFrame, label: str = "label", limit: float | None = None) -> float:
    """Weight neg/pos of a positive; 1 without negatives, where 0 would leave nothing to learn from."""
    row = labels.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    if not row["n"]:
        return 1.0
    weight = row["n"] / max(row["p"], 1)
    return min(weight, limit) if limit else weight


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="inputs", handleInvalid="keep").transform(df)


# Training keeps its rows in memory by partition and reads them whole in every pass; a partition gets so many at most.
FIT_ROWS_PER_TASK = 500_000


def varying(rows: DataFrame, columns: list[str]) -> tuple[int, list[int]]:
    """Number of rows, and positions of the columns that do not hold one and the same value in all of them (one at least)."""
    found = rows.agg(F.count("*").alias("n"), *[
        f(c).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    same = lambda i: found[f"n{i}"] == found["n"] and found[f"lo{i}"] == found[f"hi{i}"]
    return found["n"], [i for i in range(len(columns)) if not same(i)] or [0]


def train_boosted(train: DataFrame, columns: list[str], rounds: int = ROUNDS, depth: int = DEPTH, seed: int = 42, weight_limit: float | None = None, rows_per_task: int = FIT_ROWS_PER_TASK) -> Model:
    """Boosted trees with positives weighted by neg/pos.

    A column of one value cannot be split on, but every row's entry would be summed up on every level of every tree. So
    the trees see the other columns only, which gives the same trees. Rows that few tasks hold are dealt over more.
    """
    weight = positive_weight(train, limit=weight_limit)
    weighted = _assembled(train, columns).withColumn(
        "weight", F.when(F.col("label") == 1, F.lit(weight)).otherwise(F.lit(1.0)))
    n, positions = varying(train, columns)
    live = VectorSlicer(inputCol="inputs", outputCol="live", indices=positions)
    gbt = GBTClassifier(
        featuresCol="live", labelCol="label", weightCol="weight", maxDepth=depth, maxIter=rounds,
        stepSize=RATE, seed=seed)
    rows = live.transform(weighted).select("live", F.col("label").cast("double").alias("label"), "weight")
    if n > rows_per_task:
        rows = rows.repartition(max(-(-n // rows_per_task), rows.sparkSession.sparkContext.defaultParallelism))
    model = gbt.fit(rows)
    return PipelineModel([live, model])


def train_logistic(train: DataFrame, columns: list[str], weight_limit: float = MAX_POS_WEIGHT) -> Model:
    weight = positive_weight(train, limit=weight_limit)
    weighted = _assembled(train, columns).withColumn(
        "weight", F.when(F.col("label") == 1, F.lit(weight)).otherwise(F.lit(1.0)))
    model = LogisticRegression(featuresCol="inputs", labelCol="label", weightCol="weight", maxIter=50, regParam=0.01)
    return model.fit(weighted.select("inputs", F.col("label").cast("double").alias("label"), "weight"))


def score(model: Model, rows: DataFrame, columns: list[str], name: str = "score") -> DataFrame:
    """Add the positive-class probability; rows keep their own columns only."""
    probability = vector_to_array(F.col("probability"))[1]
    return model.transform(_assembled(rows, columns)).select(*rows.columns, probability.alias(name))


def two_hop_features(edges: DataFrame, features: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """A node's features with the means over one and over two incoming hops."""
    one = neighbor_mean(edges, features.select("node_id", *columns), columns)
    hop1 = [f"mean_{c}" for c in columns]
    two = neighbor_mean(edges, one, hop1)
    hop2 = [f"mean_{c}" for c in hop1]
    joined = features.select("node_id", *columns).join(one, "node_id", "left").join(two, "node_id", "left")
    return joined.select("node_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in [*columns, *hop1, *hop2]])


def two_hop_columns(columns: list[str] = FEATURES) -> list[str]:
    return [*columns, *[f"mean_{c}" for c in columns], *[f"mean_mean_{c}" for c in columns]]


def edge_score_from_nodes(edges: DataFrame, node_scores: DataFrame, name: str = "tier2_score") -> DataFrame:
    """Larger of both endpoint scores; 0.5 for an unknown node."""
    src = node_scores.select(F.col("node_id").alias("src"), F.col("score").alias("_s"))
    dst = node_scores.select(F.col("node_id").alias("dst"), F.col("score").alias("_d"))
    joined = edges.join(src, "src", "left").join(dst, "dst", "left")
    unknown = F.lit(UNKNOWN_SCORE)
    return joined.withColumn(name, F.greatest(F.coalesce("_s", unknown), F.coalesce("_d", unknown))).drop("_s", "_d")


POOLED = ["in_degree", "out_degree", "total_sent", "total_received"]


def pooled_subgraphs(edges: DataFrame, features: DataFrame, seeds: DataFrame, columns: list[str] = POOLED, limit: int | None = None) -> tuple[DataFrame, list[str]]:
    """Pooled features of each seed's two-hop subgraph, ``node_id`` being the seed, and the names of the inputs.

    Seeds whose subgraph is too small give no row.
    """
    nodes, inner = subgraphs(edges.select("src", "dst"), seeds, limit=limit)
    pooled = subgraph_pool_features(nodes, inner, features, columns)
    return pooled.withColumnRenamed("seed", "node_id").fillna(0.0), [c for c in pooled.columns if c != "seed"]


def seed_score(edges: DataFrame, seed_scores: DataFrame, name: str = "tier3_score") -> DataFrame:
    """Score of the sender's subgraph; 0 where the sender has none."""
    scores = seed_scores.select(F.col("node_id").alias("src"), F.col("score").alias(name))
    return edges.join(scores, "src", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def ring_members(edges: DataFrame, seed_scores: DataFrame, t3: float = 0.5, limit: int | None = None) -> DataFrame:
    """``(seed, member, score)``: the nodes of the two-hop subgraph of every seed that scores as a ring."""
    rings = seed_scores.filter(F.col("score") >= t3).select(F.col("node_id").alias("seed"), "score")
    nodes, _ = subgraphs(edges.select("src", "dst"), rings.select(F.col("seed").alias("node_id")), limit=limit)
    return nodes.join(rings, "seed").select("seed", F.col("node_id").alias("member"), "score")


def decide(scored: DataFrame, t1: float = 0.5, t2: float = 0.5, t3: float = 0.5) -> DataFrame:
    """Outcome, confidence and tier reached from the three scores."""
    s1, s2, s3 = F.col("tier1_score"), F.col("tier2_score"), F.col("tier3_score")
    safe, suspicious = s1 < t1, s2 < t2
    return scored.withColumns({
        "result": F.when(safe, "SAFE").when(suspicious, "SUSPICIOUS").when(s3 >= t3, "FRAUD_RING").otherwise("LIKELY_FRAUD"),
        "confidence": F.when(safe, 1 - s1).when(suspicious, s2).otherwise(s3),
        "tier_reached": F.when(safe, 1).when(suspicious, 2).otherwise(3),
    })


def cascade(tier1: DataFrame, node_scores: DataFrame, seed_scores, t1: float = 0.5, t2: float = 0.5, t3: float = 0.5) -> DataFrame:
    """Run edges through the tiers, computing a tier only for rows that reach it.

    ``tier1`` holds ``tier1_score``. ``seed_scores(seeds)`` returns ``(node_id, score)``
    for the distinct senders of rows that reach tier 3.
    """
    none = F.lit(None).cast("double")
    safe = tier1.filter(F.col("tier1_score") < t1).withColumns({"tier2_score": none, "tier3_score": none})
    second = edge_score_from_nodes(tier1.filter(F.col("tier1_score") >= t1), node_scores)
    suspicious = second.filter(F.col("tier2_score") < t2).withColumn("tier3_score", none)
    third = second.filter(F.col("tier2_score") >= t2)
    last = seed_score(third, seed_scores(third.select(F.col("src").alias("node_id")).distinct()))
    return decide(reduce(DataFrame.unionByName, [safe, suspicious, last]), t1, t2, t3)


def evaluate(scored: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """AUC, average precision, F1 and MCC of ``score`` against ``label``."""
    points = curve(scored, by=by)
    flags = scored.withColumns({"predicted": (F.col("score") >= threshold).cast("int"), "actual": F.col("label")})
    counts = confusion_metrics(confusion(flags, by=by))
    # Without groups each side is one row, joined on a constant.
    keys = by or ["_one"]
    one = (lambda df: df) if by else (lambda df: df.withColumn("_one", F.lit(1)))
    for part in (auc_roc(points, by), average_precision(points, by)):
        counts = one(counts).join(one(part), keys)
    return counts if by else counts.drop("_one")


def cross_period(rows: DataFrame, columns: list[str], train_periods: list[str], test_period: str, rounds: int = ROUNDS) -> DataFrame:
    """Train on some periods and evaluate on another."""
    model = train_boosted(rows.filter(F.col("period").isin(train_periods)), columns, rounds)
    tested = score(model, rows.filter(F.col("period") == test_period), columns)
    return evaluate(tested).withColumns({"train": F.lit(",".join(train_periods)), "test": F.lit(test_period)})


def repeat_runs(run, seeds: list[int]) -> DataFrame:
    """Per-seed metric rows of ``run(seed) -> DataFrame``; every run is its own Spark job."""
    return reduce(DataFrame.unionByName, [run(s).withColumn("seed", F.lit(s)) for s in seeds])
