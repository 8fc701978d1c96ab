"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Sizes are counted in words. Sources in code-point order, null last, take the weights in
turn, and share ``share`` of all words by weight; a target above ``most`` times its
source's size stops there and the excess is shared again by weight. That fixed point is
found in closed form over the sources ordered by limit / weight.

Every document of a source expects ``target / size of the source`` copies. Documents are
ordered by size inside their source, their expectations are summed up, one offset is
added, and a document is taken once per integer that its share of the sum crosses. The
order by size spreads the copies evenly over short and long documents, so the words
taken stay within about one document of the target.

Null text and text without words have size 0 and take part with 0 words. Sources without
words have target 0. Equal rows are separate documents. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, read

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # 150 % as a fraction, so that sums stay whole numbers
MOST = 2
OFFSET = 0.43701598


def sized(documents: DataFrame) -> DataFrame:
    words = F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"))
    return documents.withColumn("_size", F.coalesce(words, F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from one ``(source, source_size)`` row per source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * most)
    # Ascending limit / weight: sources reach their limits in this order.
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    whole = F.sum("source_size").over(everything) * share[0]
    level = (whole - share[1] * F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (share[1] * F.sum("_w").over(onward))
    # The first source whose limit is not reached fixes the level of all later ones.
    rows = rows.withColumn("_level", level).withColumn("_level", F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level")))
    rows = rows.withColumn("_level", F.first("_level", True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    target = F.when(F.col("_level").isNull(), F.col("_cap").cast("double")).otherwise(F.col("_level") * F.col("_w"))
    return rows.select("source", "source_size", target.alias("target"))


def mix(documents: DataFrame, weights=WEIGHTS, share=SHARE, most: int = MOST, offset: float = OFFSET) -> DataFrame:
    """Input columns and ``_size``, ``_source_size``, ``_target`` and ``_copies``.

    Running numbers come in three levels, none of which meets in one task: rows inside a
    (source, size, bucket of ids), buckets inside a (source, size), sizes inside a
    source. The number of buckets is the root of the number of rows, so a source or a
    size with a third of all rows is split. Counts of a size are pre-aggregated.
    """
    rows = sized(documents).withColumn("_source", F.col("source"))
    total = documents.count()
    rows = rows.withColumn("_bucket", F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(max(1, math.isqrt(total)))))
    key = ["_source", "_size", "_bucket"]
    counts = cut(rows.groupBy(*key).agg(F.count("*").alias("_n")))
    by_size = counts.groupBy("_source", "_size").agg(F.sum("_n").alias("_n"))
    sizes = by_size.groupBy(F.col("_source").alias("source")).agg(F.sum(F.col("_n") * F.col("_size")).alias("source_size"))
    aims = targets(sizes, weights, share, most)
    earlier = W.partitionBy("_source").orderBy("_size").rowsBetween(W.unboundedPreceding, -1)
    by_size = by_size.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    aims = aims.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    by_size = by_size.join(aims, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    inside = W.partitionBy("_source", "_size").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).drop("_n")
    a, b = buckets.alias("a"), by_size.alias("b")
    buckets = a.join(b, F.col("a._source").eqNullSafe(F.col("b._source")) & (F.col("a._size") == F.col("b._size"))).select(
        F.col("a._source").alias("_ks"), F.col("a._size").alias("_kz"), F.col("a._bucket").alias("_kb"),
        (F.col("_base") + F.col("_before")).alias("_start"), "_source_size", "_target")
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy("doc_id", F.xxhash64("text"))))
    joined = ranked.join(cut(buckets), F.col("_source").eqNullSafe(F.col("_ks")) & (F.col("_size") == F.col("_kz")) & (F.col("_bucket") == F.col("_kb")))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    place = F.col("_start") + F.col("_rn")
    copies = F.floor(F.lit(offset) + rate * place) - F.floor(F.lit(offset) + rate * (place - 1))
    return joined.withColumn("_copies", copies.cast("long")).select(
        *[F.col(c) for c in documents.columns], "_size", "_source_size", "_target", "_copies")


def copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every row as often as it is taken."""
    return mixed.filter("_copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*columns)


def op7(spark, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                        F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
        source_size * {MOST} AS cap FROM s),
l AS (SELECT *, ((SUM(source_size) OVER ())::BIGINT * {SHARE[0]} - {SHARE[1]} * COALESCE(SUM(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
        / ({SHARE[1]} * SUM(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
m AS (SELECT MIN(cap / w) AS edge FROM l WHERE level <= cap / w),
t AS (SELECT source, source_size, CASE WHEN cap / w >= (SELECT edge FROM m) THEN
        (SELECT level FROM l WHERE level <= cap / w ORDER BY cap / w, source NULLS LAST LIMIT 1) * w ELSE cap::DOUBLE END AS target FROM l),
n AS (SELECT floor(sqrt(COUNT(*)))::BIGINT AS n FROM d),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id % (SELECT n FROM n), d.doc_id) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((floor({OFFSET}::DOUBLE + rate * k) - floor({OFFSET}::DOUBLE + rate * (k - 1))) * size)::BIGINT AS taken FROM r
"""
