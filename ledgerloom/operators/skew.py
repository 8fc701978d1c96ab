"""Joins and running sums that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

# A key with more rows than this is spread over several tasks.
ROWS_PER_TASK = 2_000_000


def hot_key_join(
    rows: DataFrame,
    keyed: DataFrame,
    on: Sequence[str],
    weight: str,
    spread: Sequence[str],
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join many ``rows`` per key to one ``keyed`` row per key.

    ``keyed[weight]`` says how many rows the key has on the other side. Keys above
    ``rows_per_task`` are split by a hash of the ``spread`` columns and their
    ``keyed`` row is repeated once per split. The list of such keys has at most
    ``total rows / rows_per_task`` entries, which is what makes broadcasting it safe.
    """
    on = list(on)
    splits = F.ceil(F.col(weight) / F.lit(rows_per_task)).cast("int")
    hot = keyed.filter(F.col(weight) > rows_per_task).select(*on, splits.alias("_splits"))
    left = (
        rows.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*spread), F.col("_splits")).cast("int")))
        .drop("_splits")
    )
    right = keyed.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.greatest(splits, F.lit(1)) - 1))
    )
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def prefix_sums(
    df: DataFrame,
    order: Sequence[Column],
    sums: dict[str, str],
    levels: dict[str, Column],
    within: Sequence[str] = (),
) -> DataFrame:
    """Running sums over a total order without sorting everything in one task.

    ``levels`` are bucket columns, coarse to fine, each non-decreasing in ``order``.
    Rows are summed inside their finest bucket, bucket totals are then summed one
    level up, and the offsets joined back. Only the coarsest level is summed in a
    single task (per ``within`` group), so it must have a bounded number of values.
    Adds one inclusive running sum per entry ``new name -> value column``.
    """
    within = list(within)
    names = [f"_b{i}" for i in range(len(levels))]
    rows = df.withColumns(dict(zip(names, levels.values())))
    inner = W.partitionBy(*within, *names).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumns({f"_in_{n}": F.sum(v).over(inner) for n, v in sums.items()})

    totals = rows.groupBy(*within, *names).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    offsets = None
    for depth in range(len(names), 0, -1):
        keys = within + names[:depth]
        parent = within + names[: depth - 1]
        before = W.partitionBy(*(parent or [F.lit(0)])).orderBy(names[depth - 1]).rowsBetween(
            W.unboundedPreceding, -1
        )
        level = totals.select(
            *keys,
            *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o{depth}_{n}") for n in sums],
        )
        offsets = level if offsets is None else offsets.join(level, keys)
        totals = totals.groupBy(*parent).agg(*[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in sums])

    # offsets has one row per finest bucket
    depths = range(1, len(names) + 1)
    added = offsets.select(
        *within,
        *names,
        *[sum((F.col(f"_o{d}_{n}") for d in depths), F.lit(0)).alias(f"_off_{n}") for n in sums],
    )
    joined = out.join(added, [*within, *names])
    result = joined.withColumns({n: F.col(f"_in_{n}") + F.col(f"_off_{n}") for n in sums})
    return result.drop(*names, *[f"_in_{n}" for n in sums], *[f"_off_{n}" for n in sums])


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``_range``, the number of an about equal slice of its rows in ``order``.

    The slices' bounds come from a sample, so values that share a prefix or lie far from
    all others do not meet in one slice; rows with equal values always do. The slices are
    written to the shared folder, since another sample would give other bounds.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))


def dense_index(
    df: DataFrame,
    name: str,
    order: Sequence[Column],
    levels: dict[str, Column],
    within: Sequence[str] = (),
) -> DataFrame:
    """0-based position of every row in the given total order."""
    ranked = prefix_sums(df.withColumn("_one", F.lit(1).cast("bigint")), order, {name: "_one"}, levels, within)
    return ranked.withColumn(name, F.col(name) - 1).drop("_one")
