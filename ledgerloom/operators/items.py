"""Row filters and projections over item tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_items(items: DataFrame, predicate: str) -> DataFrame:
    """Rows where a SQL predicate holds."""
    return items.filter(F.expr(predicate))


def extract_field(items: DataFrame, field: str) -> DataFrame:
    return items.select(field)


def distinct_values(items: DataFrame, field: str) -> DataFrame:
    """Each value of a column once."""
    return items.select(field).distinct()
