"""External tables over exported files."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import schemas as S

PARTITION_COLUMNS = {"blocks": "number"}


def register_external_tables(spark: SparkSession, base: str, fmt: str = "parquet", entities=None) -> list[str]:
    """A temporary view per exported entity folder, with its declared schema.

    Folders are partitioned by ``start_block``/``end_block`` or by ``date``; partition
    columns are discovered, entity columns are declared and never inferred.
    """
    made = []
    for entity in entities or S.ENTITIES:
        reader = spark.read.option("header", "true") if fmt == "csv" else spark.read
        schema = S.ENTITIES[entity]
        if fmt == "csv":
            # Nested and list columns are joined text in delimited files.
            reader = reader.schema(_flat(spark, schema))
        elif fmt != "orc":
            reader = reader.schema(schema)
        reader.format(fmt).load(f"{base}/{entity}").createOrReplaceTempView(entity)
        made.append(entity)
    return made


def _flat(spark: SparkSession, schema: str) -> str:
    fields = spark.createDataFrame([], schema).dtypes
    return ", ".join(f"`{n}` {'string' if t.startswith(('array', 'struct')) else t}" for n, t in fields)
