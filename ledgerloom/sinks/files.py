"""File, topic and table sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.items import with_item_fields

# Topic per item type, and the primary keys of the keyed tables. Types
# without a key are append only.
TOPICS = {
    "block": "blocks",
    "transaction": "transactions",
    "log": "logs",
    "token_transfer": "token_transfers",
    "trace": "traces",
    "contract": "contracts",
    "token": "tokens",
}
PRIMARY_KEYS = {
    "blocks": ["hash"],
    "transactions": ["hash"],
    "logs": ["transaction_hash", "log_index"],
    "token_transfers": ["transaction_hash", "log_index"],
    "traces": ["trace_id"],
    "tokens": [],
    "contracts": [],
}


def _flat_text(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StructType, T.MapType)):
            col = F.transform(col, lambda x: F.to_json(x))
        else:
            col = col.cast("array<string>")
        return F.array_join(col, ",").alias(field.name)
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json(col).alias(field.name)
    if isinstance(kind, T.BooleanType):
        return F.initcap(col.cast("string")).alias(field.name)
    return col.cast("string").alias(field.name)


def csv_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Declared columns as text: lists comma-joined, structs as JSON, missing as ''."""
    chosen = df.select(*columns) if columns else df
    flat = chosen.select(*[_flat_text(f) for f in chosen.schema.fields])
    return flat.select(*[F.coalesce(c, F.lit("")).alias(c) for c in flat.columns])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, partition_by: Iterable[str] = ()) -> None:
    by = list(partition_by)
    flat = csv_rows(df, [*columns, *by] if columns else None)
    flat.write.mode("overwrite").partitionBy(*by).option("emptyValue", "").csv(path, header=True)


def json_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Declared columns; decimals become doubles rounded to 8 places."""
    chosen = df.select(*columns) if columns else df
    return chosen.select(*[
        F.round(F.col(f.name), 8).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
        for f in chosen.schema.fields
    ])


def write_jsonl(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    json_rows(df, columns).write.mode("overwrite").json(path, ignoreNullFields=False)


def envelope(df: DataFrame, item_type: str) -> DataFrame:
    """Rows of one type as ``(type, item_id, item_timestamp, payload)``."""
    items = with_item_fields(df, item_type)
    return items.select("type", "item_id", "item_timestamp", F.to_json(F.struct("*")).alias("payload"))


def route_by_type(items: DataFrame, known: Iterable[str]) -> dict[str, DataFrame]:
    """One DataFrame per item type. A missing or unknown type is an error.

    The check is one aggregate over the type column, run before anything is written.
    """
    known = list(known)
    bad = items.filter(F.col("type").isNull() | ~F.col("type").isin(known)).select("type").limit(1).collect()
    if bad:
        raise ValueError("type key is missing" if bad[0][0] is None else f"no output for item type {bad[0][0]}")
    return {t: items.filter(F.col("type") == t) for t in known}


def topic_records(items: DataFrame, topics: dict[str, str] = TOPICS) -> DataFrame:
    """``(topic, key, value, headers)`` rows for a message topic; other types are dropped."""
    name = F.create_map(*[F.lit(x) for pair in topics.items() for x in pair])[F.col("type")]
    header = lambda n: F.struct(F.lit(n).alias("key"), F.col(n).cast("binary").alias("value"))
    return items.withColumn("topic", name).filter("topic IS NOT NULL").select(
        "topic",
        F.col("item_id").alias("key"),
        F.col("payload").alias("value"),
        F.array(header("item_id"), header("item_timestamp")).alias("headers"),
    )


def write_topics(records: DataFrame, path: str | None = None, **kafka: str) -> None:
    """To Kafka when options are given and its connector is present, else JSON files."""
    if kafka:
        records.write.format("kafka").options(**kafka).save()
    else:
        records.drop("headers").write.mode("overwrite").partitionBy("topic").json(path)


def multi_sink(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One batch to several outputs; the batch is computed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for sink in sinks:
                sink(kept, batch_id)
        finally:
            kept.unpersist()

    return write


def console_sink(batch: DataFrame, batch_id: int) -> None:
    """Every row as one line of JSON. Rows come to the driver a partition at a time."""
    for row in batch.select(F.to_json(F.struct("*"))).toLocalIterator():
        print(row[0])


def memory_sink(name: str) -> Callable[[DataFrame, int], None]:
    """Items by type in session tables ``<name>_<type>``, kept on the executors and spilled to their disks.

    A batch that comes again replaces itself. For looking at results, as in tests; not a store.
    """
    batches: dict[str, dict[int, DataFrame]] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        for (kind,) in kept.select("type").distinct().collect():
            mine = batches.setdefault(kind, {})
            mine[batch_id] = kept.filter(F.col("type").eqNullSafe(F.lit(kind)))
            reduce(DataFrame.unionByName, mine.values()).createOrReplaceTempView(f"{name}_{kind}")

    return write


CHILDREN = ["transactions", "logs", "token_transfers", "traces"]


def block_bundles(blocks: DataFrame, children: dict[str, DataFrame], build: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per block with its transactions, logs, transfers and traces as arrays.

    A bundle is the output format, so the arrays are as long as the block's own
    content. Children of absent blocks are dropped. Repeated block rows are an error.
    ``build`` may reshape the result.
    """
    # Union first: one shuffle by block number instead of one per child table.
    header = F.struct(*blocks.columns)
    parts = [blocks.select(F.col("number").alias("block_number"), header.alias("block"))]
    for name in CHILDREN:
        if name in children:
            df = children[name]
            parts.append(df.select("block_number", F.struct(*df.columns).alias(name)))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    grouped = merged.groupBy("block_number").agg(
        F.count("block").alias("_n"),
        F.first("block", ignorenulls=True).alias("block"),
        *[F.collect_list(c).alias(c) for c in merged.columns if c in CHILDREN],
    ).filter("_n > 0")
    checked = grouped.withColumn("_n", F.when(F.col("_n") == 1, F.col("_n")).otherwise(
        F.raise_error(F.concat(F.lit("more than one block row for number "), F.col("block_number").cast("string")))
    )).filter("_n = 1").drop("_n")
    return build(checked) if build else checked


def write_block_bundles(bundles: DataFrame, path: str) -> None:
    body = F.to_json(F.struct(*bundles.columns)).alias("value")
    bundles.select("block_number", body).sortWithinPartitions("block_number").write.mode("overwrite").partitionBy(
        "block_number").text(path)


def latest_rows(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row per key. Aggregation combines map-side, so hot keys stay small."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r")).select(*keys, "_r.*")


def upsert(spark: SparkSession, path: str, batch: DataFrame, table: str, batch_id: int) -> None:
    """Merge a batch into a keyed parquet table; on conflict the batch's row wins.

    Every batch is kept as its own version folder, written with overwrite, so a
    retried batch replaces itself. ``read_upserted`` resolves versions by key.
    """
    batch.withColumn("_version", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
        f"{path}/{table}/_v={batch_id}"
    )


def read_upserted(spark: SparkSession, path: str, table: str) -> DataFrame:
    rows = spark.read.option("basePath", f"{path}/{table}").parquet(f"{path}/{table}").drop("_v")
    keys = PRIMARY_KEYS.get(table, [])
    if not keys:
        return rows.drop("_version")
    return latest_rows(rows, keys, "_version").drop("_version")


def block_partitions(df: DataFrame, key: str, start: int, end: int, size: int) -> DataFrame:
    """Add zero-padded ``start_block``/``end_block`` of the fixed-size range; the last is clipped."""
    first = F.floor((F.col(key) - start) / F.lit(size)) * size + start
    pad = lambda c: F.lpad(c.cast("bigint").cast("string"), 8, "0")
    return df.filter(F.col(key).between(start, end)).withColumns({
        "start_block": pad(first),
        "end_block": pad(F.least(first + size - 1, F.lit(end))),
    })


def date_partition(df: DataFrame, seconds: str) -> DataFrame:
    """Add the UTC ``date`` of an epoch-second column."""
    return df.withColumn("date", F.date_from_unix_date(F.floor(F.col(seconds) / 86400).cast("int")))


def parse_partition_bound(text: str) -> tuple[str, int]:
    """Kind and value of a range bound: ``block``, ``unix`` seconds or ISO ``date``."""
    if text.isdigit() and len(text) in (10, 13):
        return "unix", int(text[:10])
    if text.isdigit():
        return "block", int(text)
    year, month, day = (int(x) for x in text.split("-"))
    import datetime

    return "date", (datetime.date(year, month, day) - datetime.date(1970, 1, 1)).days * 86400


def write_partitioned(df: DataFrame, path: str, by: list[str], fmt: str = "parquet") -> None:
    df.write.mode("overwrite").partitionBy(*by).format(fmt).save(path)
