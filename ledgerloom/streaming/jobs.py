"""Shared pieces of the streaming jobs: sources, positions, keyed outputs, run control."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_dir

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Keep the state of streams started inside on RocksDB: it spills and is needed by keyed processors."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def run_dir(spark: SparkSession) -> str:
    """A fresh folder on shared storage for one stream's output and checkpoint."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def parquet_stream(spark: SparkSession, folder: str, schema, pattern: str = "*", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def landed(rows: DataFrame, folder: str) -> str:
    """Rows as files of a folder that a stream can read."""
    rows.write.mode("append").parquet(folder)
    return folder


def run_available(writer, checkpoint: str) -> StreamingQuery:
    """Process everything that is there, then stop. Errors of the stream are raised."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_to_parquet(stream: DataFrame, base: str) -> StreamingQuery:
    """Append through the transactional file sink; reading it back sees each row once."""
    return run_available(stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out"), f"{base}/ckpt")


def version_sink(base: str, table: str = "out") -> Callable[[DataFrame, int], None]:
    """Write every batch to its own folder with overwrite, so a retried batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_version", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{base}/{table}/_v={batch_id}")

    return write


def read_versions(spark: SparkSession, base: str, keys: list[str] | None = None, table: str = "out") -> DataFrame:
    """All versions, or the newest row per key."""
    from ..sinks.files import latest_rows

    rows = spark.read.option("basePath", f"{base}/{table}").parquet(f"{base}/{table}").drop("_v")
    return latest_rows(rows, keys, "_version").drop("_version") if keys else rows.drop("_version")


def update_keyed(stream: DataFrame, base: str) -> StreamingQuery:
    """Changed aggregates of every batch as a new version of a keyed table."""
    writer = stream.writeStream.outputMode("update").foreachBatch(version_sink(base))
    return run_available(writer, f"{base}/ckpt")


def late_rows(query: StreamingQuery) -> int:
    """Rows that state operators dropped because they came after the watermark."""
    return sum(
        op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"]
    )


def remove_folders(spark: SparkSession, pattern: str) -> None:
    """Remove the folders that a glob names, through the file system they are on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(path) or []:
        files.delete(found.getPath(), True)


class Position:
    """Last exported block, kept as one tiny row per batch and written after the export."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("last bigint, b bigint").option("basePath", self.path).json(self.path)
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def get(self, before: int | None = None) -> int | None:
        """Newest position, or the one that batch ``before`` started from, whether or not it was stored since."""
        rows = self._rows()
        if rows is None:
            return None
        return (rows if before is None else rows.filter(F.col("b") < before)).agg(F.max("last")).first()[0]

    def set(self, last: int, batch_id: int) -> None:
        self.spark.range(1).select(F.lit(last).cast("bigint").alias("last")).write.mode("overwrite").json(f"{self.path}/b={batch_id}")

    def begin(self, start_block: int | None) -> int | None:
        """Position to resume from. Giving a start block for a stream that has one is an error."""
        current = self.get()
        if start_block is not None and current is not None:
            raise ValueError("the stream already has a position; start_block must not be given")
        if start_block is not None:
            self.set(start_block - 1, -1)
            return start_block - 1
        return current
