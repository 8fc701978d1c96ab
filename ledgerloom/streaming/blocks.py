"""Continuous block export: raw responses in, enriched items out."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hexnum import hex_to_long
from ..functions.items import with_item_fields
from ..operators import contracts, enrich, parse, tracecalc, transfers
from ..session import cut
from .jobs import Position, remove_folders, run_available

# Landed responses: what the body is, the block it belongs to, and the response text.
LANDED = "kind string, block_number bigint, body string"
# Blocks per staging folder, which lets a batch skip what was exported long ago.
STAGE_BLOCKS = 10_000


def enrich_items(landed: DataFrame, wanted: Iterable[str]) -> dict[str, DataFrame]:
    """Enriched item tables of one batch, in canonical column form, keyed by type.

    Only the tables that the wanted types need are planned. Every block's responses
    must be in the batch together; a row without
    its block, receipt or parent trace, or with several, raises. Parsed tables are kept in
    the shared folder, since the checks and the export both read them.
    """
    needed = enrich.tables_needed(wanted)
    of = lambda kind: landed.filter(F.col("kind") == kind).select("body")
    blocks = cut(parse.parse_blocks(of("block")))
    out: dict[str, DataFrame] = {"block": blocks}

    def in_blocks(rows: DataFrame, what: str) -> DataFrame:
        rows = cut(rows)
        enrich.require_same_cardinality(rows, blocks, ("block_number", "number"), what)
        return rows

    if "transaction" in needed:
        transactions, receipts = cut(parse.parse_transactions(of("block"))), cut(parse.parse_receipts(of("receipt")))
        enrich.require_same_cardinality(transactions, receipts, ("hash", "transaction_hash"), "transactions")
        out["transaction"] = enrich.enrich_transactions(transactions, receipts)
    if "log" in needed:
        logs = in_blocks(parse.parse_logs(of("receipt")), "logs")
        out["log"] = enrich.enrich_logs(blocks, logs)
        if "token_transfer" in needed:
            out["token_transfer"] = enrich.enrich_token_transfers(
                blocks, in_blocks(transfers.extract_token_transfers(logs), "token transfers"))
    if "trace" in needed:
        parsed = cut(parse.parse_traces(of("trace")))
        traces = in_blocks(tracecalc.finish_traces(tracecalc.require_parents(parsed)), "traces")
        out["trace"] = enrich.enrich_traces(blocks, traces)
        if "contract" in needed:
            made = in_blocks(contracts.extract_contracts(traces), "contracts")
            out["contract"] = enrich.enrich_contracts(blocks, made)
            if "token" in needed:
                calls = of("call").select(F.from_json("body", "address string, call string, result string").alias("c")).select("c.*")
                out["token"] = enrich.enrich_tokens(blocks, in_blocks(contracts.resolve_tokens(made, calls), "tokens"))
    return {t: with_item_fields(enrich.canonical_order(out[t], t), t) for t in out if t in set(wanted) | {"block"}}


def _identity() -> F.Column:
    """What a response answers: a later one with the same identity replaces it."""
    by = {"receipt": "$.transactionHash", "call": "$.address"}
    parts = [F.when(F.col("kind") == kind, F.get_json_object("body", path)) for kind, path in by.items()]
    return F.concat_ws(" ", F.coalesce(*parts, F.lit("")), F.when(F.col("kind") == "call", F.get_json_object("body", "$.call")))


def _complete(responses: DataFrame) -> DataFrame:
    """Numbers of the blocks that are there themselves and have as many receipts as transactions."""
    of = lambda kind: responses.filter(F.col("kind") == kind)
    there = of("block").select("block_number")
    asked = parse.parse_transactions(of("block").select("body")).groupBy("block_number").agg(F.count("*").alias("_t"))
    answered = of("receipt").groupBy("block_number").agg(F.count("*").alias("_r"))
    none = F.lit(0)
    return there.join(asked, "block_number", "left").join(answered, "block_number", "left").filter(
        F.coalesce("_t", none) == F.coalesce("_r", none)).select("block_number")


class BlockExport:
    """Export of landed blocks, batch after batch, with a ledger of what was exported.

    Landed responses are staged by block range with a digest. A batch takes the blocks past the stored position
    and, behind it, every block with a staged response that the ledger does not know: a receipt
    that landed late, or one that was sent again with another content. Such a block is exported whole once more
    under the next ``revision``; readers keep the newest revision of each block (``current``).

    A crash anywhere repeats the batch under the same id. Ledger and position are then read as they
    were before that id, and sinks replace batches by id, so nothing is lost or doubled.

    Blocks more than ``settle`` behind the position are settled: their staging folders are removed, and
    what still lands for them goes to ``too_late`` under the base folder. ``hold`` leaves out blocks
    whose receipts are not all there and takes them when they are; without it they raise.
    """

    def __init__(self, spark: SparkSession, base: str, sink: Callable[[dict[str, DataFrame], int], None], wanted: Iterable[str],
                 lag: int = 0, end_block: int | None = None, settle: int = 10 * STAGE_BLOCKS, stage_blocks: int = STAGE_BLOCKS, hold: bool = False):
        self.spark, self.base, self.sink, self.wanted = spark, base, sink, list(wanted)
        self.lag, self.end_block, self.settle, self.stage_blocks, self.hold = lag, end_block, settle, stage_blocks, hold
        self.position = Position(spark, f"{base}/position")

    def _read(self, table: str, schema: str, batch_id: int) -> DataFrame | None:
        """Rows of earlier batches of a versioned table; None if it does not exist yet."""
        folder = f"{self.base}/{table}"
        try:
            rows = self.spark.read.schema(f"{schema}, _v bigint").option("basePath", folder).parquet(folder)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        return rows.filter(F.col("_v") < batch_id)

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        last = self.position.get(before=batch_id)
        settled = max(0, last - self.settle) // self.stage_blocks
        part = F.floor(F.col("block_number") / self.stage_blocks)
        landed = batch.select("kind", "block_number", "body").withColumns({"digest": F.xxhash64("body"), "part": part})
        landed.filter(F.col("part") >= settled).write.mode("overwrite").partitionBy("part").parquet(f"{self.base}/staging/_v={batch_id}")
        landed.filter(F.col("part") < settled).drop("part").write.mode("overwrite").parquet(f"{self.base}/too_late/_v={batch_id}")

        columns = "kind string, block_number bigint, digest bigint"
        staged = self._read("staging", f"{columns}, body string, part bigint", batch_id + 1).filter(F.col("part") >= settled)
        ahead = staged.filter((F.col("part") >= (last + 1) // self.stage_blocks) & (F.col("block_number") > last))
        head = ahead.filter("kind = 'block'").agg(F.max("block_number")).first()[0]
        target = last if head is None else max(last, min(head - self.lag, head if self.end_block is None else self.end_block))

        ledger = self._read("ledger", f"{columns}, revision int", batch_id)
        behind = staged.filter(F.col("block_number") <= last).select("kind", "block_number", "digest")
        known = ["kind", "block_number", "digest"]
        news = behind if ledger is None else behind.join(ledger, known, "left_anti")
        changed = news.select("block_number").distinct()
        fresh = ahead.filter(F.col("block_number") <= target).select("block_number").distinct()
        chosen = staged.join(changed.unionByName(fresh), "block_number", "left_semi")
        # Of several answers to one question the last one counts.
        newest = cut(chosen.withColumn("_id", _identity()).groupBy("kind", "block_number", "_id").agg(
            F.max_by(F.struct("body", "digest"), F.struct("_v", "digest")).alias("_r")).select("kind", "block_number", "_r.*"))
        ready = newest.join(_complete(newest), "block_number", "left_semi") if self.hold else newest
        blocks = ready.select("block_number").distinct()
        if ledger is None:
            revisions = cut(blocks.withColumn("revision", F.lit(0)))
        else:
            earlier = ledger.groupBy("block_number").agg((F.max("revision") + 1).alias("revision"))
            revisions = cut(blocks.join(earlier, "block_number", "left").withColumn("revision", F.coalesce("revision", F.lit(0))))
        if not revisions.isEmpty():
            items = enrich_items(ready.select("kind", "block_number", "body"), self.wanted)
            self.sink({t: self._revised(df, revisions, "number" if t == "block" else "block_number") for t, df in items.items()}, batch_id)
        # All answers that were looked at are in the ledger, the replaced ones too.
        done = staged.select(*known).distinct().join(revisions, "block_number")
        done.write.mode("overwrite").parquet(f"{self.base}/ledger/_v={batch_id}")
        if target > last:
            self.position.set(target, batch_id)
        now_settled = max(0, target - self.settle) // self.stage_blocks
        for k in range(settled, now_settled):
            remove_folders(self.spark, f"{self.base}/staging/_v=*/part={k}")

    @staticmethod
    def _revised(items: DataFrame, revisions: DataFrame, key: str) -> DataFrame:
        return items.join(revisions.withColumnRenamed("block_number", key), key).select(*items.columns, "revision")


def export_blocks(
    source: DataFrame,
    base: str,
    sink: Callable[[dict[str, DataFrame], int], None],
    wanted: Iterable[str] = ("block", "transaction", "log", "token_transfer"),
    lag: int = 0,
    end_block: int | None = None,
    start_block: int | None = None,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Export landed blocks up to ``min(head - lag, end_block)``, batch after batch; options as for ``BlockExport``."""
    export = BlockExport(source.sparkSession, base, sink, wanted, lag, end_block, **options)
    if start_block is not None or export.position.get() is None:
        export.position.begin(0 if start_block is None else start_block)
    writer = source.writeStream.outputMode("append").foreachBatch(export.handle)
    if trigger is None:
        return run_available(writer, f"{base}/ckpt")
    return writer.option("checkpointLocation", f"{base}/ckpt").trigger(**trigger).start()


def current(items: DataFrame, block: str = "block_number") -> DataFrame:
    """Exported items without those of replaced revisions of their block."""
    newest = items.groupBy(block).agg(F.max("revision").alias("revision"))
    return items.join(newest, [block, "revision"], "left_semi").drop("revision")


def join_with_blocks(rows: DataFrame, blocks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stream-stream join of logs, transfers or traces with blocks.

    Both sides carry ``event_time``, a block's time, so old state can be dropped once
    the watermark passes.
    """
    left = rows.withWatermark("event_time", delay).alias("l")
    right = blocks.select(
        "number", F.col("hash").alias("block_hash"), F.col("timestamp").alias("block_timestamp"),
        F.col("event_time").alias("block_time"),
    ).withWatermark("block_time", delay).alias("b")
    match = (F.col("l.block_number") == F.col("b.number")) & (F.col("l.event_time") == F.col("b.block_time"))
    return left.join(right, match).select("l.*", "b.block_hash", "b.block_timestamp")


def drop_repeated_items(items: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First copy of each item id within the watermark."""
    return items.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["item_id"])


def landed_blocks(raw: DataFrame, kind: str) -> DataFrame:
    """Raw single-block responses as landed rows."""
    key = {"block": "$.number", "receipt": "$.blockNumber"}.get(kind)
    number = hex_to_long(F.get_json_object("body", key)) if key else F.get_json_object("body", "$[0].blockNumber").cast("bigint")
    return raw.select(F.lit(kind).alias("kind"), number.alias("block_number"), "body")
