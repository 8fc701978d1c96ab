"""A keyed table on plain files: base and deltas under a manifest that is swapped whole.

Layout of a table's folder::

    data/<folder>/_k=<bucket>/…   rows of one write, by key bucket
    manifest/<number>.json        which folders count; the highest number is in force

A batch is written as a delta and then named in a new manifest, which appears by a rename, so a
reader sees a batch whole or not at all. After ``compact_every`` deltas the buckets that they touch are
rewritten with the newest row of each key, in one job over their rows; buckets without news stay
where they are. Folders that no manifest in force or just before names are removed then. So a
table has at most one base folder per bucket, the deltas since, and two manifests' worth of leftovers.

A batch that comes again replaces its delta; one that is part of the base already changes nothing. Batches
count in the order of their ids: of two rows of a key the one of the later batch wins, and of rows
of one batch the largest by all columns, so results are the same on every run.

One writer at a time; the loser of two renames to one number raises.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .files import latest_rows


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16, compact_every: int = 10):
        self.spark, self.path, self.keys = spark, path, keys
        self.buckets, self.compact_every = buckets, compact_every

    # ------------------------------------------------------------ manifests

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        files, path = self._fs(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json") and not n.startswith("."))

    def _load(self, number: int) -> dict:
        files, path = self._fs(f"{self.path}/manifest/{number}.json")
        stream = files.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def manifest(self) -> dict:
        """``{number, base: {bucket: folder}, deltas: {batch: folder}, compacted: last batch in the base}``"""
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else {"number": 0, "base": {}, "deltas": {}, "compacted": None, "schema": None}

    def _swap(self, manifest: dict) -> None:
        manifest = {**manifest, "number": manifest["number"] + 1}
        files, temporary = self._fs(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = files.create(temporary)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = self._fs(f"{self.path}/manifest/{manifest['number']}.json")[1]
        if files.exists(final) or not files.rename(temporary, final):
            files.delete(temporary, False)
            raise RuntimeError(f"manifest {manifest['number']} was written by someone else")

    # ------------------------------------------------------------ writing

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Merge a batch; on conflict its rows win over those of earlier batches."""
        now = self.manifest()
        if now["compacted"] is not None and batch_id <= now["compacted"]:
            return
        folder = f"delta-{batch_id}-{uuid.uuid4().hex}"
        self._write(self._newest(batch.withColumn("_version", F.lit(batch_id).cast("bigint"))), folder)
        deltas = {**now["deltas"], str(batch_id): folder}
        schema = now["schema"] or batch.schema.json()
        self._swap({**now, "deltas": deltas, "schema": schema})
        if len(deltas) >= self.compact_every:
            self.compact()

    def _write(self, rows: DataFrame, folder: str) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows.withColumn("_k", bucket).repartition("_k").write.partitionBy("_k").parquet(f"{self.path}/data/{folder}")

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row per key, by version and then by content; null keys are keys."""
        rest = [c for c in rows.columns if c not in (*self.keys, "_version")]
        order = F.struct("_version", F.xxhash64(*rest) if rest else F.lit(0), *rest)
        return latest_rows(rows.withColumn("_order", order), self.keys, "_order").drop("_order")

    def compact(self) -> None:
        """Bring the buckets that deltas touch up to date; the others stay as they are."""
        now = self.manifest()
        if not now["deltas"]:
            return
        touched = sorted({name[3:] for folder in now["deltas"].values() for name in self._names(f"data/{folder}") if name.startswith("_k=")}, key=int)
        folder = f"base-{uuid.uuid4().hex}"
        if touched:
            self._write(self._newest(self._rows(now, touched)), folder)
        base = {**now["base"], **{k: folder for k in touched}}
        self._swap({**now, "base": base, "deltas": {}, "compacted": max(map(int, now["deltas"]))})
        self._clean()

    def _clean(self) -> None:
        """Remove folders and manifests that neither the manifest in force nor the one before names."""
        numbers = self._numbers()
        kept = [self._load(n) for n in numbers[-2:]]
        named = {f for m in kept for f in (*m["base"].values(), *m["deltas"].values())}
        for name in self._names("data"):
            if name not in named:
                files, path = self._fs(f"{self.path}/data/{name}")
                files.delete(path, True)
        for n in numbers[:-2]:
            files, path = self._fs(f"{self.path}/manifest/{n}.json")
            files.delete(path, False)

    # ------------------------------------------------------------ reading

    def _rows(self, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"])).add("_version", LongType())
        wanted = lambda k: buckets is None or k in buckets
        paths = [f"{self.path}/data/{folder}/_k={k}" for k, folder in manifest["base"].items() if wanted(k)]
        for folder in manifest["deltas"].values():
            paths += [f"{self.path}/data/{folder}/{name}" for name in self._names(f"data/{folder}") if name.startswith("_k=") and wanted(name[3:])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The newest row of every key."""
        now = self.manifest()
        if now["schema"] is None:
            raise ValueError(f"no batch was ever written to {self.path}")
        return self._newest(self._rows(now)).drop("_version")
