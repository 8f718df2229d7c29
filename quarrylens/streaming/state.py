"""Incremental analysis: the latest facts of each file, kept as versioned tables in a shared folder.

A version is a manifest: for each bucket of path hashes the folder that holds the bucket's rows (path, description,
facts), and for each stream the last batch that it has applied.  A batch of changes rewrites only the buckets of its
paths and then adds the next manifest, so a batch that fails leaves the old version in place, and a stream's batch
that is run twice gives the same version.  Files whose content hash is unchanged keep their row and are not analysed
again.  The last KEEP versions stay readable; folders that none of them names are removed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.operators.extract import extract
from quarrylens.session import shared_dir
from quarrylens.sources.files import describe

BUCKETS, KEEP = 64, 2
_DESCRIBED = ("content", "file_role", "estimated_tokens", "content_hash", "language")


class FactStore:
    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        """buckets is fixed when a store is made; a change rewrites about 1/buckets of the store for each path at most."""
        self.spark, self.buckets = spark, buckets
        self.path = path or f"{shared_dir(spark)}/quarrylens/facts-{uuid.uuid4().hex}"

    # --- manifests: small JSON files; the newest name wins

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _manifests(self) -> list[str]:
        fs, p = self._fs(f"{self.path}/versions")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _read(self, name: str) -> dict:
        fs, p = self._fs(f"{self.path}/versions/{name}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _now(self) -> dict:
        names = self._manifests()
        return self._read(names[-1]) if names else {"version": 0, "buckets": {}, "applied": {}}

    @property
    def version(self) -> int:
        names = self._manifests()
        return int(names[-1].split("-")[0]) if names else 0

    def rows(self, back: int = 0) -> DataFrame | None:
        """The current version, or one further back; null before the first."""
        names = self._manifests()
        return self._rows(self._read(names[-1 - back])["buckets"].values()) if len(names) > back else None

    def _rows(self, folders) -> DataFrame:
        folders = [f"{self.path}/{f}" for f in folders]
        schema = self._empty().schema
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _empty(self) -> DataFrame:
        return self._analyzed(self.spark.createDataFrame([], "path string, content string"))

    def _bucket(self):
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def _commit(self, rows: DataFrame, touched: set[int] | None, applied: dict[str, int]) -> int:
        """Write rows, which are all of the touched buckets (None: of all), and then the manifest."""
        now = self._now()
        version = now["version"] + 1
        name = f"{version:012d}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        fs, p = self._fs(f"{self.path}/data/{name}")
        made = {s.getPath().getName().removeprefix("bucket=") for s in fs.listStatus(p) if s.isDirectory()}
        kept = {} if touched is None else {k: f for k, f in now["buckets"].items() if int(k) not in touched}
        manifest = {"version": version, "buckets": kept | {k: f"data/{name}/bucket={k}" for k in made if k.isdigit()}, "applied": now["applied"] | applied}
        fs, p = self._fs(f"{self.path}/versions/{name}")
        out = fs.create(p)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._clean()
        return version

    def _clean(self) -> None:
        """Remove manifests but the last KEEP, and folders that these do not name."""
        names = self._manifests()
        used = {f for n in names[-KEEP:] for f in self._read(n)["buckets"].values()}
        for n in names[:-KEEP]:
            fs, p = self._fs(f"{self.path}/versions/{n}")
            gone = set(self._read(n)["buckets"].values()) - used
            fs.delete(p, False)
            for f in gone:
                fs.delete(self._fs(f"{self.path}/{f}")[1], True)

    # --- changes

    def replace_all(self, files: DataFrame) -> int:
        """Forget everything and take these files(path, content[, seq])."""
        return self._commit(self._analyzed(self._last(files)), None, {})

    @staticmethod
    def _last(files: DataFrame) -> DataFrame:
        """One row a path: the last by seq, or, without seq, the one with the greatest text."""
        order = F.struct("seq", "content") if "seq" in files.columns else F.col("content")
        return files.groupBy("path").agg(F.max_by("content", order).alias("content"))

    @staticmethod
    def _analyzed(files: DataFrame) -> DataFrame:
        return extract(describe(files), keep=_DESCRIBED)

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int:
        """New or changed files(path, content[, seq]) and deleted paths; of several rows of a path the last by seq
        counts.  A file that cannot be analysed any more is as good as deleted.  batch names a stream and its batch
        number; a batch that was applied before, or one before it, changes nothing."""
        now = self._now()
        if batch is not None and now["applied"].get(batch[0], -1) >= batch[1]:
            return now["version"]
        old, gone, fresh = self.rows(), None, None
        if upserts is not None:
            fresh = self._last(upserts)
            if old is not None:
                fresh = fresh.withColumn("content_hash", F.sha2("content", 256)).join(old.select("path", "content_hash"), ["path", "content_hash"], "left_anti").select("path", "content")
            fresh = fresh.persist()
            gone = fresh.select("path")
        if deletes is not None:
            gone = deletes.select("path") if gone is None else gone.union(deletes.select("path"))
        touched = {r.b for r in gone.select(self._bucket().alias("b")).distinct().collect()} if gone is not None else set()  # at most `buckets`
        rest = self._rows(f for k, f in now["buckets"].items() if int(k) in touched)
        if gone is not None:
            rest = rest.join(gone, "path", "left_anti")
        rows = rest if fresh is None else rest.unionByName(self._analyzed(fresh).where(F.col("error").isNull()))
        version = self._commit(rows, touched, {batch[0]: batch[1]} if batch else {})
        if fresh is not None:
            fresh.unpersist()
        return version

    def follow(self, stream: DataFrame, checkpoint: str, deleted: str | None = "deleted"):
        """A streaming query that applies every micro-batch of (path, content[, seq][, deleted]) once; with seq, only
        the last row of a path in a batch counts, be it a text or a deletion."""

        def step(batch: DataFrame, epoch: int) -> None:
            gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted in batch.columns else F.lit(False)
            batch = batch.withColumn("_gone", gone)
            if "seq" in batch.columns:
                batch = batch.groupBy("path").agg(F.max_by(F.struct("content", "_gone"), F.struct("seq", "_gone", "content")).alias("x")).select("path", "x.content", "x._gone")
            batch = batch.persist()
            self.apply(batch.where(~F.col("_gone")).select("path", "content"), batch.where("_gone").select("path"), (checkpoint, epoch))
            batch.unpersist()

        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
