"""Session helpers: a tuned local session, shipping this package to Python workers, shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_FALLBACK: dict[str, str] = {}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine; on a cluster, pass the session that the cluster gives instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarrylens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


MERGE = "merge"  # hint for joins of tables that grow with the corpus: Spark judges them by packed size, and the driver would hold them unpacked
ROWS_A_BATCH = 2000  # rows are whole texts; Spark's own 10,000 make batches of tens of megabytes


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once for each application, and keep their batches small unless the
    session has its own setting."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size, "10000") == "10000":
        spark.conf.set(size, str(ROWS_A_BATCH))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), f"{root.name}_{app.replace('-', '_')}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset, one of our own.

    Only a purely local master may use a temporary folder of this machine; elsewhere the warehouse is used.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        if spark.sparkContext.master.split("[")[0] == "local":
            _FALLBACK[app] = f"file://{tempfile.mkdtemp(prefix='quarrylens-')}"
        else:
            _FALLBACK[app] = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return _FALLBACK[app]


_MADE: list[Scratch] = []


def scratch_mark() -> int:
    """A mark for release_since()."""
    return len(_MADE)


def release_since(mark: int) -> None:
    """Delete all scratch folders that this thread made since the mark; only where none of them is read any more."""
    for s in [x for x in _MADE[mark:] if x.thread == threading.get_ident()]:
        s.clear()
        _MADE.remove(s)


class Scratch:
    """Intermediate tables written to the shared folder, which cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.thread = spark, threading.get_ident()
        _MADE.append(self)
        self.root = f"{shared_dir(spark)}/quarrylens/{name}-{uuid.uuid4().hex}"
        self._n = 0
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it back."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def clear(self) -> None:
        """Delete the whole folder."""
        self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root), True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made by table(), once nothing reads them any more."""
        for t in tables:
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._scratch_path), True)
