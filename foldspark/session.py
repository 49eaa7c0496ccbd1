"""Session settings, shared work folder and lineage cuts."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the engine relies on; all may be set on a live session.
_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot frame must be split even where the split costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows carry whole matrix rows or tiles, so a batch is bounded by bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in
    ``spark.checkpoint.dir``, else one in the session's warehouse. On a cluster
    a warehouse on the local file system is refused, as nothing says that the
    machines share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/foldspark-state"
        if folder.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/foldspark-{uuid.uuid4().hex}/{name}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_open: dict[str, int] = {}
_before: dict[str, str] = {}


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files; they would stay until the
    driver happens to collect its garbage. Threads may be in here side by side."""
    app = spark.sparkContext.applicationId
    with _lock:
        if not _open.get(app):
            _before[app] = spark.conf.get(_CLEANUP)
            spark.conf.set(_CLEANUP, "true")
        _open[app] = _open.get(app, 0) + 1
    try:
        yield
    finally:
        with _lock:
            _open[app] -= 1
            if not _open[app]:
                spark.conf.set(_CLEANUP, _before.pop(app))


def _store(df: DataFrame, path: str) -> DataFrame:
    with _shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: store the rows as a table in the shared folder and read
    them back. This survives lost executors, and in a loop the planner sees the
    true size of each round's state (a checkpoint would carry the joins' size
    estimates along, which multiply from round to round)."""
    return _store(df, fresh_path(df.sparkSession, "state"))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a stored table by the file system that holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Rounds:
    """Stored tables of a loop by name. A table replaces the one kept under the
    same name before, which is deleted once the new one is written; so whatever
    still reads a kept table must be stored before the name is used again."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._paths: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = fresh_path(self._spark, "state")
        out = _store(df, path)
        before, self._paths[name] = self._paths.get(name), path
        if before:
            delete(self._spark, before)
        return out

    def clear(self) -> None:
        """Delete all kept tables."""
        for path in self._paths.values():
            delete(self._spark, path)
        self._paths.clear()

    def result(self, df: DataFrame) -> DataFrame:
        """Store ``df`` on its own and delete all kept tables."""
        out = cut(df)
        self.clear()
        return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; unlike ``cut`` it keeps row order and partitioning."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
