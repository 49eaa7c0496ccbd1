"""Materialised tables, appended logs and the summary file."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Header of the summary file.
SUMMARY_COLUMNS = {
    "technique": "Reduction Technique", "method": "Method", "metric": "Metric", "norm": "Norm",
    "silhouette": "Silhouette Score", "ch": "Calinski-Harabasz Index",
    "db": "Davies-Bouldin Index",
}


def write_beads(beads: DataFrame, path: str) -> None:
    """Partitioned trajectory table; the rebalance hint lets AQE split a hot
    replica over several files and merge small ones."""
    (beads.hint("rebalance", "label", "replica")
     .write.mode("overwrite").partitionBy("label", "replica").parquet(path))


def fingerprint(labels: list[str], snapshot: str, **params) -> str:
    """Key of a cached table: labels in call order, parameters, and ``snapshot``,
    the input's version (see ``input_version``)."""
    text = json.dumps([labels, snapshot, sorted(params.items())], default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def input_version(df: DataFrame) -> str:
    """Changes with the files a table is read from: their names, sizes and times."""
    spark = df.sparkSession
    found = []
    for name in sorted(df.inputFiles()):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
        found.append((name, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(json.dumps(found).encode()).hexdigest()[:32]


def _finished(spark: SparkSession, path: str) -> bool:
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def materialised(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame],
                 overwrite: bool = False) -> DataFrame:
    """Read the table stored under ``key``; build and store it first where there is
    none or ``overwrite`` is set."""
    path = f"{root}/{key}"
    if overwrite or not _finished(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_metrics(metrics: DataFrame, path: str, kind: str = "reduction") -> None:
    metrics.withColumn("kind", F.lit(kind)).write.mode("append").partitionBy("kind").parquet(path)


def write_summary(metrics: DataFrame, path: str) -> None:
    (metrics.select([F.col(c).alias(name) for c, name in SUMMARY_COLUMNS.items()])
     .write.mode("overwrite").option("header", True).csv(path))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    types = ", ".join(f"`{name}` {'double' if c in ('silhouette', 'ch', 'db') else 'string'}"
                      for c, name in SUMMARY_COLUMNS.items())
    df = spark.read.option("header", True).schema(types).csv(path)
    return df.select([F.col(f"`{name}`").alias(c) for c, name in SUMMARY_COLUMNS.items()])
