"""Bead trajectories stored as Parquet, partitioned by label and replica."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldspark import schemas
from foldspark.operators import shape


def replica_range(beads: DataFrame, start: int, end: int) -> DataFrame:
    """Replicas start..end, both included; prunes partitions on a partitioned table."""
    return beads.filter(F.col("replica").between(start, end))


def every_nth(beads: DataFrame, stride: int) -> DataFrame:
    """Frames whose number lies a multiple of ``stride`` after the replica's first."""
    first = beads.groupBy("label", "replica").agg(F.min("frame").alias("_first"))
    return (beads.join(first, ["label", "replica"])
            .filter((F.col("frame") - F.col("_first")) % stride == 0).select(beads.columns))


def select_beads(beads: DataFrame, bead_types: DataFrame, kind: str) -> DataFrame:
    """Beads of one type, renumbered from 0 in bead order."""
    rank = F.row_number().over(W.partitionBy("label").orderBy("bead")) - 1
    chosen = (bead_types.filter(F.col("type") == kind).select("label", "bead").distinct()
              .withColumn("_new", rank.cast("int")))
    return (beads.join(chosen, ["label", "bead"])
            .withColumn("bead", F.col("_new")).select(beads.columns))


def load_beads(spark: SparkSession, datasets: dict[str, str], *, replicas: tuple[int, int],
               stride: int, kind: str | None = None, bead_types: DataFrame | None = None,
               pad_frames: bool = False, pad_beads: bool = False) -> DataFrame:
    """Registered data sets (label -> folder) as one bead table.

    Missing and unreadable files are skipped. Padding in coordinate space is
    off unless asked for; matrices are padded later instead.
    """
    reader = spark.read.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    parts = [schemas.conform(reader.parquet(path).withColumn("label", F.lit(label)), schemas.BEADS)
             for label, path in datasets.items()]
    beads = replica_range(reduce(DataFrame.unionByName, parts), *replicas)
    beads = every_nth(beads, stride)
    if kind is not None:
        beads = select_beads(beads, bead_types, kind)
    if pad_beads:
        beads = shape.pad_beads(beads)
    if pad_frames:
        beads = shape.pad_frames(beads)
    return beads
