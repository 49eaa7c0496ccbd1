"""Column contracts of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FRAME_KEY = ["label", "replica", "frame"]

BEADS = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("replica", T.IntegerType()),
    T.StructField("frame", T.LongType()),
    T.StructField("bead", T.IntegerType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
])

BEAD_TYPES = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("bead", T.IntegerType()),
    T.StructField("type", T.StringType()),
])

CONTACTS = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("i", T.IntegerType()),
    T.StructField("j", T.IntegerType()),
    T.StructField("v", T.DoubleType()),
])

METRICS = T.StructType([
    T.StructField("technique", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("norm", T.StringType()),
    T.StructField("silhouette", T.DoubleType()),
    T.StructField("ch", T.DoubleType()),
    T.StructField("db", T.DoubleType()),
])

MERGES = "step long, a long, b long, height double, size long"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to ``schema``; a missing column is an error, types are cast."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; got {df.columns}")
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema])
