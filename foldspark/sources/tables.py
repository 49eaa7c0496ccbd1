"""Engine tables derived by Spark from the given star-schema tables.

Every derivation is a scan plus at most one hash aggregate with map-side
combine, so a key holding a large share of all rows collapses before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark import schemas

# Names used by the derived metrics table.
TECHNIQUES = ["MDS", "PCA", "SVD", "t-sne", "UMAP"]
METHODS = ["single", "weighted", "complete", "average"]
METRICS = ["contact", "euclidean", "log2_contact", "pearsons", "spearman"]
NORMS = ["log_transform", "vc", "kr", "ice"]
LABELS = ["A", "B", "C", "D"]
BEAD_KINDS = ["A1", "A2", "B1"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def beads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per order; line number and supplier parity give the bead."""
    li = table(spark, sf_dir, "lineitem")
    order = F.col("l_orderkey")
    keyed = li.select(
        _pick(LABELS, order % 4).alias("label"),
        (F.floor(order / 4) % 20 + 1).cast("int").alias("replica"),
        order.alias("frame"),
        ((F.col("l_linenumber") - 1) * 2 + F.col("l_suppkey") % 2).cast("int").alias("bead"),
        "l_quantity", "l_extendedprice", (F.col("l_discount") + 0.0).alias("d"))
    return schemas.conform(
        keyed.groupBy("label", "replica", "frame", "bead").agg(
            F.max("l_quantity").alias("x"),
            (F.max("l_extendedprice") / 1000).alias("y"),
            (100 * F.max("d")).alias("z")),
        schemas.BEADS)


def beads_with_gaps(spark: SparkSession, sf_dir: str, infinite: bool = False) -> DataFrame:
    """``beads`` with NaN (centromere-like) and, on request, infinite coordinates."""
    x = F.when((F.col("bead") == 3) & (F.col("frame") % 7 == 0), F.lit(float("nan")))
    if infinite:
        x = x.when((F.col("bead") == 2) & (F.col("frame") % 11 == 0), F.lit(float("inf")))
    return beads(spark, sf_dir).withColumn("x", x.otherwise(F.col("x")))


def beads_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``beads`` shifted so that negative coordinates occur."""
    return (beads(spark, sf_dir).withColumn("x", F.col("x") - 25)
            .withColumn("y", F.col("y") - 50).withColumn("z", F.col("z") - 5))


def bead_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type of each bead position of each label."""
    seen = beads(spark, sf_dir).select("label", "bead").distinct()
    return schemas.conform(
        seen.withColumn("type", _pick(BEAD_KINDS, F.col("bead") % 3)), schemas.BEAD_TYPES)


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact counts between supplier loci: quantity summed per cell, one map
    for even orders ('sim') and one for odd orders ('exp')."""
    li = table(spark, sf_dir, "lineitem")
    n = li.agg((F.max("l_suppkey") + 1).alias("n"))
    cells = li.select(
        F.when(F.col("l_orderkey") % 2 == 0, "sim").otherwise("exp").alias("source"),
        F.col("l_suppkey").alias("i"), (F.col("l_partkey") % n.scalar()).alias("j"),
        "l_quantity")
    return schemas.conform(
        cells.groupBy("source", "i", "j").agg(F.sum("l_quantity").alias("v")),
        schemas.CONTACTS)


def contacts_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts(spark, sf_dir).withColumn(
        "v", F.when((F.col("i") + F.col("j")) % 17 == 0, F.lit(float("nan"))).otherwise(F.col("v")))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature row per embedding; its label serves as a given clustering."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("cluster"),
        F.col("embedding").cast("array<double>").alias("v"))


def metrics_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored run per line item; the four keys repeat."""
    li = table(spark, sf_dir, "lineitem")
    return schemas.conform(li.select(
        _pick(TECHNIQUES, F.col("l_partkey") % 5).alias("technique"),
        _pick(METHODS, F.col("l_suppkey") % 4).alias("method"),
        _pick(METRICS, F.col("l_orderkey") % 5).alias("metric"),
        _pick(NORMS, F.col("l_linenumber") % 4).alias("norm"),
        ((F.col("l_extendedprice") % 700) / 350 - 1).alias("silhouette"),
        (F.col("l_extendedprice") / 97).alias("ch"),
        (F.col("l_extendedprice") % 90 / 7 + F.col("l_tax")).alias("db")), schemas.METRICS)


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A falling curve per line number: revenue of lines with quantity >= 3k, k = 2..15."""
    li = table(spark, sf_dir, "lineitem")
    last = F.least(F.lit(15), F.floor(F.col("l_quantity") / 3).cast("int"))
    return (li.filter(last >= 2)
            .select(F.col("l_linenumber").alias("series"), F.explode(F.sequence(F.lit(2), last)).alias("k"),
                    "l_extendedprice")
            .groupBy("series", "k").agg(F.sum("l_extendedprice").alias("y")))
