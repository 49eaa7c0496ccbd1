"""Imputation, scaling, limits and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.functions.expressions import DBL_MAX, INF, NAN, is_bad
from foldspark.schemas import FRAME_KEY


def clamp_infinite(df: DataFrame) -> DataFrame:
    """Infinite values of either sign become half the largest double."""
    return df.withColumn("v", F.when(F.abs("v") == F.lit(INF), F.lit(DBL_MAX / 2))
                         .otherwise(F.col("v")))


def fill_label_mean(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """NaN becomes the mean of the label's other values (whole square matrices).

    ``labels`` are the registered data sets. Their means form one small map
    read as a scalar subquery, so the cells are neither joined nor shuffled.
    """
    means = (pairs.filter(F.col("label").isin(labels)).groupBy("label")
             .agg(F.avg(F.when(~F.isnan("v"), F.col("v"))).alias("m"))
             .agg(F.map_from_entries(F.collect_list(F.struct("label", "m"))).alias("means")))
    mean = F.coalesce(F.element_at(means.scalar(), F.col("label")), F.lit(NAN))
    return pairs.withColumn("v", F.when(F.isnan("v"), mean).otherwise(F.col("v")))


def fill_bad_with_mean(x: DataFrame) -> DataFrame:
    """Non-finite values of X become the mean of its non-NaN values; ``was_bad``
    marks them. The mean still includes infinities."""
    mean = x.agg(F.avg(F.when(~F.isnan("v"), F.col("v"))).alias("m"))
    bad = is_bad(F.col("v"))
    return (x.withColumn("was_bad", bad)
            .withColumn("v", F.when(bad, mean.scalar()).otherwise(F.col("v"))))


def scale_to_unit(x: DataFrame, constant: float = 0.0) -> DataFrame:
    """Non-finite to the mean of the finite values, then global min-max to [0, 1].

    The clip at three standard deviations beyond the extremes lies outside the
    data and changes nothing, so it is not evaluated. No finite value at all
    gives zeros; equal values give ``constant``.
    """
    finite = F.when(~is_bad(F.col("v")), F.col("v"))
    stats = x.agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.avg(finite).alias("m"))
    lo, hi, mean = (stats.select(c).scalar() for c in ("lo", "hi", "m"))
    v = F.when(is_bad(F.col("v")), mean).otherwise(F.col("v"))
    scaled = (F.when(lo.isNull(), F.lit(0.0))
              .when(hi == lo, F.lit(constant))
              .otherwise((v - lo) / (hi - lo)))
    return x.withColumn("v", scaled)


def finite_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keep rows (``key``) whose every value is finite."""
    good = (rows.groupBy(key).agg(F.bool_and(~is_bad(F.col("v"))).alias("_ok"))
            .filter("_ok").select(key))
    return rows.join(good, key, "left_semi")


def cutoff(contacts: DataFrame, limit: float) -> DataFrame:
    return contacts.withColumn("v", F.when(F.col("v") < limit, F.lit(0.0)).otherwise(F.col("v")))


def nan_to_zero(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.nanvl("v", F.lit(0.0)))


def first_frames(beads: DataFrame, n: int) -> DataFrame:
    """Beads of each label's first n frames in stacking order (replica, frame).

    Counts per replica place every replica's first frame, so a rank is needed
    only inside the replica the limit falls into; earlier replicas are kept
    whole and later ones dropped without sorting them.
    """
    from pyspark.sql import Window as W

    frames = beads.select(FRAME_KEY).distinct()
    counts = frames.groupBy("label", "replica").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("label").orderBy("replica").rowsBetween(W.unboundedPreceding, -1)
    start = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    whole = start.filter(F.col("_start") + F.col("_n") <= n).select("label", "replica")
    partial = start.filter((F.col("_start") < n) & (F.col("_start") + F.col("_n") > n))
    # row_number <= bound becomes a partial per-task top-k before the shuffle
    rank = F.row_number().over(W.partitionBy("label", "replica").orderBy("frame"))
    head = (frames.join(partial, ["label", "replica"])
            .withColumn("_r", rank).filter(F.col("_r") <= F.lit(n))
            .filter(F.col("_r") + F.col("_start") <= n).select(FRAME_KEY))
    kept = frames.join(whole, ["label", "replica"], "left_semi").select(FRAME_KEY).unionByName(head)
    return beads.join(kept, FRAME_KEY, "left_semi")


def bootstrap(x: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows drawn with replacement by dense ``row_id``; ``draw`` numbers them.

    Draws come from a hash of (draw, seed), so they do not depend on how the
    data is partitioned.
    """
    total = x.agg(F.count(F.lit(1)).alias("n")).scalar()
    digest = F.md5(F.concat_ws("-", F.col("draw").cast("string"), F.lit(str(seed))))
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    draws = (x.sparkSession.range(n).withColumnRenamed("id", "draw")
             .withColumn("row_id", number % total))
    return draws.join(x, "row_id")
