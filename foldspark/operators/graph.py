"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.session import Rounds


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("_e")).select("_e.u", "_e.v")


def _with_lowest(links: DataFrame) -> DataFrame:
    """Each (u, v) with the lowest id among u and its neighbours."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    return links.join(low, "u")


def _fingerprint(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, max_rounds: int = 100, rounds: Rounds | None = None) -> DataFrame:
    """``(id, comp)`` for every id occurring in ``edges(a, b)``; comp is the
    component's lowest id. Rounds are logarithmic in the component size. The last
    round's table stays; a caller's ``rounds`` lets the caller delete it."""
    links = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rounds = rounds or Rounds(edges.sparkSession)
    links = rounds.keep("links", links)
    before = _fingerprint(links)
    for _ in range(max_rounds):
        # large star: neighbours above u move to the lowest neighbour
        large = (_with_lowest(_both(links)).filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        # small star: u and its lower neighbours move to the lowest of them
        down = _with_lowest(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = down.select(F.explode(F.array(
            F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("_e")).select("_e.a", "_e.b")
        links = rounds.keep("links", small.filter(F.col("a") != F.col("b")).distinct())
        after = _fingerprint(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(roots)
