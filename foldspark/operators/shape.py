"""Padding, flattening, stacking and symmetrising of frame matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldspark.functions.expressions import pair_index
from foldspark.schemas import FRAME_KEY
from foldspark.session import checkpointed


def dense_index(df: DataFrame, order: list, name: str) -> DataFrame:
    """Add a gap-free 0-based index in the given order without a single-task window.

    The sort is range partitioned and its result is fixed by a checkpoint; the
    only table gathered is one row count per partition.
    """
    fixed = checkpointed(df.orderBy(*order)).withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftright("_mid", 33)
    counts = fixed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (fixed.withColumn("_part", part)
            .join(F.broadcast(offsets), "_part")  # one row per partition
            .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_part", "_mid", "_off"))


def pad_beads(beads: DataFrame) -> DataFrame:
    """Give every frame of a label all bead positions up to the label's largest,
    missing ones at the origin."""
    top = beads.groupBy("label").agg(F.max("bead").alias("_top"))
    frames = beads.select(FRAME_KEY).distinct().join(top, "label")
    grid = frames.select(*FRAME_KEY, F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("bead"))
    zero = F.lit(0.0)
    return grid.join(beads, [*FRAME_KEY, "bead"], "left").select(
        *FRAME_KEY, "bead", *[F.coalesce(F.col(c), zero).alias(c) for c in "xyz"])


def pad_frames(beads: DataFrame) -> DataFrame:
    """Append all-zero frames to replicas with fewer frames than the label's
    longest replica. Ghost frames take the numbers after the replica's last."""
    per_replica = beads.groupBy("label", "replica").agg(
        F.count_distinct("frame").alias("_n"), F.max("frame").alias("_last"))
    per_label = (beads.groupBy("label").agg(F.max("bead").alias("_top"))
                 .join(per_replica.groupBy("label").agg(F.max("_n").alias("_most")), "label"))
    short = per_replica.join(per_label, "label").filter(F.col("_n") < F.col("_most"))
    ghosts = (short
              .withColumn("_g", F.explode(F.sequence(F.lit(1).cast("long"),
                                                     F.col("_most") - F.col("_n"))))
              .select("label", "replica", (F.col("_last") + F.col("_g")).alias("frame"),
                      F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("bead"),
                      *[F.lit(0.0).alias(c) for c in "xyz"]))
    return beads.select(*FRAME_KEY, "bead", "x", "y", "z").unionByName(ghosts)


def _spread(width: int, columns: list[str]):
    rows, cols = np.triu_indices(width, 1)
    per = len(rows)

    def run(batches):
        place = np.zeros((width, width), dtype=np.int64)
        place[rows, cols] = np.arange(per)
        for batch in batches:
            step = max(1, 1_000_000 // max(per, 1))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                cells, n = part.column("_cells"), part.num_rows
                lengths = cells.value_lengths().to_numpy(zero_copy_only=False)
                flat = cells.flatten()
                i, j, v = (flat.field(c).to_numpy(zero_copy_only=False) for c in "ijv")
                out = np.zeros(n * per)
                out[np.repeat(np.arange(n), lengths) * per + place[i, j]] = v
                owner = pa.array(np.repeat(np.arange(n), per))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(owner) for c in columns),
                     pa.array(np.tile(rows, n), pa.int32()), pa.array(np.tile(cols, n), pa.int32()),
                     pa.array(out)], [*columns, "i", "j", "v"])
    return run


def pad_matrices(pairs: DataFrame, width: int) -> DataFrame:
    """Every frame's strict upper triangle at the given width, zeros where no value is.

    Only the present cells are shuffled; the zeros appear after it. Diagonal cells
    keep a frame of one bead, which has no others.
    """
    types = dict(pairs.dtypes)
    key = ", ".join(f"{c} {types[c]}" for c in FRAME_KEY)
    cell = F.when(F.col("i") < F.col("j"), F.struct("i", "j", "v"))
    grouped = pairs.filter(F.col("i") <= F.col("j")).groupBy(FRAME_KEY).agg(
        F.collect_list(cell).alias("_cells"))
    return grouped.mapInArrow(_spread(width, FRAME_KEY), f"{key}, i int, j int, v double")


def flatten(pairs: DataFrame, width: Column | int) -> DataFrame:
    """Strict upper triangle as (frame key, f, v), f row-major."""
    return pairs.filter(F.col("i") < F.col("j")).select(
        *FRAME_KEY, pair_index(F.col("i"), F.col("j"), width).alias("f"), "v")


def stack(frames: DataFrame, labels: list[str]) -> DataFrame:
    """``row_id`` for each frame: labels in call order, then replica, then frame."""
    order = F.element_at(F.create_map(*[x for n, l in enumerate(labels)
                                        for x in (F.lit(l), F.lit(n))]), F.col("label"))
    keys = (frames.filter(F.col("label").isin(labels)).select(FRAME_KEY).distinct()
            .withColumn("_ord", order))
    return dense_index(keys, ["_ord", "replica", "frame"], "row_id").drop("_ord")


def _packer(width: int):
    def run(batches):
        step = max(1, 2_000_000 // max(width, 1))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            cells = batch.column("_cells")
            n = batch.num_rows
            pad = batch.column("_pad").to_numpy(zero_copy_only=False)
            out = np.repeat(pad, width)
            lengths = cells.value_lengths().to_numpy(zero_copy_only=False)
            flat = cells.flatten()
            rows = np.repeat(np.arange(n, dtype=np.int64), lengths)
            at = rows * width + flat.field("f").to_numpy(zero_copy_only=False)
            out[at] = flat.field("v").to_numpy(zero_copy_only=False)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width, pa.int32())
            names = [c for c in batch.schema.names if c not in ("_cells", "_pad")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names),
                 pa.ListArray.from_arrays(offsets, pa.array(out))], [*names, "v"])
    return run


def pack(rows: DataFrame, width: int) -> DataFrame:
    """Rows holding ``_cells array<struct<f, v>>`` and ``_pad`` to dense arrays ``v``."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema
                       if f.name not in ("_cells", "_pad"))
    return rows.mapInArrow(_packer(width), f"{schema}, v array<double>")


def unpack(x: DataFrame) -> DataFrame:
    """One row per (row, feature) from packed arrays."""
    keep = [c for c in x.columns if c != "v"]
    return x.select(*keep, F.posexplode("v").alias("f", "v")).withColumn("f", F.col("f").cast("long"))


def square(pairs: DataFrame, diagonal: float = 0.0, key: list[str] | None = None) -> DataFrame:
    """Whole symmetric matrix from i < j cells. Row indices that occur in no
    cell have no diagonal entry."""
    key = FRAME_KEY if key is None else key
    half = pairs.filter(F.col("i") < F.col("j"))
    # one scan: each cell yields itself and its mirror image
    both = half.select(*key, F.explode(F.array(F.struct("i", "j"), F.struct(
        F.col("j").alias("i"), F.col("i").alias("j")))).alias("_c"), "v")
    ends = (half.select(*key, F.explode(F.array("i", "j")).alias("i")).distinct()
            .select(*key, "i", F.col("i").alias("j"), F.lit(diagonal).alias("v")))
    return both.select(*key, "_c.i", "_c.j", "v").unionByName(ends)


def matrix_rows(pairs: DataFrame) -> DataFrame:
    """Re-key a stack of matrices as rows (frame, i) with features j."""
    return pairs.select(*FRAME_KEY, F.col("i").alias("row"), F.col("j").cast("long").alias("f"), "v")
