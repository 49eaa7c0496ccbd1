"""Normalisation of whole (square) frame matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from foldspark.functions.expressions import log2_plus_one, safe_divide
from foldspark.schemas import FRAME_KEY
from foldspark.session import Rounds, cut

# A frame of at most this many beads (8 MB of doubles) is balanced as one
# packed matrix; a larger one is balanced as tiles across the cluster.
PACKED_BEADS = 1024
# Cells that are balanced at once: the rounds then stay in a core's own memory.
_CHUNK_CELLS = 1 << 15
# Rows and columns of a tile of a larger frame.
TILE_SIDE = 512


def log_transform(square: DataFrame) -> DataFrame:
    return square.withColumn("v", log2_plus_one(F.col("v")))


def vc(square: DataFrame) -> DataFrame:
    """Each row divided by its sum. The window reuses the frame partitioning of
    the distance join, so nothing is shuffled for it."""
    total = F.sum("v").over(W.partitionBy(*FRAME_KEY, "i"))
    return square.withColumn("v", safe_divide(F.col("v"), total))


def balance(m: np.ndarray, rounds: int, tol: float, balanced: bool) -> np.ndarray:
    """Balance a stack of equally sized matrices; each stops on its own."""
    step = max(1, _CHUNK_CELLS // max(1, m.shape[1] * m.shape[2]))
    if len(m) > step:
        return np.concatenate([balance(m[at:at + step], rounds, tol, balanced) for at in range(0, len(m), step)])
    f, n = m.shape[:2]
    # frames side by side in memory, so that sums and quotients run along them
    m = np.ascontiguousarray(np.moveaxis(m, 0, 2))
    bias = np.ones((n, f))
    previous = bias.copy()
    live = np.ones(f, dtype=bool)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            if not live.any():
                break
            b, a = (bias, m) if live.all() else (bias[:, live], m[:, :, live])
            rows = (a / b[None]).sum(1) / b
            cols = (a / b[:, None]).sum(0) / b
            new = np.where((b != 0) & (rows != 0) & (cols != 0), b * np.sqrt(rows * cols), 1.0)
            if balanced:
                change = np.abs(np.sqrt(new * b) - np.sqrt(b * previous[:, live])).sum(0)
            else:
                change = np.abs(new - b).sum(0)
            previous[:, live], bias[:, live] = b, new
            live[np.flatnonzero(live)[change < tol]] = False
        if balanced:
            bias = np.sqrt(bias * previous)
        scale = bias[:, None] * bias[None]
        return np.moveaxis(np.where(scale != 0, m / np.where(scale != 0, scale, 1.0), 0.0), 2, 0)


def _balance_batches(rounds: int, tol: float, balanced: bool):
    def run(batches):
        for batch in batches:
            cells = batch.column("_cells")
            sizes = cells.value_lengths().to_numpy(zero_copy_only=False)
            flat = cells.flatten()
            v = flat.field("v").to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            out = np.empty_like(v)
            for size in np.unique(sizes):
                n = int(round(size ** 0.5))
                if n * n != size:
                    raise ValueError("balancing needs whole square matrices")
                which = np.flatnonzero(sizes == size)
                step = max(1, _CHUNK_CELLS // int(size))
                for at in range(0, len(which), step):
                    pos = (starts[which[at:at + step]][:, None] + np.arange(size)).ravel()
                    out[pos] = balance(v[pos].reshape(-1, n, n), rounds, tol, balanced).ravel()
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            keys = [batch.column(c).take(pa.array(owner)) for c in FRAME_KEY]
            yield pa.RecordBatch.from_arrays(
                [*keys, flat.field("i"), flat.field("j"), pa.array(out)],
                [*FRAME_KEY, "i", "j", "v"])
    return run


def _packed(square: DataFrame, rounds: int, tol: float, balanced: bool) -> DataFrame:
    grouped = square.groupBy(FRAME_KEY).agg(
        F.sort_array(F.collect_list(F.struct("i", "j", "v"))).alias("_cells"))
    types = dict(square.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [*FRAME_KEY, "i", "j", "v"])
    return grouped.mapInArrow(_balance_batches(rounds, tol, balanced), schema)


_TILE_KEY = [*FRAME_KEY, "bi", "bj"]


def _tiles(square: DataFrame, side: int, parts: int) -> DataFrame:
    """The cells as one record per (row block, column block), spread by that key."""
    cell = F.struct("i", "j", "v")
    return (square.withColumns({"bi": F.floor(F.col("i") / side), "bj": F.floor(F.col("j") / side)})
            .repartition(parts, *_TILE_KEY).groupBy(*_TILE_KEY)
            .agg(F.sort_array(F.collect_list(cell)).alias("cells")))


def _beside(tiles: DataFrame, bias: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each tile with the biases of its rows and of its columns. The biases go
    to the tiles; the tiles stay where they are."""
    every = bias.join(blocks, FRAME_KEY).withColumn("_x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))))
    rows = every.select(*FRAME_KEY, F.col("block").alias("bi"), F.col("_x").alias("bj"), F.col("b").alias("b_row"))
    cols = every.select(*FRAME_KEY, F.col("_x").alias("bi"), F.col("block").alias("bj"), F.col("b").alias("b_col"))
    return tiles.join(rows.hint("merge"), _TILE_KEY).join(cols.hint("merge"), _TILE_KEY)


def _tile_arrays(batch, r: int, side: int):
    cells = batch.column("cells")[r].values
    i, j, v = (cells.field(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "v"))
    own, other = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("b_row", "b_col"))
    return cells, i % side, j % side, v, own, other


def _tile_sums(beside: DataFrame, side: int) -> DataFrame:
    """``(frame, block, down, s)``: of every tile the sums of v / b along its
    rows, for its row block, and down its columns, for its column block."""
    types = dict(beside.dtypes)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                _, i, j, v, own, other = _tile_arrays(batch, r, side)
                keys = [batch.column(c).slice(r, 1) for c in FRAME_KEY]
                with np.errstate(all="ignore"):
                    sums = [np.bincount(i, v / other[j], side), np.bincount(j, v / own[i], side)]
                for block, down, s in zip(("bi", "bj"), (False, True), sums, strict=True):
                    yield pa.RecordBatch.from_arrays(
                        [*keys, batch.column(block).slice(r, 1), pa.array([down]), pa.array([s], pa.list_(pa.float64()))],
                        [*FRAME_KEY, "block", "down", "s"])
    schema = ", ".join(f"{c} {types[c]}" for c in FRAME_KEY) + ", block long, down boolean, s array<double>"
    return beside.mapInArrow(run, schema)


def _scaled_tiles(beside: DataFrame, side: int) -> DataFrame:
    types = dict(beside.dtypes)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                cells, i, j, v, own, other = _tile_arrays(batch, r, side)
                scale = own[i] * other[j]
                out = np.where(scale != 0, v / np.where(scale != 0, scale, 1.0), 0.0)
                keys = [pa.repeat(batch.column(c)[r], len(v)) for c in FRAME_KEY]
                yield pa.RecordBatch.from_arrays([*keys, cells.field("i"), cells.field("j"), pa.array(out)],
                                                 [*FRAME_KEY, "i", "j", "v"])
    schema = ", ".join(f"{c} {types[c]}" for c in FRAME_KEY) + ", i int, j int, v double"
    return beside.mapInArrow(run, schema)


def _tiled(square: DataFrame, rounds: int, tol: float, balanced: bool, side: int = TILE_SIDE) -> DataFrame:
    """The same recurrence over tiles of ``side`` x ``side`` cells. The cells
    are shuffled once; a round moves the biases, one number per bead for each
    tile they meet, and the tiles' sums."""
    spark, kept = square.sparkSession, Rounds(square.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    types = dict(square.dtypes)
    square = cut(square.select(*FRAME_KEY, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "v"))
    tiles = _tiles(square, side, parts).persist(StorageLevel.MEMORY_AND_DISK)
    top = F.floor(F.greatest(F.max("i"), F.max("j")) / side)
    blocks = kept.keep("blocks", square.groupBy(FRAME_KEY).agg(top.alias("top")))
    ones = F.array_repeat(F.lit(1.0), side)
    state = blocks.select(*FRAME_KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("block"),
                          ones.alias("b"), ones.alias("prev"), F.lit(False).alias("done"))

    def total(down: bool) -> F.Column:
        sums = F.transform(F.filter("found", lambda t: t["down"] == down), lambda t: t["s"])
        return F.aggregate(sums, F.array_repeat(F.lit(0.0), side), lambda acc, s: F.zip_with(acc, s, lambda x, y: x + y))

    try:
        for _ in range(rounds):
            state = kept.keep("state", state)
            if state.filter(~F.col("done")).isEmpty():
                break
            # a block's sums are of one tile row and one tile column
            sums = (_tile_sums(_beside(tiles, state.select(*FRAME_KEY, "block", "b"), blocks), side)
                    .groupBy(*FRAME_KEY, "block").agg(F.collect_list(F.struct("down", "s")).alias("found")))
            new = F.zip_with(total(False), total(True),
                             lambda r, c: F.when((r != 0) & (c != 0), F.sqrt(r * c)).otherwise(1.0))
            step = (state.join(sums, [*FRAME_KEY, "block"], "left")
                    .withColumn("nb", F.when(F.col("done") | F.col("found").isNull(), F.col("b")).otherwise(new)))
            if balanced:
                moved = F.zip_with(F.zip_with("nb", "b", lambda x, y: F.sqrt(x * y)),
                                   F.zip_with("b", "prev", lambda x, y: F.sqrt(x * y)), lambda x, y: F.abs(x - y))
            else:
                moved = F.zip_with("nb", "b", lambda x, y: F.abs(x - y))
            change = F.aggregate(moved, F.lit(0.0), lambda acc, t: acc + t)
            stop = step.groupBy(FRAME_KEY).agg(F.sum(change).alias("_change"))
            state = step.join(stop, FRAME_KEY).select(
                *FRAME_KEY, "block", F.col("nb").alias("b"),
                F.when(F.col("done"), F.col("prev")).otherwise(F.col("b")).alias("prev"),
                (F.col("done") | (F.col("_change") < tol)).alias("done"))
        final = F.zip_with("b", "prev", lambda x, y: F.sqrt(x * y)) if balanced else F.col("b")
        bias = state.select(*FRAME_KEY, "block", final.alias("b"))
        out = _scaled_tiles(_beside(tiles, bias, blocks), side)
        return kept.result(out.select(*(F.col(c).cast(types[c]) for c in (*FRAME_KEY, "i", "j", "v"))))
    finally:
        tiles.unpersist()


def ice(square: DataFrame, max_iter: int = 100, tol: float = 1e-5, balanced: bool = False,
        width: int | None = None, packed_beads: int = PACKED_BEADS,
        tile_side: int = TILE_SIDE) -> DataFrame:
    """Iterative balancing.

    By default exactly the published recurrence, whose scale alternates from
    round to round; ``balanced`` returns the geometric mean of the last two
    biases, for which row sums are 1. ``width`` is the largest bead count if
    the caller knows it.
    """
    if width is None:
        width = (square.agg(F.max("i")).first()[0] or 0) + 1
    if width <= packed_beads:
        return _packed(square, max_iter, tol, balanced)
    sizes = square.filter(F.col("i") == F.col("j")).groupBy(FRAME_KEY).agg(
        F.count(F.lit(1)).alias("_n"))
    small = sizes.filter(F.col("_n") <= packed_beads)
    large = sizes.filter(F.col("_n") > packed_beads)
    return (_packed(square.join(small, FRAME_KEY, "left_semi"), max_iter, tol, balanced)
            .unionByName(_tiled(square.join(large, FRAME_KEY, "left_semi"),
                                max_iter, tol, balanced, tile_side)))


def kr(square: DataFrame, **options) -> DataFrame:
    """Same recurrence as ``ice``."""
    return ice(square, **options)


NORMS = {"ice": ice, "kr": kr, "log_transform": log_transform, "vc": vc}


def normalise(square: DataFrame, norm: str | None, **options) -> DataFrame:
    if norm is None or norm == "none":
        return square
    if norm not in NORMS:
        raise KeyError(f"unknown norm {norm!r}; available: {sorted(NORMS)}")
    return NORMS[norm](square, **(options if norm in ("ice", "kr") else {}))
