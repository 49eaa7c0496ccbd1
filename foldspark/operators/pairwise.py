"""Operators over all pairs of feature rows, without a table of all pairs.

Rows are packed into tiles of bounded size by a hash of their unique id; every
super-block of tile pairs becomes one unit of work, spread by a single shuffle
that ships a tile once per super-block. A vectorised kernel sees the distance block of a tile pair and returns only what
the operator keeps (sums per cluster, nearest rows, a spanning forest ...), so
the quadratic part is arithmetic, never rows. Wide rows are cut into feature
blocks that stream through the same task and add up in place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Bounds of one tile: rows, and doubles held per feature block.
TILE_ROWS = 1024
FEATURE_BLOCK = 2048
# Features up to which plain differences cost less than a product and its repair.
NARROW = 2
# Tiles along a super-block's side at most (where super-blocks would outnumber the slots
# many times: the second, or as many as hold SIDE_BYTES), and output rows it collects
# between two combine steps.
SIDE, LONG_SIDE = 8, 64
SIDE_BYTES = 1 << 26
HELD_ROWS = 1 << 20
# Rows of a distance block worked on at a time, so that they stay in a core's cache.
STRIP = 128


class Tile:
    """Row ids and payload arrays of one side of a tile pair."""

    def __init__(self, ids: np.ndarray, payload: dict[str, np.ndarray]):
        self.ids = ids
        self.payload = payload
        # k least values of each row so far, in any order: the tile pairs of a super-block share them
        self.best: np.ndarray | None = None

    def __getattr__(self, name):
        return self.payload[name]


def _column(values) -> np.ndarray:
    """A struct field as numpy; list fields become a matrix."""
    if pa.types.is_list(values.type):
        n = len(values)
        flat = values.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(n, -1) if n else flat.reshape(0, 0)
    return values.to_numpy(zero_copy_only=False)


def _block_squares(a: np.ndarray, b: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of one feature block; cells that lose digits to
    cancellation are recomputed from differences, as are all of a narrow one.
    ``room`` may be written over, which saves asking for memory again and again."""
    if a.shape[1] <= NARROW:
        d = np.zeros((len(a), len(b)))
        for f in range(a.shape[1]):
            apart = a[:, f, None] - b[None, :, f]
            apart *= apart
            d += apart
        return d
    na, nb = (a * a).sum(1), (b * b).sum(1)
    least = np.full(len(a), np.inf)
    if b is a:
        # as one product, which is symmetric to the last bit
        d = a @ a.T
        d *= 2.0
        np.subtract(na[:, None] + nb[None, :], d, out=d)
        least = np.fmin.reduce(d, 1) if d.size else least
    else:
        size = len(a) * len(b)
        d = np.empty(size) if room is None or len(room) < size else room[:size]
        d, double = d.reshape(len(a), len(b)), 2.0 * a
        for at in range(0, len(a) if len(b) else 0, STRIP):
            strip = slice(at, at + STRIP)
            part = np.matmul(double[strip], b.T, out=d[strip])
            np.subtract(na[strip, None] + nb[None, :], part, out=part)
            least[strip] = np.fmin.reduce(part, 1)
    # only rows whose least value may be that small are looked at cell by cell
    rows = np.flatnonzero(least <= 1e-3 * (na + np.fmax.reduce(nb))) if d.size else np.empty(0, dtype=int)
    near_i, near_j = cells(d[rows] <= 1e-3 * (na[rows, None] + nb[None, :]))
    near_i = rows[near_i]
    step = max(1, 2_000_000 // max(1, a.shape[1]))
    for at in range(0, len(near_i), step):
        i, j = near_i[at:at + step], near_j[at:at + step]
        diff = a[i] - b[j]
        d[i, j] = (diff * diff).sum(1)
    return d


def _runner(kernel: Callable, payload: list[str], schema: pa.Schema, need_distance: bool, blocks: int,
            side: int, combine: Callable | None, both: bool = False):
    """Work on one super-block at a time: all pairs of its tiles. ``combine``
    cuts the super-block's collected output down before it leaves the task."""
    names = [f.name for f in schema]

    def outputs(a, b, d2):
        """The kernel's output for both orders of a tile pair; a kernel of ``both``
        orders sees the pair once."""
        if both and b is not a:
            yield kernel(a, b, None if d2 is None else np.sqrt(d2, out=d2))
        elif b is a:
            if d2 is not None:
                np.fill_diagonal(d2, 0.0)
            yield kernel(a, a, None if d2 is None else np.sqrt(d2, out=d2))
        else:
            d = None if d2 is None else np.sqrt(d2, out=d2)
            yield kernel(a, b, d)
            yield kernel(b, a, None if d is None else d.T)

    def pairs(super_block, tiles):
        sa, sb = super_block
        for t in sorted(tiles):
            for u in sorted(tiles):
                if t <= u and {t // side, u // side} == {sa, sb}:
                    yield t, u

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)

    def super_block_out(found):
        held, size = [], 0
        for out in found:
            if out is None:
                continue
            if combine is None:
                yield batch(out)
                continue
            held.append(out)
            size += len(out[names[0]])
            if size > HELD_ROWS:
                held = [combine({n: np.concatenate([h[n] for h in held]) for n in names})]
                size = len(held[0][names[0]])
        if held:
            yield batch(combine({n: np.concatenate([h[n] for h in held]) for n in names}))

    def run(batches):
        current, tiles, values, squares, at = None, {}, {}, {}, 0
        room = np.empty(0)  # no kernel keeps the distances it is given

        def add_squares():
            for t, u in pairs(current, values):
                part = _block_squares(values[t], values[u])
                squares[t, u] = squares[t, u] + part if (t, u) in squares else part

        def finish():
            def found():
                nonlocal room
                for t, u in pairs(current, tiles):
                    d2 = None
                    if need_distance and blocks > 1:
                        d2 = squares.pop((t, u))
                    elif need_distance:
                        if len(room) < len(values[t]) * len(values[u]):
                            room = np.empty(len(values[t]) * len(values[u]))
                        d2 = _block_squares(values[t], values[u], room)
                    yield from outputs(tiles[t], tiles[u], d2)
            if need_distance and blocks > 1:
                add_squares()
            yield from super_block_out(found())

        for b in batches:
            cols = {c: b.column(c) for c in b.schema.names}
            sa, sb, ts, fb = (cols[c].to_pylist() for c in ("sa", "sb", "t", "fb"))
            for r in range(b.num_rows):
                if (sa[r], sb[r]) != current:
                    if current is not None:
                        yield from finish()
                    current, tiles, values, squares, at = (sa[r], sb[r]), {}, {}, {}, 0
                elif fb[r] != at:
                    add_squares()
                    values, at = {}, fb[r]
                rows = cols["rows"][r].values
                if need_distance:
                    values[ts[r]] = _column(rows.field("v"))
                if fb[r] == 0:
                    tiles[ts[r]] = Tile(_column(rows.field("row_id")),
                                        {p: _column(rows.field(p)) for p in payload})
        if current is not None:
            yield from finish()
    return run


def least_per(keys: tuple[str, ...], order: tuple[str, ...], k: int = 1) -> Callable:
    """A combine step that keeps the k least rows, in ``order``, of every key."""
    def combine(out: dict) -> dict:
        place = np.lexsort([out[c] for c in (*order[::-1], *keys[::-1])])
        new = np.ones(len(place), dtype=bool)
        if len(place):
            new[1:] = False
            for c in keys:
                values = out[c][place]
                new[1:] |= values[1:] != values[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
        kept = place[np.arange(len(place)) - start < k]
        return {n: v[kept] for n, v in out.items()}
    return combine


def sum_per(key: str) -> Callable:
    """A combine step that adds up the rows of every key."""
    def combine(out: dict) -> dict:
        kinds, at = np.unique(out[key], return_inverse=True)
        return {c: kinds if c == key else np.bincount(at, v, len(kinds)).astype(v.dtype) for c, v in out.items()}
    return combine


def two_sided(a: Tile, b: Tile, down: dict, across: dict) -> dict:
    """The output of a kernel of both orders: a's rows, and b's unless they are the same."""
    sides = [{"row_id": a.ids, **down}] + ([] if b is a else [{"row_id": b.ids, **across}])
    return {c: np.concatenate([s[c] for s in sides]) for c in sides[0]}


def _arrow(schema: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(),
             "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, types[t]) for n, t in (p.split() for p in schema.split(", "))])


def shape_of(x: DataFrame) -> tuple[int, int]:
    """Rows and width of packed features."""
    row = x.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("p")).first()
    return row["n"], row["p"] or 0


def tile_count(n: int, slots: int, tile_rows: int) -> int:
    """Enough tiles to occupy the cluster, and as many as the size bound needs."""
    wanted = int(np.ceil(np.sqrt(2.0 * slots)))
    return max(1, min(max(wanted, -(-n // tile_rows)), -(-n // 32)))


def side_of(tiles: int, slots: int, most: int = SIDE) -> int:
    """Tiles along one side of a super-block: as many as leave every slot work, and more
    (at most ``most``) as long as every slot has eight super-blocks, since what is
    shuffled grows with the number of sides."""
    return max(1, min(SIDE, tiles // int(np.ceil(np.sqrt(2.0 * slots)))),
               min(most, tiles // int(np.ceil(np.sqrt(16.0 * slots)))))


def scheduled(x: DataFrame, payload: tuple[str, ...], p: int, tiles: int, side: int, need_distance: bool,
              feature_block: int = FEATURE_BLOCK, together: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """``(sa, sb, t, fb, rows)``: every tile once for each super-block it is in,
    that is tiles / side times. Rows equal in ``together`` share a tile and stand
    side by side in it."""
    rows = x.select("row_id", *payload, *(["v"] if need_distance else []),
                    F.pmod(F.xxhash64(*together), F.lit(tiles)).cast("int").alias("t"))
    fields = [*together, *(c for c in ("row_id", *payload) if c not in together)]
    if need_distance and p > feature_block:
        blocks = -(-p // feature_block)
        rows = rows.withColumn("fb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        rows = rows.withColumn("v", F.slice("v", F.col("fb") * feature_block + 1,
                                            F.lit(feature_block)))
    else:
        rows = rows.withColumn("fb", F.lit(0))
    # the same row order in every block of a tile: blocks of one tile add up cell by cell
    entry = F.struct(*fields, *(["v"] if need_distance else []))
    packed = rows.groupBy("t", "fb").agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    own = F.floor(F.col("t") / side).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit((tiles - 1) // side)))
    return packed.withColumn("_u", other).select(
        F.least(own, "_u").alias("sa"), F.greatest(own, "_u").alias("sb"), "t", "fb", "rows")


def pair_reduce(x: DataFrame, kernel: Callable, schema: str, payload: tuple[str, ...] = (),
                size: tuple[int, int] | None = None, need_distance: bool = True,
                tile_rows: int = TILE_ROWS, feature_block: int = FEATURE_BLOCK,
                combine: Callable | None = None, side: int | None = None, both: bool = False,
                together: tuple[str, ...] = ("row_id",), kept: int = 1) -> DataFrame:
    """Apply ``kernel(a, b, d)`` to every ordered pair of tiles.

    ``x(row_id, v, *payload)`` has unique ids. ``d`` holds Euclidean distances
    of a's rows (down) and b's rows (across); a tile meets itself once. The
    kernel returns a dict of columns of ``schema`` or None; one of ``both`` orders
    is called once for an unordered pair. Rows equal in ``together`` are kept in one tile. A task takes whole
    super-blocks of ``side`` x ``side`` tile pairs, so a tile is shuffled
    tiles / side times, and ``combine`` reduces the output of each, to about ``kept``
    rows a row.
    """
    spark = x.sparkSession
    n, p = size if size is not None else shape_of(x)
    slots = spark.sparkContext.defaultParallelism
    # fewer rows per tile where a row's block is wide, so that a tile stays near 8 MB
    width = min(max(p, 1), feature_block)
    tile_rows = max(16, min(tile_rows, (1 << 20) // width))
    tiles = tile_count(n, slots, tile_rows)
    blocks = -(-p // feature_block) if need_distance and p > feature_block else 1
    a_tile = max(1, -(-n // tiles))
    # distance blocks of several feature blocks are all held
    side = side or side_of(tiles, slots, SIDE if blocks > 1 else min(
        LONG_SIDE, SIDE_BYTES // (8 * a_tile * (width if need_distance else 1)), HELD_ROWS // (2 * a_tile * kept)))
    work = scheduled(x, payload, p, tiles, side, need_distance, feature_block, together)
    supers = -(-tiles // side)
    units = supers * (supers + 1) // 2
    parts = min(units, max(12 * slots, units // 8))
    # dealt out one by one: hashed, one task in a few would get twice its share
    unit = F.pmod(F.shiftright(F.col("sb") * (F.col("sb") + 1), 1) + F.col("sa"), F.lit(parts))
    work = work.repartitionById(parts, unit.cast("int")).sortWithinPartitions("sa", "sb", "fb", "t")
    run = _runner(kernel, list(payload), _arrow(schema), need_distance, blocks, side, combine, both)
    return work.mapInArrow(run, schema.replace("long", "bigint"))


# ---- reductions built on it --------------------------------------------------

def _all_pairs(a, b, d):
    i, j = np.nonzero(a.ids[:, None] < b.ids[None, :])
    return {"a": a.ids[i], "b": b.ids[j], "d": d[i, j]}


def row_pairs(x: DataFrame) -> DataFrame:
    """``rowpairs(a, b, d)``, a < b: for callers that want the distances themselves."""
    return pair_reduce(x.select("row_id", "v"), _all_pairs, "a long, b long, d double")


def least_cells(a: Tile, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of ``w`` (a's rows down) that may be among the k least of their row, ties
    with the k-th included, as far as the super-block has been seen. Infinite and
    undefined cells are none."""
    first = a.best is None
    if first:
        a.best = np.full((len(w), k), np.inf)
        least = w if w.shape[1] <= k else (
            np.fmin.reduce(w, 1, keepdims=True) if k == 1 else np.partition(w, k - 1, axis=1)[:, :k])
        a.best[:, :least.shape[1]] = np.where(np.isnan(least), np.inf, least)
    i, j = cells(w <= a.best.max(1)[:, None])
    values = w[i, j]
    finite = np.isfinite(values)
    i, j, values = i[finite], j[finite], values[finite]
    if len(i) and not first:
        # the found values of a row stand side by side behind its k least ones
        count = np.bincount(i, minlength=len(a.best))
        rows = np.flatnonzero(count)
        count = count[rows]
        found = np.full((len(rows), int(count.max())), np.inf)
        place = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        found[np.repeat(np.arange(len(rows)), count), place] = values[np.argsort(i, kind="stable")]
        a.best[rows] = np.partition(np.concatenate([a.best[rows], found], 1), k - 1, axis=1)[:, :k]
    return i, j


def cells(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the set cells, read in the order of memory; far quicker than ``np.nonzero``."""
    if not mask.flags.c_contiguous and mask.flags.f_contiguous:
        j, i = cells(mask.T)
        return i, j
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _nearest_kernel(k: int, include_self: bool):
    def kernel(a, b, d):
        if b is a and not include_self:
            d[a.ids[:, None] == b.ids[None, :]] = np.inf
        if not d.shape[1]:
            return None
        i, j = least_cells(a, d, k)
        out = {"a": a.ids[i], "b": b.ids[j], "d": d[i, j]}
        # ties are settled by row id, here only where they are many
        return out if len(i) <= 4 * k * len(a.ids) else cut(out)
    cut = least_per(("a",), ("d", "b"), k)
    return kernel


def nearest(x: DataFrame, k: int, include_self: bool = False,
            size: tuple[int, int] | None = None) -> DataFrame:
    """The k nearest rows of each row, ``(a, b, d, rank)``, rank from 1."""
    found = pair_reduce(x.select("row_id", "v"), _nearest_kernel(k, include_self),
                        "a long, b long, d double", size=size,
                        combine=least_per(("a",), ("d", "b"), k), kept=k)
    # each super-block kept k rows per row; the bounded rank prunes before the sort
    rank = F.row_number().over(W.partitionBy("a").orderBy("d", "b"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def core_distances(x: DataFrame, min_samples: int,
                   size: tuple[int, int] | None = None) -> DataFrame:
    """Distance to the ``min_samples``-th neighbour, the row itself being the first."""
    return (nearest(x, min_samples, include_self=True, size=size)
            .filter(F.col("rank") == min_samples)
            .select(F.col("a").alias("row_id"), F.col("d").alias("core")))
