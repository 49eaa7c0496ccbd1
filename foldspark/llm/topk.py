"""Exact top-k search by inner product with a pivot-distance index.

Vectors are lengthened by one component that gives them all the same norm, and
queries by a zero; the largest inner products are then the smallest distances.
A vector's key is its nearest pivot and its distance from it. The distances of
a pivot are cut at quantiles into annuli, so that a cell (pivot, annulus) holds
about ``BLOCK`` vectors; fuller cells, such as those of a vector that occurs
very often, are split into blocks by hash.

A query orders the cells by the least distance that the triangle inequality
allows and first looks into one block each of the nearest cells, until it has
seen ``FIRST_LOOK`` vectors. Its k-th score there bounds the distance that
matters, and it then visits just the blocks of cells that may hold a score as
high. Up to ``GROUP`` neighbouring blocks and a batch of queries meet in a join,
each vector as its narrowest integers; only scores that reach the bound leave a
block, so no task or driver holds more than a group, a batch of queries and the
cell directory. Visits grow with queries times groups and the planner can't see
that, so the join is told not to broadcast them.

Pivots are fitted on a bounded sample (``FIT_ROWS`` vectors of lowest hash);
every vector is indexed. The directory has at most ``MOST_PIVOTS`` times
``MOST_RINGS`` entries.

Rows: vectors that are null or hold a null or non-finite component take no
part, nor do null ids. Shorter vectors count as ending in zeros. A query's
candidates are all rows with another id; repeated candidates count each, while
queries with the same id count once. An empty table, or one without queries,
gives no rows. Columns besides id and vector are not read."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.session import cut

BLOCK = 512
QUERIES = 1024
GROUP, GROUP_BYTES = 8, 1 << 22
FIRST_LOOK = 1024
FIT_ROWS = 4096
MOST_PIVOTS, MOST_RINGS = 256, 256
# Distances are compared with this relative margin, far above rounding.
_MARGIN = 1e-9


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, v)`` with ``floor(scale * x)`` for each component."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (table.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(x, lambda c: F.floor(scale * c).cast("long")).alias("v")))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array, padded with zeros to ``width``."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(lists), width), dtype=np.int64)
    at = np.arange(width)[None, :] < sizes[:, None]
    out[at] = values[offsets[0]:offsets[-1]]
    return out


def _narrowest(low: int, high: int) -> str:
    """The narrowest integers that hold ``low`` to ``high``."""
    return next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)


def _packed(rows: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    data = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (data.itemsize * data.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _multipliable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as float64 where that gives exact products of all their rows, else as int64."""
    most = [max(-int(m.min(initial=0)), int(m.max(initial=0))) for m in (a, b)]
    kind = np.float64 if most[0] * most[1] * max(a.shape[1], 1) < 1 << 53 else np.int64
    return a.astype(kind), b.astype(kind)


def _lengthened(v: np.ndarray, norm2: float) -> np.ndarray:
    v = v.astype(np.float64)
    rest = np.sqrt(np.maximum(norm2 - (v * v).sum(axis=1), 0.0))
    return np.hstack([v, rest[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def choose_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Centres of the sample: farthest points first, then a few mean steps."""
    pivots = [x[0]]
    near = ((x - x[0]) ** 2).sum(axis=1)
    for _ in range(1, min(count, len(x))):
        pivots.append(x[int(near.argmax())])
        near = np.minimum(near, ((x - pivots[-1]) ** 2).sum(axis=1))
    pivots = np.array(pivots)
    for _ in range(5):
        own = _distances(x, pivots).argmin(axis=1)
        for k in range(len(pivots)):
            if (own == k).any():
                pivots[k] = x[own == k].mean(axis=0)
    return pivots


class Directory:
    """The cells with their distance ranges and block numbers, and the pivots."""

    def __init__(self, pivots: np.ndarray, cells: list[tuple[int, int, float, float, int]]):
        self.pivots = pivots
        self.keys = [(p, r) for p, r, *_ in cells]
        self.pivot = np.array([c[0] for c in cells], dtype=np.int64)
        self.low, self.high = (np.array([c[k] for c in cells]) for k in (2, 3))
        self.count = np.array([c[4] for c in cells], dtype=np.int64)
        self.blocks = -(-self.count // BLOCK)
        # blocks are numbered through, so that neighbours share a group
        self.start = np.cumsum(self.blocks) - self.blocks

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Least possible distance of each query to each cell."""
        x = np.hstack([queries.astype(np.float64), np.zeros((len(queries), 1))])
        d = _distances(x, self.pivots)[:, self.pivot]
        return np.maximum(0.0, np.maximum(d - self.high, self.low - d))

    def first(self, bounds: np.ndarray) -> np.ndarray:
        """Cells whose first block a query looks into: the nearest ones, until
        they hold ``FIRST_LOOK`` vectors."""
        order = np.argsort(bounds, axis=1, kind="stable")
        seen = np.minimum(self.count, BLOCK)[order].cumsum(axis=1)
        need = np.ones_like(order, dtype=bool)
        need[:, 1:] = seen[:, :-1] < FIRST_LOOK
        out = np.zeros_like(need)
        np.put_along_axis(out, order, need, axis=1)
        return out


def _assign(batches, pivots: np.ndarray, norm2: float, width: int, kind: str):
    for b in batches:
        rows = _matrix(b.column("v"), width)
        d = _distances(_lengthened(rows, norm2), pivots)
        own = d.argmin(axis=1)
        yield pa.record_batch([b.column("id"), _packed(rows.astype(kind)), pa.array(own, pa.int32()),
                               pa.array(d[np.arange(len(own)), own], pa.float64())],
                              names=["id", "v", "pivot", "d"])


_VISITS = "team long, query_ids array<long>, queries binary, least array<long>, masks array<long>"


def _visits(batches, directory: Directory, norm2: float, width: int, kind: str, group: int, again: bool):
    """For each group of blocks that some of a batch's queries visit, those queries
    with the least score that matters to them and a mask of the blocks they visit."""
    first_block = directory.start
    last_block = directory.start + directory.blocks - 1
    teams = int(last_block[-1]) // group + 1
    for b in batches:
        for k in range(b.num_rows):
            ids = b.column("query_ids")[k].values.to_numpy(zero_copy_only=False)
            queries = b.column("queries")[k].values.to_numpy(zero_copy_only=False).reshape(len(ids), width)
            least = b.column("least")[k].values.to_numpy(zero_copy_only=False)
            bounds = directory.bounds(queries)
            if again:
                squares = (queries.astype(np.float64) ** 2).sum(axis=1)
                reach = np.maximum(squares + norm2 - 2.0 * least.astype(np.float64), 0.0)
                reach = np.sqrt(reach * (1 + _MARGIN)) + _MARGIN * math.sqrt(norm2 + 1)
                visited = bounds <= reach[:, None]
            else:
                visited = directory.first(bounds)
            queries, rows = queries.astype(kind), []
            for team in range(teams):
                low, high = team * group, team * group + group - 1
                masks = np.zeros(len(ids), dtype=np.int64)
                for c in range(int(np.searchsorted(last_block, low)), len(first_block)):
                    if first_block[c] > high:
                        break
                    ends = (first_block[c], last_block[c] if again else first_block[c])
                    blocks = sum(1 << at - low for at in range(max(ends[0], low), min(ends[1], high) + 1))
                    masks[visited[:, c]] |= blocks
                at = masks != 0
                if at.any():
                    rows.append((team, ids[at], queries[at].tobytes(), least[at], masks[at]))
                if len(rows) >= 16:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                           names=["team", "query_ids", "queries", "least", "masks"])


_HITS = "query_id long, vec_id long, score long"


def _best(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the k highest scores of each row that reach its least one, ties to the
    column further left."""
    fit = scores >= least[:, None]
    many = np.flatnonzero(np.count_nonzero(fit, axis=1) > k)
    if len(many):
        kth = np.partition(scores[many], scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        fit[many] &= scores[many] >= kth[:, None]
    i, j = np.divmod(np.flatnonzero(fit), scores.shape[1])
    order = np.lexsort((j, -scores[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


def _hits(batches, width: int, kind: str, group: int, k: int):
    """The k best scores of each query in a block, as far as they matter."""
    for b in batches:
        for row in range(b.num_rows):
            entries = b.column("entries")[row].values
            block, ids = (entries.field(c).to_numpy(zero_copy_only=False) for c in ("block", "id"))
            query_ids, least, masks = (b.column(c)[row].values.to_numpy(zero_copy_only=False)
                                       for c in ("query_ids", "least", "masks"))
            queries = np.frombuffer(b.column("queries")[row].as_py(), dtype=kind).reshape(-1, width)
            queries, vectors = _multipliable(queries, _unpacked(entries.field("v"), kind, width))
            # a row's own id never counts
            never = -np.inf if vectors.dtype == np.float64 else np.iinfo(np.int64).min
            order = np.lexsort((ids, block))
            ends = np.append(np.flatnonzero(np.diff(block[order], prepend=-1)), len(order))
            out = []
            for start, end in zip(ends[:-1], ends[1:], strict=True):
                own = order[start:end]
                at = np.flatnonzero(masks >> (block[own[0]] % group) & 1)
                if not len(at):
                    continue
                scores = queries[at] @ vectors[own].T
                # ids stand in order
                left, right = (np.searchsorted(ids[own], query_ids[at], side) for side in ("left", "right"))
                for q in np.flatnonzero(left < right):
                    scores[q, left[q]:right[q]] = never
                i, j = _best(scores, least[at], k)
                out.append((query_ids[at[i]], ids[own[j]], scores[i, j].astype(np.int64)))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, dtype=np.int64)] * 3
            yield pa.record_batch([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest inner products of each
    query among ``vectors(id, v)``, ties to the smaller id."""
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vectors = cut(vectors)
    square = F.aggregate(F.transform("v", lambda c: c.cast("double")), F.lit(0.0), lambda a, c: a + c * c)
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"),
                        F.max(square).alias("norm2"), F.min(F.array_min("v")).alias("low"),
                        F.max(F.array_max("v")).alias("high"),
                        F.count(F.when(is_query, 1)).alias("queries")).first()
    n, width, norm2 = facts["n"], max(facts["width"] or 0, 1), facts["norm2"]
    if not facts["queries"]:
        return none
    kind = _narrowest(min(facts["low"] or 0, 0), max(facts["high"] or 0, 0))
    group = max(1, min(GROUP, GROUP_BYTES // (BLOCK * width * np.dtype(kind).itemsize)))
    per_side = math.ceil(math.sqrt(n / BLOCK))
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toArrow().column("v").combine_chunks()
    pivots = choose_pivots(_lengthened(_matrix(sample, width), norm2), min(MOST_PIVOTS, per_side))

    keyed = cut(vectors.mapInArrow(lambda b: _assign(b, pivots, norm2, width, kind),
                                   "id long, v binary, pivot int, d double"))
    rings = min(MOST_RINGS, max(1, math.ceil(n / BLOCK / len(pivots))))
    at = F.array(*(F.lit(q / rings) for q in range(1, rings))).cast("array<double>")
    # One row per pivot, and below one per cell: both have documented bounds.
    edges = cut(keyed.groupBy("pivot").agg(F.array_distinct(F.percentile_approx("d", at, F.lit(1000))).alias("edges")
                                           if rings > 1 else F.array().cast("array<double>").alias("edges")))
    celled = keyed.join(F.broadcast(edges), "pivot").withColumn(
        "ring", F.size(F.filter("edges", lambda e: e < F.col("d")))).drop("edges")
    directory = Directory(pivots, [tuple(r) for r in celled.groupBy("pivot", "ring").agg(
        F.min("d"), F.max("d"), F.count(F.lit(1))).orderBy("pivot", "ring").collect()])
    sizes = spark.createDataFrame([(*c, b, at) for c, b, at in zip(
        directory.keys, directory.blocks.tolist(), directory.start.tolist(), strict=True)],
        "pivot int, ring int, blocks long, start long")
    blocks = cut(celled.join(F.broadcast(sizes), ["pivot", "ring"])
                 .withColumn("block", F.col("start") + F.pmod(F.xxhash64("id", "v"), F.col("blocks")))
                 .groupBy(F.floor(F.col("block") / group).alias("team"))
                 .agg(F.collect_list(F.struct("block", "id", "v")).alias("entries")))

    padded = F.slice(F.concat("v", F.array_repeat(F.lit(0).cast("long"), width)), 1, width)
    asked = vectors.filter(is_query).groupBy("id").agg(F.min(padded).alias("v"))
    batches = math.ceil(facts["queries"] / QUERIES)
    lowest = -(1 << 62)

    def visit(queries: DataFrame, again: bool) -> DataFrame:
        packed = queries.groupBy(F.pmod(F.xxhash64("id"), F.lit(batches)).alias("batch")).agg(
            F.collect_list("id").alias("query_ids"), F.flatten(F.collect_list("v")).alias("queries"),
            F.collect_list("least").alias("least"))
        visits = packed.select("query_ids", "queries", "least").mapInArrow(
            lambda b: _visits(b, directory, norm2, width, kind, group, again), _VISITS)
        met = visits.join(blocks.hint("merge"), "team").select("entries", "query_ids", "queries", "least", "masks")
        return met.mapInArrow(lambda b: _hits(b, width, kind, group, k), _HITS)

    first = cut(_ranked(visit(asked.withColumn("least", F.lit(lowest)), False), k))
    bound = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("found"))
    bounded = asked.join(bound, "id", "left").select("id", "v", F.coalesce("found", F.lit(lowest)).alias("least"))
    return _ranked(visit(bounded, True), k).select("query_id", "rank", "vec_id", "score")
