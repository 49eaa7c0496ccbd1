"""Agglomerative clustering by rounds of mutually nearest clusters.

The methods are reducible, so every mutual pair of a round may merge at once and
the result equals the one-at-a-time procedure. Ward keeps centroids only and
single linkage reads its hierarchy off the spanning tree, both linear in the
rows. Complete, average and weighted keep each row's cluster: a round computes all
row distances again, folds them by cluster inside the kernel and gives out each
cluster's nearest. Only when the pairs of clusters are few beside the rows do they
become a table, hashed by pair so that no task holds a cluster's whole column.
When few clusters remain the rounds end in one bounded step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators.graph import components
from foldspark.operators.pairwise import Tile, cells, least_cells, least_per, pair_reduce, row_pairs, shape_of
from foldspark.operators.shape import dense_index
from foldspark.operators.spanning import spanning_tree
from foldspark.session import Rounds

METHODS = ("single", "complete", "average", "weighted", "ward")
# At most this many clusters (a 256 x 256 matrix) are merged in one step.
FINISH_BELOW = 256
# Pairs of clusters become a table when there are at most this many for each row, or so few that the rows don't matter.
TABLE_PAIRS, SMALL_TABLE = 32, 1 << 19
# A cluster of more rows is spread over tiles in pieces of about this size.
PIECE_ROWS = 512
# At most this many tree edges form one block of the single-linkage hierarchy.
TREE_BLOCK = 1 << 16
# A merge event: node and child nodes, lowest row of each child, height, size.
_EVENT = "node long, left long, right long, a long, b long, height double, size long"
_SIDES = ("n", "node")


def _mutual(near: DataFrame, rows: int, turn: int) -> DataFrame:
    """Merge events of clusters that are each other's nearest.

    ``near(id, near, d, n, node, near_n, near_node)`` has one row per cluster.
    A merge's node number lies above all row numbers and rises by round.
    """
    other = near.select(F.col("id").alias("near"), F.col("near").alias("id"))
    pairs = near.join(other, ["id", "near"]).filter(F.col("id") < F.col("near"))
    return pairs.select(
        (F.lit(rows).cast("long") * F.lit(turn + 1) + F.col("id")).alias("node"),
        F.col("node").alias("left"), F.col("near_node").alias("right"),
        F.col("id").alias("a"), F.col("near").alias("b"), F.col("d").alias("height"),
        (F.col("n") + F.col("near_n")).alias("size"), F.col("n").alias("na"),
        F.col("near_n").alias("nb"))


def _combine(method: str, d: np.ndarray, i: int, j: int, n: np.ndarray) -> np.ndarray:
    """Distances of the union of clusters i and j to all others."""
    if method == "single":
        return np.minimum(d[i], d[j])
    if method == "complete":
        return np.maximum(d[i], d[j])
    if method == "average":
        return (n[i] * d[i] + n[j] * d[j]) / (n[i] + n[j])
    if method == "weighted":
        return (d[i] + d[j]) / 2
    t = n[i] + n[j] + n
    return np.sqrt(np.maximum(
        ((n[i] + n) * d[i] ** 2 + (n[j] + n) * d[j] ** 2 - n * d[i, j] ** 2) / t, 0.0))


def _last_merges(method: str, start: int):
    """Merge a bounded number of clusters down to one (dense matrix, greedy)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = pdf
        facts = pd.concat([pdf[["a", "na", "node_a"]].set_axis(["id", "n", "node"], axis=1),
                           pdf[["b", "nb", "node_b"]].set_axis(["id", "n", "node"], axis=1)])
        facts = facts.drop_duplicates("id").sort_values("id")
        ids, node, n = (facts[c].to_numpy().copy() for c in ("id", "node", "n"))
        at = {c: k for k, c in enumerate(ids)}
        d = np.full((len(ids), len(ids)), np.inf)
        i, j = pairs.a.map(at).to_numpy(), pairs.b.map(at).to_numpy()
        d[i, j] = d[j, i] = pairs.d.to_numpy()
        live, out = np.ones(len(ids), dtype=bool), []
        n = n.astype(float)
        for turn in range(len(ids) - 1):
            i, j = divmod(int(np.argmin(d)), len(ids))
            i, j = min(i, j), max(i, j)
            if not np.isfinite(d[i, j]):
                break
            height = d[i, j]
            out.append((start + turn, node[i], node[j], ids[i], ids[j], height, int(n[i] + n[j])))
            row = _combine(method, d, i, j, n)
            row[~live] = np.inf
            row[[i, j]] = np.inf
            d[i], d[:, i] = row, row
            d[j], d[:, j] = np.inf, np.inf
            live[j] = False
            n[i] += n[j]
            node[i] = start + turn
        return pd.DataFrame(out, columns=["node", "left", "right", "a", "b", "height", "size"])
    return run


def _finish(pairs: DataFrame, method: str, start: int) -> DataFrame:
    """Bounded last step: at most FINISH_BELOW clusters, given by their pairs."""
    return (pairs.groupBy(F.lit(0).alias("_one"))
            .applyInPandas(_last_merges(method, start), _EVENT))


def _moves(merged: DataFrame, method: str) -> DataFrame:
    """What every merged cluster becomes and the share it brings to the union."""
    moves = merged.select(F.explode(F.array(*[
        F.struct(F.col(c).alias("id"), F.col("a").alias("to"), F.col(f"n{c}").alias("n"),
                 "size", "node") for c in "ab"])).alias("_e")).select("_e.*")
    share = {"average": F.col("n") / F.col("size"), "weighted": F.lit(0.5)}.get(method, F.lit(1.0))
    return moves.select("id", "to", "size", "node", share.alias("w"))


def _table_rounds(pairs: DataFrame, method: str, rows: int, finish_below: int, kept: Rounds, turn: int,
                  left: int) -> list[DataFrame]:
    """``pairs(a, b, d, na, nb, node_a, node_b)`` holds the distance of every two of
    ``left`` clusters; sizes and node numbers travel with it, so a round is one
    aggregate, one join of mutual pairs and one regrouping."""
    events = []
    while left > max(1, finish_below):
        pairs = kept.keep("pairs", pairs)
        ends = pairs.select(F.explode(F.array(*[
            F.struct(F.col(p).alias("id"), "d", F.col("a").alias("lo"), F.col("b").alias("hi"),
                     F.col(q).alias("near"), F.col(f"n{p}").alias("n"), F.col(f"node_{p}").alias("node"),
                     F.col(f"n{q}").alias("near_n"), F.col(f"node_{q}").alias("near_node"))
            for p, q in (("a", "b"), ("b", "a"))])).alias("_e")).select("_e.*")
        rest = [c for c in ends.columns if c not in ("id", "d", "lo", "hi")]
        near = (ends.groupBy("id").agg(F.min(F.struct("d", "lo", "hi", *rest)).alias("_m"))
                .select("id", "_m.d", *[f"_m.{c}" for c in rest]))
        merged = kept.keep(f"merged{turn}", _mutual(near, rows, turn))
        count = merged.count()
        events.append(merged.drop("na", "nb"))
        moves = _moves(merged, method)
        for c in "ab":
            m = moves.select(F.col("id").alias(c), *[F.col(k).alias(f"_{k}") for k in
                                                     ("to", "size", "node", "w")])
            pairs = pairs.join(m, c, "left").select(
                *[k for k in pairs.columns if k not in (c, f"n{c}", f"node_{c}")],
                F.coalesce("_to", c).alias(c), F.coalesce("_size", f"n{c}").alias(f"n{c}"),
                F.coalesce("_node", f"node_{c}").alias(f"node_{c}"),
                F.coalesce("_w", F.lit(1.0)).alias(f"_w{c}"))
        swap = F.col("a") > F.col("b")

        def side(first, second):
            return F.when(swap, F.col(second)).otherwise(F.col(first))
        merge = F.max("d") if method == "complete" else F.sum(F.col("d") * F.col("_wa") * F.col("_wb"))
        pairs = (pairs.filter(F.col("a") != F.col("b"))
                 .groupBy(*[side(f"{k}{p}", f"{k}{q}").alias(f"{k}{p}")
                            for k in ("", "n", "node_") for p, q in (("a", "b"), ("b", "a"))])
                 .agg(merge.alias("d")))
        left -= count
        turn += 1
    if left > 1:
        events.append(_finish(pairs, method, rows * (turn + 1)))
    return events


def _tree_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges of one block of tree edges in step order (union by lowest vertex)."""
    pdf = pdf.sort_values("step")
    root: dict[int, int] = {}
    facts: dict[int, tuple[int, int, int]] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            root[c] = root.get(root[c], root[c])
            c = root[c]
        return c
    out = []
    for r in pdf.itertuples(index=False):
        facts.setdefault(r.a, (r.a, r.na, r.node_a))
        facts.setdefault(r.b, (r.b, r.nb, r.node_b))
        p, q = sorted((find(r.a), find(r.b)))
        (_, np_, left), (_, nq, right) = facts[p], facts[q]
        node = r.rows + r.step
        root[q] = p
        facts[p] = (p, np_ + nq, node)
        out.append((node, left, right, p, q, r.d, np_ + nq))
    return pd.DataFrame(out, columns=["node", "left", "right", "a", "b", "height", "size"])


def _tree_merges(tree: DataFrame, rows: int, block: int, kept: Rounds) -> DataFrame:
    """Single-linkage merges of a spanning tree.

    The edges in height order are halved level by level: the upper half sees the
    components of the lower half as its vertices, so both halves are independent
    and a level handles all of them with one components call. Blocks of at most
    ``block`` edges are then merged in parallel.
    """
    one = F.lit(1).cast("long")
    edges = dense_index(tree, ["d", "a", "b"], "step").select(
        "step", "d", "a", "b", one.alias("na"), one.alias("nb"), F.col("a").alias("node_a"),
        F.col("b").alias("node_b"), F.lit(0).cast("long").alias("low"),
        F.lit(rows - 1).cast("long").alias("high"))
    span = rows - 1
    while span > block:
        edges = kept.keep(f"edges{span}", edges.withColumn("mid", F.shiftright(F.col("low") + F.col("high"), 1)))
        lower, upper = edges.filter("step < mid"), edges.filter("step >= mid")
        # vertices are rows, unique within a block; a block's own number keeps blocks apart
        name = F.col("low") * F.lit(rows).cast("long")
        comp = components(lower.select((name + F.col("a")).alias("a"), (name + F.col("b")).alias("b")))
        members = lower.select("low", F.explode(F.array(
            F.struct(F.col("a").alias("id"), F.col("na").alias("n"), "step"),
            F.struct(F.col("b").alias("id"), F.col("nb").alias("n"), "step"))).alias("_e")).select("low", "_e.*")
        members = (members.groupBy("low", "id").agg(F.max("n").alias("n"), F.max("step").alias("step"))
                   .join(comp.select((F.col("id") % rows).alias("id"),
                                     F.floor(F.col("id") / rows).alias("low"),
                                     (F.col("comp") % rows).alias("to")), ["low", "id"]))
        total = members.groupBy("low", "to").agg(F.sum("n").alias("_n"), F.max("step").alias("_last"))
        became = kept.keep(f"became{span}", members.select("low", "id", "to").join(total, ["low", "to"]))
        for c in "ab":
            m = became.withColumnRenamed("id", c)
            upper = upper.join(m, ["low", c], "left").select(
                *[k for k in upper.columns if k not in (c, f"n{c}", f"node_{c}")],
                F.coalesce("to", c).alias(c), F.coalesce("_n", f"n{c}").alias(f"n{c}"),
                F.coalesce(F.col("_last") + rows, F.col(f"node_{c}")).alias(f"node_{c}"))
        edges = (lower.withColumn("high", F.col("mid"))
                 .unionByName(upper.withColumn("low", F.col("mid"))).drop("mid"))
        span = -(-span // 2)
    return (edges.withColumn("rows", F.lit(rows).cast("long")).groupBy("low")
            .applyInPandas(_tree_block, _EVENT))


def _ward_cost(a, b, d):
    if not d.flags.c_contiguous:
        return _ward_cost(b, a, d.T).T
    # few sizes occur, so the scales are a small table
    (na, ia), (nb, ib) = (np.unique(t.n, return_inverse=True) for t in (a, b))
    scale = np.sqrt(2.0 * na[:, None] * nb[None, :] / (na[:, None] + nb[None, :]))
    w = d * (scale if scale.size == 1 else scale[ia].take(ib, axis=1))
    if b is a:
        w[a.ids[:, None] == b.ids[None, :]] = np.inf
    return w


def _ward_near(a, b, d):
    """Nearest cluster of each cluster of a within b, ties by (lo, hi); none where an
    earlier tile pair had a nearer one."""
    return _closest(a, b, _ward_cost(a, b, d))


def _closest(a, b, w):
    i, j = least_cells(a, w, 1)
    if not len(i):
        return None
    lo, hi = np.minimum(a.ids[i], b.ids[j]), np.maximum(a.ids[i], b.ids[j])
    order = np.lexsort((hi, lo, w[i, j], i))
    first = np.ones(len(order), dtype=bool)
    first[1:] = i[order][1:] != i[order][:-1]
    at = order[first]
    i, j = i[at], j[at]
    return {"id": a.ids[i], "d": w[i, j], "lo": lo[at], "hi": hi[at], "near": b.ids[j],
            "n": a.n[i], "node": a.node[i], "near_n": b.n[j], "near_node": b.node[j]}


def _ward_pairs(a, b, d):
    i, j = np.nonzero(a.ids[:, None] < b.ids[None, :])
    return {"a": a.ids[i], "b": b.ids[j], "d": _ward_cost(a, b, d)[i, j], "na": a.n[i], "nb": b.n[j],
            "node_a": a.node[i], "node_b": b.node[j]}


def _ward_rounds(x: DataFrame, rows: int, width: int, finish_below: int, kept: Rounds) -> list[DataFrame]:
    """State is one centroid per cluster; the pairwise part never leaves the kernel."""
    state = x.select(F.col("row_id").cast("long").alias("row_id"), "v",
                     F.lit(1).cast("long").alias("n"), F.col("row_id").cast("long").alias("node"))
    rest = ["near", "n", "node", "near_n", "near_node"]
    schema = "id long, d double, lo long, hi long, " + ", ".join(f"{c} long" for c in rest)
    events, turn, left = [], 0, rows
    while left > max(1, finish_below):
        state = kept.keep("state", state)
        found = pair_reduce(state, _ward_near, schema, _SIDES, (left, width),
                            combine=least_per(("id",), ("d", "lo", "hi")))
        near = (found.groupBy("id").agg(F.min(F.struct("d", "lo", "hi", *rest)).alias("_m"))
                .select("id", "_m.d", *[f"_m.{c}" for c in rest]))
        merged = kept.keep(f"merged{turn}", _mutual(near, rows, turn))
        count = merged.count()
        events.append(merged.drop("na", "nb"))
        grown = (merged.join(state.select(F.col("row_id").alias("b"), F.col("v").alias("vb")), "b")
                 .select(F.col("a").alias("row_id"), "vb", "na", "nb", F.col("node").alias("_node")))
        share = F.col("nb") / (F.col("na") + F.col("nb"))
        moved = F.zip_with("v", "vb", lambda p, q: p + (q - p) * share)
        state = (state.join(merged.select(F.col("b").alias("row_id")), "row_id", "left_anti")
                 .join(grown, "row_id", "left")
                 .select("row_id", F.when(F.col("vb").isNull(), F.col("v")).otherwise(moved).alias("v"),
                         (F.col("n") + F.coalesce("nb", F.lit(0))).alias("n"),
                         F.coalesce("_node", "node").alias("node")))
        left -= count
        turn += 1
    if left > 1:
        pairs = pair_reduce(kept.keep("state", state), _ward_pairs, "a long, b long, d double, na long, nb long, "
                            "node_a long, node_b long", _SIDES, (left, width))
        events.append(_finish(pairs, "ward", rows * (turn + 1)))
    return events


def _folded(d: np.ndarray, starts: np.ndarray, fold: np.ufunc) -> np.ndarray:
    """Rows of ``d`` folded run by run; a run reaches from its start to the next one's."""
    sizes = np.diff(np.append(starts, len(d)))
    if len(starts) == len(d):
        return d
    out = d[starts]
    for k in range(1, min(int(sizes.max()), 32)):
        at = np.flatnonzero(sizes > k)
        out[at] = fold(out[at], d[starts[at] + k])
    for r in np.flatnonzero(sizes > 32):
        out[r] = fold(out[r], fold.reduce(d[starts[r] + 32:starts[r] + sizes[r]], 0))
    return out


def _clusters(tile: Tile, apart: bool) -> Tile:
    """The clusters (or their pieces) of a tile of rows, which stand side by side;
    ``apart`` keeps rows of one id from being folded."""
    if "clusters" not in tile.payload:
        new = np.ones(len(tile.ids), dtype=bool)
        if not apart:
            new[1:] = (tile.comp[1:] != tile.comp[:-1]) | (tile.part[1:] != tile.part[:-1])
        starts = np.flatnonzero(new)
        tile.payload["clusters"] = Tile(tile.comp[starts], {
            "starts": starts, "n": tile.n[starts], "node": tile.node[starts], "split": tile.part[starts] > 0})
    return tile.payload["clusters"]


def _between_clusters(method: str, every: bool, apart: bool):
    """Each cluster's nearest one in the other tile. Distances of clusters that lie in
    pieces are given out by pair, to be folded outside; with ``every`` all pairs are."""
    fold = np.maximum if method == "complete" else np.add

    def kernel(a, b, d):
        p, q = _clusters(a, apart), _clusters(b, apart)
        if method == "weighted" and not (a.w.min() == b.w.min() == 1.0):
            d = d * a.w[:, None] * b.w[None, :]
        w = _folded(d, p.starts, fold)
        if len(q.starts) < len(b.ids):
            w = _folded(np.ascontiguousarray(w.T), q.starts, fold).T
        outside, i, j = None, np.empty(0, dtype=int), np.empty(0, dtype=int)
        if every or p.split.any() or q.split.any():
            outside = np.ones_like(w, dtype=bool) if every else p.split[:, None] | q.split[None, :]
            if b is a:
                outside = np.triu(outside, 1)
            i, j = cells(outside & (p.ids[:, None] != q.ids[None, :]))
        swap = p.ids[i] > q.ids[j]
        lo, hi = np.where(swap, q.ids[j], p.ids[i]), np.where(swap, p.ids[i], q.ids[j])
        found = [{"id": lo, "d": w[i, j], "lo": lo, "hi": hi, "near": hi,
                  **{f"{k}{c}": np.where(swap ^ (k == "near_"), q.payload[c][j], p.payload[c][i])
                     for k in ("", "near_") for c in ("n", "node")}, "piece": np.ones(len(i), dtype=np.int32)}]
        if not every:
            if method == "average" and not (p.n.max() == q.n.max() == 1):
                w = w / (p.n[:, None] * q.n[None, :])
            w = w if outside is None else np.where(outside, np.inf, w)
            if b is a:
                w = np.triu(w, 1)
                w = w + w.T
                w[p.ids[:, None] == q.ids[None, :]] = np.inf
            near = [_closest(p, q, w), None if b is a else _closest(q, p, w.T)]
            found += [{**f, "piece": np.zeros(len(f["id"]), dtype=np.int32)} for f in near if f]
        return {c: np.concatenate([f[c] for f in found]) for c in found[0]}
    return kernel


def _folded_pieces(method: str):
    """A combine step: the nearest of each cluster, pieces folded by pair."""
    fold, nearest = np.maximum if method == "complete" else np.add, least_per(("id",), ("d", "lo", "hi"))

    def combine(out: dict) -> dict:
        piece = out["piece"] == 1
        whole = nearest({c: v[~piece] for c, v in out.items()})
        if not piece.any():
            return whole
        out = {c: v[piece] for c, v in out.items()}
        order = np.lexsort((out["near"], out["id"]))
        out = {c: v[order] for c, v in out.items()}
        new = np.ones(len(order), dtype=bool)
        new[1:] = (out["id"][1:] != out["id"][:-1]) | (out["near"][1:] != out["near"][:-1])
        starts = np.flatnonzero(new)
        d = fold.reduceat(out["d"], starts)
        return {c: np.concatenate([whole[c], d if c == "d" else v[starts]]) for c, v in out.items()}
    return combine


def _cluster_rounds(x: DataFrame, method: str, rows: int, width: int, most: int, kept: Rounds):
    """Rounds until at most ``most`` clusters are left: the events, the last state, its
    turn and the number of clusters. The state is each row's cluster; nothing of the
    order of rows x rows is stored or shuffled."""
    key = F.col("row_id").cast("long")
    one = F.lit(1).cast("long")
    state = x.select(key.alias("row_id"), "v", key.alias("comp"), one.alias("n"), key.alias("node"),
                     F.lit(1.0).alias("w"), F.lit(0).alias("part"))
    events, turn, left, largest = [], 0, rows, 1
    while left > most:
        state = kept.keep("state", state)
        found = _found(state, method, (rows, width), False, apart=not turn)
        if largest > PIECE_ROWS:
            found = kept.keep("found", found)
            pieces = _summed(found.filter("piece = 1"), method)
            found = found.filter("piece = 0").drop("piece").unionByName(pieces).unionByName(pieces.select(
                F.col("near").alias("id"), "d", "lo", "hi", F.col("id").alias("near"), F.col("near_n").alias("n"),
                F.col("near_node").alias("node"), F.col("n").alias("near_n"), F.col("node").alias("near_node")))
        near = (found.groupBy("id").agg(F.min(F.struct("d", "lo", "hi", *_FACTS)).alias("_m"))
                .select("id", "_m.d", *[f"_m.{c}" for c in _FACTS]))
        merged = kept.keep(f"merged{turn}", _mutual(near, rows, turn))
        count, top = merged.agg(F.count(F.lit(1)), F.max("size")).first()
        if not count:
            break  # only undefined distances are left: the table has an order for them
        events.append(merged.drop("na", "nb"))
        moves = _moves(merged, method).select(F.col("id").alias("comp"), "to", "size", F.col("node").alias("_node"),
                                              F.col("w").alias("_w"))
        n = F.coalesce("size", "n")
        pieces = F.ceil(n / PIECE_ROWS)
        state = state.join(moves, "comp", "left").select(
            "row_id", "v", F.coalesce("to", "comp").alias("comp"), n.alias("n"),
            F.coalesce("_node", "node").alias("node"), (F.col("w") * F.coalesce("_w", F.lit(1.0))).alias("w"),
            F.when(n > PIECE_ROWS, F.pmod(F.xxhash64("row_id"), pieces) + 1).otherwise(0).cast("int").alias("part"))
        left, largest, turn = left - count, max(largest, top), turn + 1
    return events, kept.keep("state", state), turn, left


_FACTS = ["near", "n", "node", "near_n", "near_node"]


def _found(state: DataFrame, method: str, size: tuple[int, int], every: bool,
           apart: bool = False) -> DataFrame:
    schema = "id long, d double, lo long, hi long, " + ", ".join(f"{c} long" for c in _FACTS) + ", piece int"
    return pair_reduce(state, _between_clusters(method, every, apart), schema, ("comp", "n", "node", "part", "w"), size,
                       combine=_folded_pieces(method), both=True, together=("comp", "part"))


def _summed(pieces: DataFrame, method: str) -> DataFrame:
    """Distances of pairs of clusters from those of their pieces."""
    d = F.max("d") if method == "complete" else F.sum("d")
    d = d / (F.col("n") * F.col("near_n")) if method == "average" else d
    return pieces.groupBy("id", "lo", "hi", *_FACTS).agg(d.alias("d"))


def _pair_events(x: DataFrame, method: str, rows: int, width: int, finish_below: int, kept: Rounds) -> list[DataFrame]:
    """Complete, average and weighted linkage."""
    most = max(finish_below, int((2.0 * max(TABLE_PAIRS * rows, SMALL_TABLE)) ** 0.5))
    if rows <= most:
        one = F.lit(1).cast("long")
        pairs = row_pairs(x).select("a", "b", "d", one.alias("na"), one.alias("nb"),
                                    F.col("a").alias("node_a"), F.col("b").alias("node_b"))
        return _table_rounds(pairs, method, rows, finish_below, kept, 0, rows)
    events, state, turn, left = _cluster_rounds(x, method, rows, width, most, kept)
    pairs = _summed(_found(state, method, (rows, width), True), method).select(
        F.col("id").alias("a"), F.col("near").alias("b"), "d", F.col("n").alias("na"), F.col("near_n").alias("nb"),
        F.col("node").alias("node_a"), F.col("near_node").alias("node_b"))
    return events + _table_rounds(pairs, method, rows, finish_below, kept, turn, left)


def merge_events(x: DataFrame, method: str = "average", finish_below: int = FINISH_BELOW) -> DataFrame:
    """Merges of ``x(row_id, v)`` numbered by height: ``step``, child nodes,
    lowest row of each child, ``height`` and ``size``. ``row_id`` is dense from 0."""
    if method not in METHODS:
        raise KeyError(f"unknown linkage {method!r}; available: {sorted(METHODS)}")
    rows, width = shape_of(x)
    if rows < 2:
        return x.sparkSession.createDataFrame([], "step long, " + _EVENT)
    kept = Rounds(x.sparkSession)
    if method == "single":
        events = [_tree_merges(spanning_tree(x), rows, TREE_BLOCK, kept)]
    elif method == "ward":
        events = _ward_rounds(x, rows, width, finish_below, kept)
    else:
        events = _pair_events(x, method, rows, width, finish_below, kept)
    out = events[0]
    for e in events[1:]:
        out = out.unionByName(e)
    return kept.result(dense_index(out, ["height", "node"], "step"))


def linkage_matrix(events: DataFrame, rows: int) -> DataFrame:
    """``merges(step, a, b, height, size)``: rows count 0..n-1, merge s is n + s."""
    number = events.select("node", (F.col("step") + F.lit(rows)).alias("_id"))
    left = number.select(F.col("node").alias("left"), F.col("_id").alias("_l"))
    right = number.select(F.col("node").alias("right"), F.col("_id").alias("_r"))
    ends = [F.coalesce("_l", "left"), F.coalesce("_r", "right")]
    return (events.join(left, "left", "left").join(right, "right", "left")
            .select("step", F.least(*ends).alias("a"), F.greatest(*ends).alias("b"), "height", "size"))


def linkage(x: DataFrame, method: str = "average", **options) -> DataFrame:
    return linkage_matrix(merge_events(x, method, **options), x.count())


def truncated(merges: DataFrame, p: int = 10) -> DataFrame:
    """The last p - 1 merges, which join the p clusters a truncated tree shows."""
    return merges.orderBy(F.desc("step")).limit(p - 1)


def canonical(assign: DataFrame, first: int = 0) -> DataFrame:
    """Clusters renumbered from ``first`` by their lowest row. The numbered table
    has one row per cluster."""
    lowest = assign.groupBy("cluster").agg(F.min("row_id").alias("_low"))
    named = dense_index(lowest, ["_low"], "_n")
    return (assign.join(named.select("cluster", "_n"), "cluster")
            .withColumn("cluster", (F.col("_n") + first).cast("int")).drop("_n"))


def cut_tree(x: DataFrame, events: DataFrame, n_clusters: int) -> DataFrame:
    """At most ``n_clusters`` flat clusters, numbered from 1; equal heights merge together."""
    rows = x.count()
    limit = events.filter(F.col("step") == rows - n_clusters - 1).agg(F.max("height").alias("h")).first()["h"]
    kept = events.filter(F.col("height") <= limit) if limit is not None else events.limit(0)
    comp = components(kept.select("a", "b"))
    assign = (x.select("row_id").join(comp.withColumnRenamed("id", "row_id"), "row_id", "left")
              .select("row_id", F.coalesce("comp", "row_id").alias("cluster")))
    return canonical(assign, first=1)


def hierarchical(x: DataFrame, n_clusters: int = 5, method: str = "ward",
                 **options) -> tuple[DataFrame, DataFrame]:
    """``assign(row_id, cluster)`` and the linkage matrix."""
    events = merge_events(x, method, **options)
    return cut_tree(x, events, n_clusters), linkage_matrix(events, x.count())
