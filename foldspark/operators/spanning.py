"""Minimum spanning tree of row distances by Boruvka rounds.

A round asks every tile pair for the shortest link leaving each component, so
what travels is components x tiles. Links are compared by (d, lo, hi), a total
order, which keeps ties from closing a cycle. Once few components remain, their
shortest mutual links fit a bounded table and one step ends the tree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators.graph import components
from foldspark.operators.pairwise import cells, least_cells, least_per, pair_reduce, shape_of
from foldspark.session import Rounds

FINISH_BELOW = 256


def _weights(a, b, d):
    if "core" in a.payload:
        d = np.maximum(d, np.maximum(a.core[:, None], b.core[None, :]))
    return d


def _first_per(keys: tuple[np.ndarray, ...], d, lo, hi) -> np.ndarray:
    """Index of the least (d, lo, hi) of each key."""
    order = np.lexsort((hi, lo, d, *keys[::-1]))
    new = np.zeros(len(order), dtype=bool)
    if len(order):
        new[0] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order[new]


def _apart(a, b, w):
    """``w`` with links inside a component infinite, in place: the mirrored call wants the same."""
    if np.isin(a.comp, b.comp).any():
        p, q, cell = (a, b, w) if w.flags.c_contiguous else (b, a, w.T)
        np.copyto(cell, np.inf, where=p.comp[:, None] == q.comp[None, :])
    return w


def _leaving(a, b, d):
    """Shortest link from each component of a to another component in b; none where
    an earlier tile pair had a shorter one."""
    w = _apart(a, b, _weights(a, b, d))
    i, j = least_cells(a, w, 1)
    # what a row may still bring is bounded by its component's shortest link
    _, own = np.unique(a.comp, return_inverse=True)
    low = np.full(own.max() + 1, np.inf)
    np.minimum.at(low, own, a.best[:, 0])
    a.best[:, 0] = low[own]
    keep = w[i, j] <= a.best[i, 0]
    i, j = i[keep], j[keep]
    if not len(i):
        return None
    lo, hi = np.minimum(a.ids[i], b.ids[j]), np.maximum(a.ids[i], b.ids[j])
    at = _first_per((a.comp[i],), w[i, j], lo, hi)
    return {"comp": a.comp[i][at], "other": b.comp[j][at], "d": w[i, j][at],
            "lo": lo[at], "hi": hi[at]}


def _between(a, b, d):
    """Shortest link of every pair of components that meets here."""
    w = _weights(a, b, d)
    (ca, ia), (cb, ib) = (np.unique(t.comp, return_inverse=True) for t in (a, b))
    if ca[0] >= cb[-1]:
        return None
    # least of each pair of components: rows and columns side by side by component
    rows, columns = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
    least = np.fmin.reduceat(w[rows], np.searchsorted(ia[rows], np.arange(len(ca))), axis=0)
    least = np.fmin.reduceat(least[:, columns], np.searchsorted(ib[columns], np.arange(len(cb))), axis=1)
    # a pair without a comparable link keeps what it has, a pair of the mirrored call nothing
    undefined = np.isnan(least)
    least[ca[:, None] >= cb[None, :]] = np.nan
    found = w == least[ia].take(ib, axis=1)
    if undefined.any():
        found |= (undefined & (ca[:, None] < cb[None, :]))[ia].take(ib, axis=1)
    i, j = cells(found)
    if not len(i):
        return None
    lo, hi = np.minimum(a.ids[i], b.ids[j]), np.maximum(a.ids[i], b.ids[j])
    at = _first_per((a.comp[i], b.comp[j]), w[i, j], lo, hi)
    return {"comp": a.comp[i][at], "other": b.comp[j][at], "d": w[i, j][at],
            "lo": lo[at], "hi": hi[at]}


_LINK = "comp long, other long, d double, lo long, hi long"


def _finish(links: pd.DataFrame) -> pd.DataFrame:
    """Tree over at most FINISH_BELOW components (bounded, a few thousand links)."""
    links = links.sort_values(["d", "lo", "hi"])
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c
    kept = []
    for row in links.itertuples(index=False):
        p, q = find(row.comp), find(row.other)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((row.lo, row.hi, row.d))
    return pd.DataFrame(kept, columns=["a", "b", "d"]).astype({"a": "int64", "b": "int64", "d": "float64"})


def spanning_tree(x: DataFrame, core: bool = False, finish_below: int = FINISH_BELOW) -> DataFrame:
    """``edges(a, b, d)`` of the minimum spanning tree over ``x(row_id, v)``.

    With ``core`` the rows carry a core distance and links weigh
    max(core_a, core_b, d).
    """
    extra = ("core",) if core else ()
    size = shape_of(x)
    state = x.select("row_id", *extra, "v", F.col("row_id").cast("long").alias("comp"))
    edges, left = [], size[0]
    rounds = Rounds(x.sparkSession)
    while left > max(1, finish_below):
        state = rounds.keep("state", state)
        found = pair_reduce(state, _leaving, _LINK, ("comp", *extra), size,
                            combine=least_per(("comp",), ("d", "lo", "hi")))
        order = F.struct("d", "lo", "hi", "other")
        best = rounds.keep(f"best{len(edges)}", found.groupBy("comp").agg(F.min(order).alias("_m")).select("comp", "_m.*"))
        edges.append(best.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "d").distinct())
        merged = components(best.select(F.col("comp").alias("a"), F.col("other").alias("b")), rounds=rounds)
        merged = rounds.keep(f"merged{len(edges) % 2}", merged.withColumnRenamed("comp", "_to").withColumnRenamed("id", "comp"))
        left = merged.select("_to").distinct().count()
        state = state.join(merged, "comp").select("row_id", *extra, "v", F.col("_to").alias("comp"))
    if left > 1:
        state = rounds.keep("state", state)
        links = pair_reduce(state, _between, _LINK, ("comp", *extra), size,
                            combine=least_per(("comp", "other"), ("d", "lo", "hi")))
        links = links.groupBy("comp", "other").agg(
            F.min(F.struct("d", "lo", "hi")).alias("_m")).select("comp", "other", "_m.*")
        edges.append(links.groupBy(F.lit(0).alias("_one")).applyInPandas(
            _finish, "a long, b long, d double"))
    if not edges:
        return x.sparkSession.createDataFrame([], "a long, b long, d double")
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return rounds.result(out)
