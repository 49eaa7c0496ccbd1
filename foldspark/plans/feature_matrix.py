"""Distance maps and the feature matrix X as single composed plans.

X is built from packed frames (see ``packed``): beads are grouped by frame once,
and each pass, one for the statistics and one for the result, computes whole
frames in a kernel. Where cells need a label's mean, X comes from a table of
cells instead; its statistics are one-row
aggregates over the sparse cells. In both, the zeros that padding adds enter the
statistics as a weight, so no padded cell is materialised before the result.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.functions.expressions import is_bad, pair_index
from foldspark.operators import clean, shape
from foldspark.plans import packed
from foldspark.operators.distance import distances
from foldspark.operators.normalise import normalise
from foldspark.operators.prepare import chunk_of, prep_of
from foldspark.schemas import FRAME_KEY
from foldspark.session import checkpointed, cut


def dist_map(beads: DataFrame, label: str | None = None, metric: str = "euclidean",
             norm: str | None = None, max_frames: int | None = None,
             **norm_options) -> DataFrame:
    """Whole distance matrices of one label (or all), optionally normalised."""
    if label is not None:
        beads = beads.filter(F.col("label") == label)
    if max_frames is not None:
        beads = clean.first_frames(beads, max_frames)
    if norm in ("ice", "kr") and "width" not in norm_options:
        norm_options["width"] = extent(beads)[0]  # from the beads, not from their pairs
    return normalise(distances(beads, metric, square=True), norm, **norm_options)


# Coordinates up to this size cannot give an infinite distance.
_SAFE = 1e100


def extent(beads: DataFrame) -> tuple[int, int, bool]:
    """Matrix width, number of frames, and whether all coordinates are ordinary
    numbers (so that no distance needs imputing)."""
    ordinary = F.bool_and((F.abs("x") < _SAFE) & (F.abs("y") < _SAFE) & (F.abs("z") < _SAFE))
    row = (beads.groupBy(FRAME_KEY).agg(F.max("bead").alias("top"), ordinary.alias("ok"))
           .agg(F.max("top").alias("top"), F.count(F.lit(1)).alias("n"),
                F.bool_and("ok").alias("ok")).first())
    return (0 if row["top"] is None else row["top"] + 1), row["n"], bool(row["ok"])


def _gaps(beads: DataFrame) -> bool:
    """Whether a bead lacks a key or a coordinate."""
    lacks = [F.col(c).isNull() for c in (*FRAME_KEY, "bead", "x", "y", "z")]
    return not beads.filter(reduce(or_, lacks)).isEmpty()


def normalised_cells(beads: DataFrame, labels: list[str], metric: str, norm: str | None,
                     width: int, impute: bool = True, **norm_options) -> DataFrame:
    """Imputed and normalised square matrices."""
    if norm in ("ice", "kr"):
        norm_options.setdefault("width", width)
    square = distances(beads, metric, square=True)
    if impute:
        square = clean.fill_label_mean(clean.clamp_infinite(square), labels)
    return normalise(square, norm, **norm_options)


def _weighted_extremes(values: DataFrame):
    """Least, greatest and mean finite ``v`` where each row counts ``w`` times."""
    finite = ~is_bad(F.col("v"))
    return values.agg(
        F.min(F.when(finite, F.col("v"))).alias("lo"),
        F.max(F.when(finite, F.col("v"))).alias("hi"),
        (F.sum(F.when(finite, F.col("v") * F.col("w")))
         / F.nullif(F.sum(F.when(finite, F.col("w"))), F.lit(0))).alias("m")).first()


def _literal(value):
    return F.lit(value).cast("double")


class _Unit:
    """Fill, preprocess and scale the values of a triangle."""

    def __init__(self, prep: str, mean: float | None, lo: float, hi: float):
        self.prep, self.mean, self.lo, self.hi = prep, math.nan if mean is None else mean, lo, hi
        self.low: float | None = None
        self.high = self.middle = self.constant = 0.0

    def prepared(self, v, lo=None, hi=None):
        """Under the extremes of X, or under those of the rows' chunks."""
        return packed.prepared(np.where(np.isfinite(v), v, self.mean), self.prep,
                               self.lo if lo is None else lo, self.hi if hi is None else hi)

    def scaled(self, v):
        if self.low is None:
            return np.zeros_like(v)
        if self.low == self.high:
            return np.full_like(v, self.constant)
        return (np.where(np.isfinite(v), v, self.middle) - self.low) / (self.high - self.low)

    def __call__(self, v, lo=None, hi=None):
        return self.scaled(np.where(np.isfinite(v), self.prepared(v, lo, hi), self.middle))


def _mean_of(s, total: int) -> float | None:
    mean = (s["sum"] or 0.0) / (total - s["nan"]) if total > s["nan"] else None
    # an infinite one is left to the finite mean after preprocessing
    return mean if mean is not None and math.isfinite(mean) else None


def _from_chunks(beads, labels, chain, prep, constant, row_ids, width, frames_n, chunks) -> DataFrame:
    """X whose rows are preprocessed under the extremes of their chunk."""
    columns = width * (width - 1) // 2
    frames = cut(packed.frames_of(beads))
    frames = cut(frames.join(shape.stack(frames, labels), FRAME_KEY).withColumn(
        "_chunk", chunk_of(F.col("row_id"), frames_n, chunks).cast("long")))
    sizes = frames.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    # frames of one bead have no cells
    stats = cut(sizes.join(packed.chunk_statistics(frames, chain), "_chunk", "left").withColumn(
        "_pads", F.col("_rows") * columns - F.coalesce("n", F.lit(0))))
    s = stats.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bad", "nan")), F.sum("sum").alias("sum")).first()
    mean = _mean_of(s, frames_n * columns)
    also = [F.when(F.col("_pads") > 0, F.lit(0.0)), F.when(F.col("bad") > 0, _literal(mean))]
    nan = _literal(math.nan)
    stats = stats.select("_chunk", "_pads", F.coalesce(F.least("lo", *also), nan).alias("_lo"),
                         F.coalesce(F.greatest("hi", *also), nan).alias("_hi"))
    unit = _Unit((prep or "none").lower(), mean, math.nan, math.nan)
    unit.constant = constant
    g, lo, hi = prep_of(prep), F.col("_lo"), F.col("_hi")
    frames = frames.join(stats.select("_chunk", "_lo", "_hi"), "_chunk").drop("_chunk")
    after = packed.statistics(frames, chain, unit.prepared)
    pads = _weighted_extremes(stats.filter("_pads > 0").select(
        g(F.lit(0.0), lo, hi).alias("v"), F.col("_pads").cast("long").alias("w")))
    zeros = stats.filter(F.col("_pads") > 0).filter(~is_bad(g(F.lit(0.0), lo, hi))).agg(F.sum("_pads")).first()[0] or 0
    found = [float(e) for e in (after["lo"], after["hi"], pads["lo"], pads["hi"]) if e is not None]
    weight = after["finite_n"] + zeros
    unit.middle = ((after["finite_sum"] or 0.0) + (pads["m"] or 0.0) * zeros) / weight if weight else math.nan
    if found:
        unit.low, unit.high = min(found), max(found)
    return packed.rows(frames if row_ids else frames.drop("row_id"), chain, unit, width, None)


def _from_frames(beads, labels, chain, prep, constant, row_ids, width, frames_n) -> DataFrame:
    # both passes and the row numbers read the grouped frames
    frames = cut(packed.frames_of(beads))
    columns = width * (width - 1) // 2
    s = packed.statistics(frames, chain)
    total = frames_n * columns
    pads = total - s["n"]
    mean = _mean_of(s, total)
    name = (prep or "none").lower()
    ends = [e for e in (s["lo"], s["hi"], 0.0 if pads else None) if e is not None]
    low, high = (min(ends), max(ends)) if ends else (math.nan, math.nan)
    unit = _Unit(name, mean, low, high)
    unit.constant = constant
    zero = unit.prepared(np.zeros(1))
    # every method is monotone between the extremes unless 1/(1+v) meets its pole
    if ends and not s["bad"] and (name != "complete" or not low <= -1 <= high):
        at_ends = unit.prepared(np.array([low, high]))
        found = [float(e) for e in at_ends if np.isfinite(e)]
    else:
        after = packed.statistics(frames, chain, unit.prepared)
        found = [e for e in (after["lo"], after["hi"]) if e is not None]
        weight, amount = after["finite_n"], after["finite_sum"] or 0.0
        if pads and np.isfinite(zero[0]):
            found.append(float(zero[0]))
            weight, amount = weight + pads, amount + pads * float(zero[0])
        unit.middle = amount / weight if weight else math.nan
    if found:
        unit.low, unit.high = min(found), max(found)
    if row_ids:
        frames = frames.join(shape.stack(frames, labels), FRAME_KEY)
    return packed.rows(frames, chain, unit, width, float(unit.scaled(zero)[0]))


def feature_matrix(beads: DataFrame, labels: list[str], metric: str = "euclidean",
                   norm: str | None = None, prep: str = "weighted", chunks: int | None = None,
                   constant: float = 0.0, row_ids: bool = True, materialise: bool | None = None,
                   **norm_options) -> DataFrame:
    """``x_vec(label, replica, frame, row_id, v array<double>)``, values in [0, 1].

    ``materialise`` writes the normalised cells once instead of deriving them
    for the statistics and again for the result; by default only the iterative
    norms do. ``constant`` is the value of an X whose entries are all equal.
    """
    beads = beads.filter(F.col("label").isin(labels))
    width, frames, ordinary = extent(beads)
    columns = width * (width - 1) // 2
    if ordinary and chunks is None and not materialise:
        return _from_frames(beads, labels, packed.Chain(metric, norm, **norm_options), prep, constant,
                            row_ids, width, frames)
    # cells that are null stay null, which only the table of cells can tell from NaN
    if ordinary and not materialise and not _gaps(beads):
        return _from_chunks(beads, labels, packed.Chain(metric, norm, **norm_options), prep, constant,
                            row_ids, width, frames, chunks)
    square = normalised_cells(beads, labels, metric, norm, width, not ordinary, **norm_options)
    # diagonal rows stay as markers, so a frame of one bead keeps its row of X
    cells = square.filter(F.col("i") <= F.col("j")).select(
        *FRAME_KEY, F.when(F.col("i") < F.col("j"),
                           pair_index(F.col("i"), F.col("j"), width)).alias("f"), "v")
    if materialise if materialise is not None else norm in ("ice", "kr"):
        cells = checkpointed(cells)
    ids = shape.stack(beads, labels) if row_ids or chunks is not None else None

    real = cells.filter(F.col("f").isNotNull())
    raw = F.col("v")
    bad = is_bad(raw)
    s = real.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(bad, 1)).alias("bad"), F.count(F.when(F.isnan(raw), 1)).alias("nan"),
        F.sum(F.when(~F.isnan(raw), raw)).alias("sum"),
        F.min(F.when(~bad, raw)).alias("lo"), F.max(F.when(~bad, raw)).alias("hi")).first()
    total = frames * columns
    pads = total - s["n"]
    mean = _mean_of(s, total)
    filled = F.when(bad, _literal(mean if mean is not None else math.nan)).otherwise(raw)
    g = prep_of(prep)

    if chunks is None:
        ends = [e for e in (s["lo"], s["hi"], 0.0 if pads else None) if e is not None]
        low, high = (min(ends), max(ends)) if ends else (None, None)
        lo, hi = _literal(low), _literal(high)
        # every method is monotone between the extremes unless 1/(1+v) meets its pole
        monotone = g is not prep_of("complete") or not ends or not low <= -1 <= high
        if monotone and not s["bad"] and ends:
            at_ends = [g(lo, lo, hi), g(hi, lo, hi)]
            lo2, hi2 = F.least(*at_ends), F.greatest(*at_ends)
            m2 = F.lit(None).cast("double")
        else:
            weighted = real.select(g(filled, lo, hi).alias("v"), F.lit(1).cast("long").alias("w"))
            if pads:
                weighted = weighted.unionByName(real.sparkSession.range(1).select(
                    g(F.lit(0.0), lo, hi).alias("v"), F.lit(pads).cast("long").alias("w")))
            after = _weighted_extremes(weighted)
            lo2, hi2, m2 = (_literal(after[c]) for c in ("lo", "hi", "m"))
        extra = []
    else:
        keyed = ids.withColumn("_chunk", chunk_of(F.col("row_id"), frames, chunks)).drop("row_id")
        sizes = keyed.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_rows"))
        v = F.when(is_bad(filled), F.lit(None)).otherwise(filled)
        zero = F.when(F.col("_pads") > 0, F.lit(0.0))
        stats = (sizes.join(real.join(keyed, FRAME_KEY).groupBy("_chunk").agg(
                    F.count(F.lit(1)).alias("_n"), F.min(v).alias("_l"), F.max(v).alias("_h")),
                    "_chunk", "left")
                 .withColumn("_pads", F.col("_rows") * columns - F.coalesce("_n", F.lit(0)))
                 .select("_chunk", "_pads", F.least("_l", zero).alias("_lo"),
                         F.greatest("_h", zero).alias("_hi")))
        stats = cut(stats)
        keyed = keyed.join(stats.select("_chunk", "_lo", "_hi"), "_chunk").drop("_chunk")
        lo, hi = F.col("_lo"), F.col("_hi")
        extra = ["_lo", "_hi"]
        weighted = real.join(keyed, FRAME_KEY).select(
            g(filled, lo, hi).alias("v"), F.lit(1).cast("long").alias("w"))
        after = _weighted_extremes(weighted.unionByName(stats.filter("_pads > 0").select(
            g(F.lit(0.0), lo, hi).alias("v"), F.col("_pads").cast("long").alias("w"))))
        lo2, hi2, m2 = (_literal(after[c]) for c in ("lo", "hi", "m"))
        cells = cells.join(keyed, FRAME_KEY)

    def unit(v):
        return (F.when(lo2.isNull(), F.lit(0.0)).when(hi2 == lo2, F.lit(constant))
                .otherwise((F.when(is_bad(v), m2).otherwise(v) - lo2) / (hi2 - lo2)))

    value = F.when(bad, unit(m2)).otherwise(unit(g(filled, lo, hi)))
    cell = F.when(F.col("f").isNotNull(), F.struct("f", value.alias("v")))
    grouped = cells.groupBy(*FRAME_KEY, *extra).agg(F.collect_list(cell).alias("_cells"))
    grouped = grouped.withColumn("_pad", unit(g(F.lit(0.0), lo, hi))).drop(*extra)
    if row_ids:
        grouped = grouped.join(ids, FRAME_KEY)
    return shape.pack(grouped, columns)
