"""Per-frame bead x bead distances.

One equi self-join on the frame key with a bead residual. Both sides read the
same hash exchange; a frame holding a large share of the beads is split by
AQE's skew join. The result is a matrix per frame, so n^2 rows per frame are
the output itself and no intermediate is larger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.functions.expressions import log2_or_zero, safe_divide
from foldspark.schemas import FRAME_KEY

_AXES = ("x", "y", "z")


def _mean_std(cols: list[Column]) -> tuple[Column, Column]:
    mean = (cols[0] + cols[1] + cols[2]) / 3
    var = sum(((c - mean) * (c - mean) for c in cols), F.lit(0.0)) / 3
    return mean, F.sqrt(var)


def _standardised(cols: list[Column]) -> list[Column]:
    mean, std = _mean_std(cols)
    return [safe_divide(c - mean, std) for c in cols]


def _ranks(x: Column, y: Column, z: Column) -> list[Column]:
    """0-based rank of each coordinate within its bead, ties in axis order."""
    def n(*flags: Column) -> Column:
        return sum((f.cast("double") for f in flags), F.lit(0.0))
    return [n(y < x, z < x), n(x <= y, z < y), n(x <= z, y <= z)]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


class Metric:
    """How one metric prepares a bead for either side and compares two beads."""

    def __init__(self, left: Callable, right: Callable, compare: Callable, symmetric: bool,
                 diagonal: float | None):
        self.left, self.right, self.compare = left, right, compare
        self.symmetric, self.diagonal = symmetric, diagonal


def _raw(x, y, z):
    return [x, y, z]


def _logs(x, y, z):
    return [log2_or_zero(c) for c in (x, y, z)]


def _euclid(a, b):
    d = [p - q for p, q in zip(a, b)]
    return F.sqrt(_dot(d, d))


def _manhattan(a, b):
    d = [F.abs(p - q) for p, q in zip(a, b)]
    return d[0] + d[1] + d[2]


def _std_cols(x, y, z):
    return _standardised([x, y, z])


def _std_ranks(x, y, z):
    # ranks are a permutation of 0, 1, 2: mean 1, population variance 2/3
    return [(r - 1) * (1.5 ** 0.5) for r in _ranks(x, y, z)]


def _one_minus(a, b):
    return 1 - _dot(a, b) / 3


METRICS: dict[str, Metric] = {
    "euclidean": Metric(_raw, _raw, _euclid, True, 0.0),
    "contact": Metric(_raw, _raw, _manhattan, True, 0.0),
    "log2_contact": Metric(_logs, _logs, _manhattan, True, 0.0),
    # one side standardised (ranked), the other raw: asymmetric and unbounded
    "pearsons": Metric(_std_cols, _raw, _one_minus, False, None),
    "spearman": Metric(_ranks, _raw, _one_minus, False, None),
    # the correlation distances proper
    "pearsons_true": Metric(_std_cols, _std_cols, _one_minus, True, 0.0),
    "spearman_true": Metric(_std_ranks, _std_ranks, _one_minus, True, 0.0),
}
_ALIASES = {"pearson": "pearsons", "pearson_true": "pearsons_true"}


def metric_of(name: str) -> Metric:
    name = _ALIASES.get(name, name)
    if name not in METRICS:
        raise KeyError(f"unknown metric {name!r}; available: {sorted(METRICS)}")
    return METRICS[name]


def distances(beads: DataFrame, metric: str, square: bool = False) -> DataFrame:
    """``pairs(label, replica, frame, i, j, v)``.

    A symmetric metric yields i < j unless ``square`` asks for the whole
    matrix; an asymmetric metric always yields the whole matrix.
    """
    m = metric_of(metric)
    xyz = [F.col(c) for c in _AXES]
    key = [F.col(c) for c in FRAME_KEY]
    a = beads.select(*key, F.col("bead").alias("i"),
                     *[c.alias(f"_a{n}") for n, c in enumerate(m.left(*xyz))])
    b = beads.select(*key, F.col("bead").alias("j"),
                     *[c.alias(f"_b{n}") for n, c in enumerate(m.right(*xyz))])
    joined = a.join(b, FRAME_KEY)
    if m.symmetric and not square:
        joined = joined.filter(F.col("i") < F.col("j"))
    v = m.compare([F.col(f"_a{n}") for n in range(3)], [F.col(f"_b{n}") for n in range(3)])
    if m.diagonal is not None:
        v = F.when(F.col("i") == F.col("j"), F.lit(m.diagonal)).otherwise(v)
    return joined.select(*FRAME_KEY, "i", "j", v.alias("v"))
