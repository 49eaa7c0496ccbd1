"""Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of double arithmetic.
DBL_MAX = 1.7976931348623157e308
DBL_EPS = 2.220446049250313e-16
INF = float("inf")
NAN = float("nan")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_bad(v: Column) -> Column:
    """NaN or infinite."""
    return F.isnan(v) | (F.abs(v) == F.lit(INF))


def safe_divide(a: Column, b: Column) -> Column:
    """a/b, and 0 where b = 0. The guard also keeps ANSI mode from raising."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def divide(a: Column, b: Column, at_zero: float) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(at_zero))


def log2_or_zero(x: Column) -> Column:
    """log2(x + eps), and 0 where that is not finite."""
    s = x + F.lit(DBL_EPS)
    return F.when((s > 0) & ~F.isnan(s) & (s != F.lit(INF)), F.log2(s)).otherwise(F.lit(0.0))


def log2_plus_one(v: Column) -> Column:
    """log2(v + 1) with IEEE results for v <= -1 (Spark alone would give NULL)."""
    return (F.when(v > -1, F.log2(v + 1))
            .when(v == -1, F.lit(-INF))
            .otherwise(F.lit(NAN)))


def pair_index(i: Column, j: Column, n: Column | int) -> Column:
    """Position of (i, j), i < j, in the row-major strict upper triangle of width n."""
    n = F.lit(n) if isinstance(n, int) else n
    i = i.cast("long")
    j = j.cast("long")
    n = n.cast("long")
    return i * n - F.shiftright(i * (i + 1), 1) + (j - i - 1)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two double arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
                       F.lit(0.0), lambda acc, t: acc + t)


def gaussian(u: Column) -> Column:
    return F.exp(-0.5 * u * u) / F.lit(math.sqrt(2 * math.pi))
