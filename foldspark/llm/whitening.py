"""Embedding whitening from a pivoted Cholesky factor and one-sided Jacobi.

The centred scatter is summed by tasks and factored once, a matrix of width x
width whatever the rows: pivoted Cholesky gives a triangular factor (its rows
in pivot order), whose columns are rotated until they are orthogonal. The norms
of the rotated columns are the square roots of the eigenvalues, and the columns
over their norms are the components. No eigenvalue routine and no product of
the factor with itself is formed, so small eigenvalues keep their digits.

Entries are quantised to integers, x = floor(scale * c) + shift, so that the
sums behind the mean are exact and do not depend on the order of tasks.

Rows: null vectors and vectors with a null or non-finite entry take no part. Of
vectors of several lengths those of the most frequent one take part (of equal
counts the longest). Repeated rows count and come back each for itself; a null
id is kept. An x beyond 2^62 is held there, and a deviation beyond a long is
null. An empty table, or one without spread, gives no rows. Other columns of
the input are not read, so they cannot clash."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
_MOST = float(1 << 62)
# Rows multiplied at once.
_ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """``sums`` of the n integer vectors, ``components`` as columns,
    their eigenvalues, and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float


def usable(rows: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite."""
    bad = F.exists(vec_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~bad)


def _integers(vectors: pa.Array, width: int) -> np.ndarray:
    c = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.clip(np.floor(SCALE * c), -_MOST, _MOST).astype(np.int64) + SHIFT


def _parts(batches, column: int, width: int):
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, _integers(part.column(column), width)


def _centred(x: np.ndarray, n: int, sums) -> np.ndarray:
    """x - S / n. Whole multiples of n first, so that the mean's rounding does
    not enter every row."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def _deviation(x: np.ndarray, n: int, sums) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2; Python integers where 64 bits could overflow."""
    centre = np.array([s / n for s in sums])
    if (np.abs(x - centre).max(initial=0) + 1) ** 2 * n * n * x.shape[1] < 2.0 ** 62 and n * np.abs(x).max() < 2 ** 62:
        off = n * x - np.array(sums, dtype=np.int64)
        return (off * off).sum(axis=1).tolist()
    found = [sum((n * t - s) ** 2 for t, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [d if d < 1 << 63 else None for d in found]


def _length_and_sums(vectors: DataFrame) -> tuple[int, int, tuple[int, ...]]:
    """The most frequent length, its rows, and their exact sums by dimension."""
    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(sizes).tolist():
                x = _integers(batch.column(0).filter(pa.array(sizes == width)), width)
                count, high, low = found.get(width, (0, 0, 0))
                # in two halves of 32 bits, neither of which overflows in a task
                found[width] = (count + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0))
        for width, (count, high, low) in found.items():
            yield pa.record_batch([pa.array([width] * width), pa.array(range(width)), pa.array([count] * width),
                                   pa.array(high), pa.array(low)], names=["width", "d", "n", "high", "low"])

    whole = F.col("high").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(12,0)") + F.col("low")
    per = (vectors.mapInArrow(run, "width long, d long, n long, high long, low long").groupBy("width", "d")
           .agg(F.sum("n").alias("n"), F.sum(whole.cast("decimal(38,0)")).alias("s")))
    row = per.filter("d = 0").orderBy(F.desc("n"), F.desc("width")).select("width", "n").first()
    if row is None:
        return 0, 0, ()
    sums = {r["d"]: int(r["s"]) for r in per.filter(F.col("width") == row["width"]).collect()}
    return row["width"], row["n"], tuple(sums[d] for d in range(row["width"]))


def _scatter(vectors: DataFrame, width: int, transform) -> np.ndarray:
    """The sum of t t' over all rows t of ``transform(x)``, divided by nothing;
    a last row and column hold the plain sums of t."""
    def run(batches):
        total = None
        for _, x in _parts(batches, 0, width):
            t = transform(x)
            t = np.column_stack([t, np.ones(len(t))])
            total = t.T @ t if total is None else total + t.T @ t
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "s"])

    cells = (vectors.mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
             .toPandas())
    size = int(cells["i"].max()) + 1
    out = np.zeros((size, size))
    out[cells["i"], cells["j"]] = cells["s"]
    return out + np.triu(out, 1).T


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """G with G G' = a for a positive semidefinite a: a lower triangular factor
    whose rows are put back from pivot order, one column per rank."""
    n = len(a)
    left, order, columns = a.diagonal().copy(), np.arange(n), []
    least = left.max(initial=0.0) * n * np.finfo(float).eps
    for k in range(n):
        at = k + int(left[order[k:]].argmax())
        order[[k, at]] = order[[at, k]]
        pivot = order[k]
        if left[pivot] <= least:
            break
        rest = order[k + 1:]
        column = np.zeros(n)
        column[pivot] = np.sqrt(left[pivot])
        known = sum((c[rest] * c[pivot] for c in columns), np.zeros(len(rest)))
        column[rest] = (a[rest, pivot] - known) / column[pivot]
        left[rest] -= column[rest] ** 2
        columns.append(column)
    return np.column_stack(columns) if columns else np.zeros((n, 0))


def _rounds(n: int):
    """All pairs of n columns, as rounds of disjoint pairs (a tournament)."""
    ring = list(range(n + n % 2))
    for _ in range(len(ring) - 1):
        pairs = [(min(p), max(p)) for p in zip(ring[:len(ring) // 2], reversed(ring), strict=False) if max(p) < n]
        yield np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(g: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of g g', by rotating the
    columns of g until every two are orthogonal."""
    g = g.copy()
    rounds = list(_rounds(g.shape[1]))
    limit = np.finfo(float).eps * np.sqrt(max(1, len(g)))
    for _ in range(most_sweeps):
        worst = 0.0
        for p, q in rounds:
            a, b = g[:, p], g[:, q]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            size = np.sqrt(alpha * beta)
            turn = np.abs(gamma) > limit * size
            if not turn.any():
                continue
            worst = max(worst, float((np.abs(gamma[turn]) / size[turn]).max()))
            p, q, a, b = p[turn], q[turn], a[:, turn], b[:, turn]
            zeta = (beta[turn] - alpha[turn]) / (2.0 * gamma[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1.0 / np.hypot(1.0, t)
            g[:, p], g[:, q] = c * a - c * t * b, c * t * a + c * b
        if worst == 0.0:
            break
    else:
        raise RuntimeError(f"columns not orthogonal after {most_sweeps} sweeps")
    norms = np.sqrt((g * g).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, g[:, order] / norms[order]


def fit(rows: DataFrame, vec_col: str = "embedding") -> Whitening:
    """Mean, components and eigenvalues of all usable vectors. What reaches the
    driver is of width and width x width."""
    vectors = usable(rows.select(rows[vec_col].cast("array<double>").alias("v")), "v")
    width, n, sums = _length_and_sums(vectors)
    if not n:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    of_width = vectors.filter(F.size("v") == width)
    covariance = _scatter(of_width, width, lambda x: _centred(x, n, sums))[:width, :width] / n
    values, components = one_sided_jacobi(pivoted_cholesky(covariance))
    return Whitening(n, sums, components, values, float(covariance.trace()))


def _projection(model: Whitening, k: int) -> np.ndarray:
    return model.components[:, :k] / np.sqrt(model.values[:k])


def identity_error(rows: DataFrame, model: Whitening, k: int, vec_col: str = "embedding") -> float:
    """Largest entry, by magnitude, of the whitened rows' covariance minus the
    identity. The rows are centred but for rounding; what is left is taken off."""
    turn, width = _projection(model, k), len(model.sums)
    vectors = usable(rows.select(rows[vec_col].cast("array<double>").alias("v")), "v").filter(F.size("v") == width)
    total = _scatter(vectors, width, lambda x: _centred(x, model.n, model.sums) @ turn) / model.n
    mean = total[-1, :-1]
    return float(np.abs(total[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0))


def whiten(rows: DataFrame, model: Whitening, k: int = 8, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, deviation, whitened)``: the first k components (all, if fewer)
    of every usable row of the model's width."""
    schema = "vec_id long, deviation long, whitened array<double>"
    k, width = min(k, len(model.values)), len(model.sums)
    vectors = usable(rows.select(rows[id_col].cast("long").alias("vec_id"),
                                 rows[vec_col].cast("array<double>").alias("v")), "v").filter(F.size("v") == width)
    turn = _projection(model, k)

    def run(batches):
        for part, x in _parts(batches, 1, width):
            white = _centred(x, model.n, model.sums) @ turn
            offsets = np.arange(len(x) + 1, dtype=np.int32) * k
            yield pa.record_batch(
                [part.column(0), pa.array(_deviation(x, model.n, model.sums), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.ravel()))],
                names=["vec_id", "deviation", "whitened"])

    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    return vectors.mapInArrow(run, schema)
