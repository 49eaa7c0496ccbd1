"""Kernels on tile pairs: what later pairs of a super-block need not give out, and memory."""

import tracemalloc

import numpy as np
import pytest

from foldspark.operators import density, layout, linkage, normalise, pairwise, spanning, spectral


def tiles(near: float = 1.0, rows: int = 64):
    """Tile a, tile b near it and tile c farther away; distances a-b and a-c."""
    rng = np.random.default_rng(5)
    ids = np.arange(3 * rows).reshape(3, rows)
    made = [pairwise.Tile(i, {"comp": i // 4, "n": np.ones(rows, dtype=np.int64), "node": i}) for i in ids]
    return made, near + rng.random((rows, rows)), near + 5 + rng.random((rows, rows))


def given(out) -> int:
    return 0 if out is None else len(next(iter(out.values())))


@pytest.mark.parametrize("kernel", [pairwise._nearest_kernel(3, False), spanning._leaving, linkage._ward_near])
@pytest.mark.parametrize("mirrored", [False, True])
def test_a_farther_tile_gives_nothing(kernel, mirrored):
    (a, b, c), near, far = tiles()
    view = (lambda d: np.ascontiguousarray(d.T).T) if mirrored else (lambda d: d)
    assert given(kernel(a, b, view(near))) > 0
    assert given(kernel(a, c, view(far))) == 0


def test_nearest_rows_with_ties_and_undefined_distances():
    rng = np.random.default_rng(7)
    for _ in range(30):
        k, sizes = int(rng.integers(1, 5)), rng.integers(1, 9, 3)
        at = np.cumsum(sizes)[:-1]
        ids = np.split(rng.permutation(100)[:sizes.sum()], at)
        a = pairwise.Tile(ids[0], {})
        d = rng.integers(0, 4, (len(ids[0]), sizes.sum())).astype(float)
        d[rng.random(d.shape) < 0.1] = np.nan
        d[rng.random(d.shape) < 0.1] = np.inf
        kernel, found = pairwise._nearest_kernel(k, True), []
        for i, part in zip(ids, np.split(d, at, axis=1), strict=True):
            found.append(kernel(a, pairwise.Tile(i, {}), part.copy()))
        got = pairwise.least_per(("a",), ("d", "b"), k)({c: np.concatenate([f[c] for f in found]) for c in "abd"})
        want = [(r, *t) for r, row in zip(ids[0], d, strict=True)
                for t in sorted((v, i) for v, i in zip(row, np.concatenate(ids), strict=True) if np.isfinite(v))[:k]]
        assert sorted(zip(got["a"], got["d"], got["b"], strict=True)) == sorted(want)


def test_links_between_components_take_little_memory():
    rng = np.random.default_rng(6)
    a, b = (pairwise.Tile(i, {"comp": i % 40}) for i in np.arange(1600).reshape(2, 800))
    d = rng.integers(0, 50, (800, 800)).astype(float)
    tracemalloc.start()
    out = spanning._between(a, b, d)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = {}
    for i, j in np.ndindex(d.shape):
        p, q = a.comp[i], b.comp[j]
        if p < q:
            want[p, q] = min(want.get((p, q), (99.0, 0, 0)), (d[i, j], int(a.ids[i]), int(b.ids[j])))
    assert {(p, q): t for p, q, *t in zip(*(out[c].tolist() for c in ("comp", "other", "d", "lo", "hi")),
                                          strict=True)} == {k: list(v) for k, v in want.items()}
    assert peak < 3 * d.nbytes


def _points(rows=6, k=2):
    rng = np.random.default_rng(11)
    made = [pairwise.Tile(np.arange(rows) + rows * t, {
        "y": rng.normal(size=rows * k), "u": rng.normal(size=rows * 3), "core": np.arange(rows) % 2,
        "comp": np.arange(rows) + rows * t}) for t in range(2)]
    return made, rng.random((rows, rows))


def test_a_tile_pair_is_counted_for_both_its_tiles():
    (a, b), d = _points()
    out = density._within(0.5)(a, b, d)
    assert out["row_id"].tolist() == list(range(12))
    assert out["n"].tolist() == [*(d <= 0.5).sum(1), *(d <= 0.5).sum(0)]
    low = density._border(0.5)(a, b, d)
    want = {}
    for p, q, m in ((a, b, d), (b, a, d.T)):
        for i, j in zip(*np.nonzero((m <= 0.5) & (p.core == 0)[:, None] & (q.core == 1)[None, :])):
            want[p.ids[i]] = min(want.get(p.ids[i], 99), q.comp[j])
    assert dict(zip(low["row_id"], low["comp"])) == want


def test_an_affinity_is_computed_once_for_both_tiles():
    (a, b), d = _points()
    out = spectral._product(1.0, 3)(a, b, d)
    w = np.exp(-d * d)
    got = np.column_stack([out[f"g{c}"] for c in range(3)])
    assert np.allclose(got, np.concatenate([w @ b.u.reshape(-1, 3), w.T @ a.u.reshape(-1, 3)]))


def test_a_move_is_computed_once_for_both_tiles():
    (a, b), d = _points()
    out = layout._guttman(2)(a, b, d)
    diff = a.y.reshape(-1, 2)[:, None] - b.y.reshape(-1, 2)[None]
    placed = np.sqrt((diff ** 2).sum(2))
    move = (d / placed)[:, :, None] * diff
    got = np.column_stack([out["g0"], out["g1"]])
    assert np.allclose(got, np.concatenate([move.sum(1), -move.sum(0)]))
    assert np.allclose(out["stress"], [*((placed - d) ** 2).sum(1), *((placed - d) ** 2).sum(0)])


def test_balancing_many_frames_holds_little_beside_them():
    m = np.random.default_rng(2).random((4000, 14, 14)) + 0.1
    tracemalloc.start()
    out = normalise.balance(m, 3, 1e-5, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.6 * m.nbytes
    assert np.allclose(out[7], normalise.balance(m[7:8], 3, 1e-5, False)[0], rtol=1e-12)
