"""Frames, norms and the feature matrix against plain numpy."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark import session
from foldspark.operators import clean, distance, normalise, shape
from foldspark.plans import analysis
from foldspark.plans import feature_matrix as fm
from foldspark.schemas import BEADS

KEY = ["label", "replica", "frame"]


def make_beads(spark, frames):
    """``frames``: (label, replica, frame) -> n x 3 array."""
    rows = [(*k, b, *map(float, p)) for k, xyz in frames.items() for b, p in enumerate(xyz)]
    return spark.createDataFrame(rows, BEADS)


def random_frames(seed=0, sizes=(4, 5, 5, 1, 6)):
    rng = np.random.default_rng(seed)
    return {("A" if n % 2 == 0 else "B", 1 + n // 3, n): rng.normal(3, 1, (s, 3))
            for n, s in enumerate(sizes)}


def matrices(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.label, r.replica, r.frame), {})[(r.i, r.j)] = r.v
    return out


def dense(cells, n):
    m = np.zeros((n, n))
    for (i, j), v in cells.items():
        m[i, j] = v
    return m


def balance(m, rounds, tol=1e-5):
    """The recurrence as published, one matrix at a time."""
    n = len(m)
    b, cur = np.ones(n), m.copy()
    for _ in range(rounds):
        old, rows, cols = b.copy(), cur.sum(1), cur.sum(0)
        b = np.where((rows != 0) & (cols != 0), b * np.sqrt(np.abs(rows * cols)), 1.0)
        cur = m / np.outer(b, b)
        if np.abs(b - old).sum() < tol:
            break
    return cur


@pytest.mark.parametrize("rounds", [7, 100])
@pytest.mark.parametrize("packed", [True, False])
def test_ice_layouts_agree_with_the_recurrence(spark, rounds, packed):
    frames = random_frames()
    square = distance.distances(make_beads(spark, frames), "euclidean", square=True)
    if rounds == 100 and not packed:
        rounds = 12  # each long-form round is a job
    got = matrices(normalise.ice(square, max_iter=rounds, width=6,
                                 packed_beads=1024 if packed else 0))
    for k, xyz in frames.items():
        d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
        assert np.allclose(dense(got[k], len(xyz)), balance(d, rounds), rtol=1e-9, atol=1e-12)


def test_mixed_sizes_use_both_layouts(spark):
    square = distance.distances(make_beads(spark, random_frames()), "euclidean", square=True)
    a = matrices(normalise.ice(square, max_iter=4, width=6, packed_beads=4))
    b = matrices(normalise.ice(square, max_iter=4, width=6))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].keys() == b[k].keys()
        assert all(abs(a[k][c] - b[k][c]) < 1e-9 for c in a[k])


@pytest.mark.parametrize("side", [2, 3, 64])
def test_tiles_of_any_side_follow_the_recurrence(spark, side):
    frames = random_frames()
    square = distance.distances(make_beads(spark, frames), "euclidean", square=True)
    got = matrices(normalise.ice(square, max_iter=5, width=6, packed_beads=0, tile_side=side))
    for k, xyz in frames.items():
        d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
        assert np.allclose(dense(got[k], len(xyz)), balance(d, 5), rtol=1e-9, atol=1e-12)


def test_a_round_of_balancing_does_not_shuffle_cells(spark):
    square = distance.distances(make_beads(spark, random_frames()), "euclidean", square=True)
    tiles = normalise._tiles(session.cut(square), 2, 4).persist()
    tiles.count()
    blocks = session.cut(square.groupBy(*KEY).agg(F.floor(F.max("i") / 2).alias("top")))
    ones = F.array_repeat(F.lit(1.0), 2)
    state = session.cut(blocks.select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("block"), ones.alias("b")))
    round_ = normalise._tile_sums(normalise._beside(tiles, state, blocks), 2)
    round_.collect()
    lines = round_._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].split("\n")
    at = next(k for k, line in enumerate(lines) if "InMemoryTableScan" in line)
    depth, above = re.search(r"\w", lines[at]).start(), []
    for line in reversed(lines[:at]):
        own = re.search(r"\w", line)
        if own and own.start() < depth:
            depth = own.start()
            above.append(line)
    assert any("MapInArrow" in line for line in above) and not any("Exchange" in line for line in above)
    tiles.unpersist()


def test_balanced_rows_add_up_to_one(spark):
    square = distance.distances(make_beads(spark, random_frames(sizes=(5, 6, 7))), "euclidean", True)
    even = normalise.ice(square, max_iter=500, tol=1e-13, balanced=True)
    sums = even.groupBy(*KEY, "i").agg(F.sum("v").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-8 for r in sums)


def numpy_x(frames, labels, metric, norm, prep):
    """The whole chain on dense arrays."""
    normed = {}
    for label in labels:
        ds = []
        for k, xyz in sorted((k, v) for k, v in frames.items() if k[0] == label):
            if metric == "euclidean":
                d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
            else:
                d = np.abs(xyz[:, None] - xyz[None]).sum(-1)
            np.fill_diagonal(d, 0.0)
            d[np.isinf(d)] = np.finfo(float).max / 2
            ds.append(d)
        values = np.concatenate([d.ravel() for d in ds])
        mean = values[~np.isnan(values)].mean()
        for d in ds:
            d[np.isnan(d)] = mean
        if norm == "vc":
            ds = [np.divide(d, d.sum(1, keepdims=True), out=np.zeros_like(d),
                            where=d.sum(1, keepdims=True) != 0) for d in ds]
        elif norm == "log_transform":
            ds = [np.log2(d + 1) for d in ds]
        normed[label] = ds
    n = max(len(d) for ds in normed.values() for d in ds)
    rows = []
    for label in labels:
        for d in normed[label]:
            padded = np.zeros((n, n))
            padded[:len(d), :len(d)] = d
            rows.append(padded[np.triu_indices(n, 1)])
    x = np.array(rows)
    if prep == "single":
        x = np.exp(-x / x.max())
    elif prep == "complete":
        x = 1 / (1 + x)
    elif prep == "average":
        x = (x - x.min()) / (x.max() - x.min())
    return (x - x.min()) / (x.max() - x.min())


@pytest.mark.parametrize("norm,prep", [("vc", "weighted"), (None, "single"),
                                       ("log_transform", "complete"), ("vc", "average")])
@pytest.mark.parametrize("gaps", [False, True])
def test_feature_matrix(spark, norm, prep, gaps):
    frames = random_frames(3)
    if gaps:
        frames[("A", 1, 2)][1, 0] = np.nan
        frames[("B", 1, 1)][3, 2] = np.nan
    x = fm.feature_matrix(make_beads(spark, frames), ["B", "A"], norm=norm, prep=prep)
    got = np.array([r.v for r in x.orderBy("row_id").collect()])
    assert np.allclose(got, numpy_x(frames, ["B", "A"], "euclidean", norm, prep), atol=1e-12)


def test_chunks_follow_row_order(spark):
    frames = random_frames(5, (4, 4, 4, 4, 4, 4, 4))
    beads = make_beads(spark, frames)
    x = fm.feature_matrix(beads, ["A", "B"], prep="single", chunks=3)
    raw = []
    for k in sorted(frames):
        d = np.sqrt(((frames[k][:, None] - frames[k][None]) ** 2).sum(-1))
        raw.append(d[np.triu_indices(4, 1)])
    raw, size = np.array(raw), max(1, len(raw) // 3)
    parts = [raw[i:i + size] for i in range(0, len(raw), size)]
    want = np.concatenate([np.exp(-p / p.max()) for p in parts])
    want = (want - want.min()) / (want.max() - want.min())
    got = np.array([r.v for r in x.orderBy("row_id").collect()])
    assert np.allclose(got, want, atol=1e-12)


def test_chunks_need_no_table_of_cells(spark, monkeypatch):
    def refused(*args, **options):
        raise AssertionError("whole frames hold all that chunks need")
    monkeypatch.setattr(fm, "normalised_cells", refused)
    frames = random_frames(6, (4, 3, 4, 4, 2))
    x = fm.feature_matrix(make_beads(spark, frames), ["A", "B"], prep="average", chunks=2)
    raw = np.zeros((len(frames), 6))
    for r, k in enumerate(sorted(frames)):
        n = len(frames[k])
        i, j = np.triu_indices(n, 1)
        d = np.sqrt(((frames[k][:, None] - frames[k][None]) ** 2).sum(-1))
        raw[r, i * 4 - i * (i + 1) // 2 + (j - i - 1)] = d[i, j]
    size = max(1, len(raw) // 2)
    want = np.concatenate([(p - p.min()) / (p.max() - p.min()) for p in
                           (raw[at:at + size] for at in range(0, len(raw), size))])
    got = np.array([r.v for r in x.orderBy("row_id").collect()])
    assert np.allclose(got, want, atol=1e-12)


def test_constant_and_single_bead_frames(spark):
    one = {("A", 1, 0): np.zeros((1, 3)), ("A", 1, 1): np.ones((3, 3))}
    x = fm.feature_matrix(make_beads(spark, one), ["A"])
    assert [r.v for r in x.orderBy("row_id").collect()] == [[0.0] * 3, [0.0] * 3]


def test_log_of_values_below_minus_one(spark):
    df = spark.createDataFrame([(v,) for v in (-2.0, -1.0, 0.0, 3.0)], "v double")
    got = [r.v for r in normalise.log_transform(df).collect()]
    assert np.isnan(got[0]) and got[1] == -np.inf and got[2:] == [0.0, 2.0]


def test_padding_of_frames_and_beads(spark):
    frames = {("A", 1, 10): np.ones((2, 3)), ("A", 1, 20): np.ones((2, 3)), ("A", 2, 5): np.ones((3, 3))}
    beads = make_beads(spark, frames)
    grown = shape.pad_frames(beads)
    assert {(r.replica, r.frame) for r in grown.collect()} == {(1, 10), (1, 20), (2, 5), (2, 6)}
    assert shape.pad_beads(beads).count() == 9


def test_first_frames_cross_replicas(spark):
    frames = {("A", r, f): np.ones((1, 3)) for r in (1, 2, 3) for f in range(4)}
    kept = clean.first_frames(make_beads(spark, frames), 6).collect()
    assert sorted((r.replica, r.frame) for r in kept) == [(1, f) for f in range(4)] + [(2, 0), (2, 1)]


def test_bootstrap_is_exact_and_repeatable(spark):
    x = spark.range(10).select(F.col("id").alias("row_id"), F.array(F.lit(1.0)).alias("v"))
    a = clean.bootstrap(x, 25).orderBy("draw").collect()
    assert len(a) == 25
    assert a == clean.bootstrap(x.repartition(3), 25).orderBy("draw").collect()


def test_unknown_names(spark):
    with pytest.raises(KeyError):
        distance.metric_of("cosine")
    with pytest.raises(KeyError):
        normalise.normalise(None, "sqrt")
    with pytest.raises(KeyError):
        analysis.run_reduction("lda", None)
    with pytest.raises(KeyError):
        analysis.run_clustering("birch", None)
    assert distance.metric_of("pearson") is distance.metric_of("pearsons")


@pytest.mark.parametrize("metric", ["euclidean", "log2_contact", "pearsons", "spearman_true"])
@pytest.mark.parametrize("norm", [None, "vc", "ice"])
def test_packed_frames_equal_the_table_of_cells(spark, metric, norm):
    beads = make_beads(spark, random_frames(3))
    packed = fm.feature_matrix(beads, ["A", "B"], metric, norm, "average")
    cells = fm.feature_matrix(beads, ["A", "B"], metric, norm, "average", materialise=True)
    a, b = ({r.row_id: r.v for r in x.collect()} for x in (packed, cells))
    assert a.keys() == b.keys()
    assert all(np.allclose(a[k], b[k], atol=1e-9, equal_nan=True) for k in a)


def test_one_long_frame_among_short_ones(spark):
    """2,000 beads beside frames of ten, with joins that must shuffle."""
    frames = random_frames(4, (2000, *(10,) * 12))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        beads = make_beads(spark, frames)
        x = fm.feature_matrix(beads, ["A", "B"], "euclidean").select(
            "frame", F.size("v").alias("n"), F.array_max("v").alias("hi"),
            F.aggregate("v", F.lit(0.0), lambda a, t: a + t).alias("s")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    top = max(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)).max() for p in frames.values())
    for r in x:
        p = next(v for k, v in frames.items() if k[2] == r.frame)
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
        assert r.n == 2000 * 1999 // 2
        assert np.isclose(r.s, np.triu(d).sum() / top) and np.isclose(r.hi, d.max() / top)


def test_missing_and_corrupt_replica_files_are_skipped(spark, tmp_path):
    from foldspark.sources import sinks, trajectories

    frames = {("A", r, 10 * r + f): np.full((3, 3), float(r)) for r in (1, 2, 3) for f in (0, 1)}
    sinks.write_beads(make_beads(spark, frames), str(tmp_path))
    part = next((tmp_path / "label=A" / "replica=2").glob("*.parquet"))
    for crc in part.parent.glob(".*.crc"):
        crc.write_bytes(b"")
    part.write_bytes(b"PAR1 not a table")
    beads = trajectories.load_beads(spark, {"A": str(tmp_path / "label=A")}, replicas=(1, 4), stride=1)
    assert {r.replica for r in beads.select("replica").distinct().collect()} == {1, 3}
