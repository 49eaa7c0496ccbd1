"""Row-pair operators, clustering and reductions against brute force."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_frame
from foldspark import session
from foldspark.operators import (density, evaluate, graph, kmeans, krylov, layout, linkage, model, pairwise,
                                 reduce, spanning, spectral, tsne, umap)
from foldspark.plans import analysis
from test_matrices import make_beads, random_frames


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(1)
    return np.concatenate([rng.normal(c, 0.4, (14, 5)) for c in (0.0, 2.0, 5.0)])


@pytest.fixture(scope="module")
def x(spark, points):
    return rows_frame(spark, points).cache()


def dist(p):
    return np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))


def test_feature_blocks_add_up(spark, points, x):
    want = dist(points)
    for block in (2, 2048):
        out = pairwise.pair_reduce(x, pairwise._all_pairs, "a long, b long, d double",
                                   tile_rows=16, feature_block=block).collect()
        assert len(out) == len(points) * (len(points) - 1) // 2
        assert max(abs(r.d - want[r.a, r.b]) for r in out) < 1e-12


def test_equal_rows_are_at_distance_zero(spark):
    twin = rows_frame(spark, np.full((40, 7), 0.1) * np.pi)
    assert pairwise.row_pairs(twin).agg(F.max("d")).first()[0] == 0.0


def greedy(d, method):
    """One merge at a time."""
    d, n = d.copy(), np.ones(len(d))
    np.fill_diagonal(d, np.inf)
    heights = []
    for _ in range(len(d) - 1):
        i, j = divmod(int(np.argmin(d)), len(d))
        h = d[i, j]
        heights.append(h)
        a, b = d[i].copy(), d[j].copy()
        if method == "single":
            new = np.minimum(a, b)
        elif method == "complete":
            new = np.where(np.isinf(a) | np.isinf(b), np.inf, np.maximum(a, b))
        elif method == "average":
            new = (n[i] * a + n[j] * b) / (n[i] + n[j])
        elif method == "weighted":
            new = (a + b) / 2
        else:
            new = np.sqrt(np.maximum(((n[i] + n) * a ** 2 + (n[j] + n) * b ** 2 - n * h * h)
                                     / (n[i] + n[j] + n), 0))
        new[[i, j]] = np.inf
        d[i] = d[:, i] = new
        d[j] = d[:, j] = np.inf
        n[i] += n[j]
    return np.sort(heights)


@pytest.mark.parametrize("method", linkage.METHODS)
@pytest.mark.parametrize("finish", [8, 256])
def test_linkage_heights(spark, points, x, method, finish):
    z = linkage.linkage(x, method, finish_below=finish).orderBy("step").collect()
    assert [r.step for r in z] == list(range(len(points) - 1))
    assert np.allclose([r.height for r in z], greedy(dist(points), method), atol=1e-9)
    assert z[-1]["size"] == len(points)
    # every cluster is merged exactly once and only after it was formed
    used = [c for r in z for c in (r.a, r.b)]
    assert sorted(used) == list(range(2 * len(points) - 2))
    assert all(max(r.a, r.b) < len(points) + r.step for r in z)


@pytest.mark.parametrize("method", ["complete", "average", "weighted"])
def test_linkage_without_a_table_of_row_pairs(spark, points, x, method, monkeypatch):
    table, sizes = linkage._table_rounds, []

    def watched(pairs, *rest):
        sizes.append(pairs.count())
        return table(pairs, *rest)
    monkeypatch.setattr(linkage, "_table_rounds", watched)
    monkeypatch.setattr(linkage, "TABLE_PAIRS", 1)
    monkeypatch.setattr(linkage, "SMALL_TABLE", 0)
    monkeypatch.setattr(linkage, "PIECE_ROWS", 3)  # clusters that lie in pieces occur
    monkeypatch.setattr(pairwise, "TILE_ROWS", 16)
    z = linkage.linkage(x, method, finish_below=4).orderBy("step").collect()
    assert np.allclose([r.height for r in z], greedy(dist(points), method), atol=1e-9)
    assert max(sizes) <= len(points)
    used = [c for r in z for c in (r.a, r.b)]
    assert sorted(used) == list(range(2 * len(points) - 2))


def test_single_linkage_in_blocks(spark, x, monkeypatch):
    whole = linkage.linkage(x, "single").orderBy("step").collect()
    monkeypatch.setattr(linkage, "TREE_BLOCK", 12)
    assert linkage.linkage(x, "single").orderBy("step").collect() == whole


def test_spanning_tree_rounds(spark, points, x):
    for finish in (0, 256):
        tree = spanning.spanning_tree(x, finish_below=finish).collect()
        assert len(tree) == len(points) - 1
        assert np.allclose(sorted(r.d for r in tree), greedy(dist(points), "single"))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, k) for k in range(200, 230)]
    got = {r.id: r.comp for r in graph.components(
        spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100}
    assert {got[i] for i in [7, *range(200, 230)]} == {7}


def test_hierarchical_finds_the_groups(spark, x):
    assign, _ = linkage.hierarchical(x, 3, "ward")
    got = [r.cluster for r in assign.orderBy("row_id").collect()]
    assert got == [1] * 14 + [2] * 14 + [3] * 14


def test_dbscan(spark, points, x):
    eps, least = 1.0, 4
    near = dist(points) <= eps
    core = near.sum(1) >= least
    label, n = np.full(len(points), -1), 0
    for i in np.flatnonzero(core):
        if label[i] == -1:
            todo = [i]
            while todo:
                c = todo.pop()
                if label[c] == -1 or (label[c] == n and c == i):
                    label[c] = n
                    if core[c]:
                        todo += [j for j in np.flatnonzero(near[c]) if label[j] == -1]
            n += 1
    got = density.dbscan(x, eps, least).orderBy("row_id").collect()
    assert [r.is_core for r in got] == core.tolist()
    assert [r.cluster for r in got] == label.tolist()


def test_optics_walk_and_clusters(spark, points, x):
    d, least = dist(points), 4
    core = np.sort(d, 1)[:, least - 1]
    reach, seen, order = np.full(len(d), np.inf), np.zeros(len(d), bool), []
    for _ in range(len(d)):
        i = min(np.flatnonzero(~seen), key=lambda k: (reach[k], k))
        seen[i] = True
        order.append(i)
        reach = np.where(seen, reach, np.minimum(reach, np.maximum(core[i], d[i])))
    got = density.optics(x, least, 0.05, 0.1).orderBy("ord").collect()
    assert [r.row_id for r in got] == order
    assert np.allclose([r.reach for r in got], reach[order])
    assert np.allclose([r.core for r in got], core[order])
    groups = {r.row_id // 14: set() for r in got}
    for r in got:
        groups[r.row_id // 14].add(r.cluster)
    assert len({max(g) for g in groups.values()}) == 3


def test_silhouette_of_runs_matches_single(spark, x):
    named = x.withColumn("cluster", F.floor(F.col("row_id") / 14).cast("int"))
    one = evaluate.silhouette_points(named).agg(F.avg("s")).first()[0]
    both = named.withColumn("labels", F.array(F.col("row_id") % 2, F.col("cluster").cast("long")))
    runs = {r.run: r.s for r in evaluate.silhouettes_of_runs(both).groupBy("run").agg(
        F.avg("s").alias("s")).collect()}
    assert abs(runs[1] - one) < 1e-12 and runs[0] < one


def test_singleton_cluster_scores_zero(spark):
    df = rows_frame(spark, [[0.0], [1.0], [9.0]], cluster=[0, 0, 1])
    got = {r.row_id: r.s for r in evaluate.silhouette_points(df).collect()}
    assert got[2] == 0.0 and abs(got[0] - (9 - 1) / 9) < 1e-12


def test_pca_and_svd(spark, points, x):
    c = points - points.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    out = reduce.pca(x, 2)
    spectrum = out.spectrum.orderBy("k").collect()
    assert np.allclose([r.ratio for r in spectrum], (s ** 2 / (s ** 2).sum())[:2])
    e = np.array([r.e for r in out.embed.orderBy("row_id").collect()])
    assert np.allclose(np.abs(e), np.abs(u[:, :2] * s[:2]), atol=1e-8)
    load = out.components.filter("k = 1").orderBy("f").collect()
    assert max((r.loading for r in load), key=abs) > 0
    got = reduce.svd(x, 2).spectrum.orderBy("k").collect()
    assert np.allclose([r.value for r in got], np.linalg.svd(points)[1][:2])


def test_kmeans_keeps_the_best_run(spark, x):
    _, facts = kmeans.kmeans(x, 3, 3)
    assert facts["best_inertia"] == min(facts["run_inertia"])
    curve = kmeans.inertia_curve(x, 3)
    assert curve[0][1] > curve[1][1] > curve[2][1]
    assert model.optimal_k(x, 5).first()["silhouette_k"] == 3


def test_kmeans_runs_together_end_in_fixed_points(spark, points, x):
    """Each run alone gives what it gives among others, at any partitioning; its
    centres are the means of the rows nearest to them, and its inertia falls."""
    runs = [(1, 5), (3, 0), (3, 1), (6, 2)]
    fits = kmeans.fit_runs(x, runs)
    alone = kmeans.fit_runs(x.repartition(5), [(3, 1)])[0]
    assert np.allclose(alone.centres, fits[2].centres) and alone.n_iter == fits[2].n_iter
    spread = points.var(axis=0, ddof=1).mean()
    for (k, _), f in zip(runs, fits, strict=True):
        far = ((points[:, None] - f.centres[None]) ** 2).sum(2)
        near = far.argmin(1)
        means = np.array([points[near == c].mean(0) for c in range(k)])
        assert ((means - f.centres) ** 2).sum() <= 1e-4 * spread
        assert abs(f.inertia - far.min(1).sum()) < 1e-9 and len(f.series) == f.n_iter + 1
        assert all(a >= b - 1e-9 for a, b in zip(f.series, f.series[1:]))
    assert np.allclose(fits[0].centres, points.mean(0)) and abs(fits[0].inertia - kmeans.total_inertia(x).first()[0]) < 1e-9
    got = {r.row_id: r.labels for r in kmeans.labelled(x, fits).collect()}
    assert all(got[i][1] == ((points[i] - fits[1].centres) ** 2).sum(1).argmin() for i in got)
    # starts are rows, and lie apart: three far groups get a centre each
    assert len({tuple(np.round(c)) for c in fits[1].centres}) == 3


def test_kmeans_with_fewer_distinct_rows_than_clusters(spark):
    x = rows_frame(spark, np.repeat([[0.0, 1.0], [4.0, 1.0]], 5, axis=0))
    assign, facts = kmeans.kmeans(x, 4, 2)
    assert facts["best_inertia"] == 0 and facts["inertia_series"][-1] == 0 and len(facts["cluster_centers"]) == 4
    assert assign.select("cluster").distinct().count() == 2


def test_knee_of_a_bent_curve(spark):
    bent = [(0, k, float(100 - 20 * min(k, 5) - min(k - 5, 0) * 0 - max(k - 5, 0) * 0.1)) for k in range(2, 16)]
    flat = [(1, k, 1.0) for k in range(2, 6)]
    got = {r.series: r.knee for r in model.knee(
        spark.createDataFrame(bent + flat, "series int, k int, y double")).collect()}
    assert got[0] == 5


def test_layouts(spark, x):
    y, history = layout.mds(x, 2, max_iter=6, eps=0.0, settled=False)
    assert y.count() == 42 and all(a >= b - 1e-9 for a, b in zip(history, history[1:]))
    p = layout.joint_p(layout.conditional_p(x, 5.0), 42)
    assert abs(p.agg(F.sum("p")).first()[0] - 1) < 1e-9
    g = layout.fuzzy_graph(layout.local_scales(x, 6))
    lo, hi = g.agg(F.min("w"), F.max("w")).first()
    assert 0 < lo and hi <= 1 + 1e-12
    a = layout.umap(x, 2, 6, n_epochs=2)[0].orderBy("row_id").collect()
    b = layout.umap(x.repartition(3), 2, 6, n_epochs=2)[0].orderBy("row_id").collect()
    assert np.allclose([r.y for r in a], [r.y for r in b])
    y, kl = layout.tsne(x, 3, 5.0, n_iter=3)
    assert y.count() == 42 and kl > 0


@pytest.mark.parametrize("k", [1, 2])
def test_lattice_repulsion_against_all_pairs(k):
    rng = np.random.default_rng(0)
    for scale in (1e-4, 1.0, 20.0):
        lattice = tsne.Lattice(k)
        y = rng.normal(size=(500, k)) * scale
        nodes, charges = lattice.charges(y[200:])
        assert np.allclose(charges.sum(0)[:-1], [300, *y[200:].sum(0)])
        push, total = lattice.push(y[:200], nodes, charges)
        diff = y[:200, None] - y[None]
        q = 1 / (1 + (diff ** 2).sum(2))
        want = ((q * q)[:, :, None] * diff).sum(1)
        assert np.abs(push - want).max() < 0.02 * np.abs(want).max()
        everything = (1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))).sum() - 500
        assert abs(total / everything - 1) < 0.01


def plain_tsne(p, y, n_iter, exaggeration=12.0):
    """Exact gradient rounds over a dense matrix of weights; positions and divergence."""
    u, gain, rate = np.zeros_like(y), np.ones_like(y), max(len(y) / exaggeration / 4, 50.0)

    def near(y):
        diff = y[:, None] - y[None]
        q = 1 / (1 + (diff ** 2).sum(2))
        np.fill_diagonal(q, 0)
        return diff, q
    for t in range(n_iter):
        boost, momentum = (exaggeration, 0.5) if t < min(250, n_iter // 4) else (1.0, 0.8)
        diff, q = near(y)
        grad = 4 * (((boost * p - q / q.sum()) * q)[:, :, None] * diff).sum(1)
        gain = np.maximum(np.where(u * grad < 0, gain + 0.2, gain * 0.8), 0.01)
        u = momentum * u - rate * gain * grad
        y = y + u
    q = near(y)[1]
    linked = p > 0
    return y, float((p[linked] * np.log(p[linked] * q.sum() / q[linked])).sum())


def test_tsne_descends_like_exact_rounds(spark, x):
    """The same rounds in one block and in many; the divergence is that of the
    positions, and as low as exact gradients reach."""
    weights = np.zeros((42, 42))
    for r in layout.joint_p(layout.conditional_p(x, 5.0), 42).collect():
        weights[r.a, r.b] = r.p
    start = np.array([r.y for r in layout._start(x.select("row_id"), 2, 0, 1e-4).orderBy("row_id").collect()])
    found = {}
    for name, blocks in (("one", {}), ("many", {"block_rows": 9})):
        y, kl = layout.tsne(x, 2, 5.0, n_iter=8, **blocks)
        found[name] = np.array([r.y for r in y.orderBy("row_id").collect()])
    assert np.allclose(found["one"], found["many"], rtol=1e-6, atol=1e-9)
    # later on, small differences grow: few rows descend at a large rate
    y, _ = layout.tsne(x, 2, 5.0, n_iter=2)
    want, _ = plain_tsne(weights, start, 2)
    assert np.abs(np.array([r.y for r in y.orderBy("row_id").collect()]) - want).max() < 0.02 * np.abs(want).max()
    y, kl = layout.tsne(x, 2, 5.0, n_iter=300)
    at = np.array([r.y for r in y.orderBy("row_id").collect()])
    q = 1 / (1 + ((at[:, None] - at[None]) ** 2).sum(2))
    np.fill_diagonal(q, 0)
    linked = weights > 0
    assert abs(kl - (weights[linked] * np.log(weights[linked] * q.sum() / q[linked])).sum()) < 1e-9
    assert kl < plain_tsne(weights, start, 300)[1] * 1.1 + 0.02


def jobs_of(spark, name, run):
    """The result, and the number of Spark jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()


def test_a_tsne_round_between_blocks_is_one_job(spark, x, monkeypatch):
    """One job a round, and one more where the states are stored; storing them changes nothing."""
    p = layout.cut(layout.joint_p(layout.conditional_p(x, 5.0), 42))
    start = layout._start(x.select("row_id"), 2, 0, 1e-4)

    def positions(rounds, **blocks):
        y = layout.grid_layout(start, p, 42, 2, rounds, 12.0, **blocks)
        return np.array([r.y for r in y.orderBy("row_id").collect()])
    monkeypatch.setattr(tsne, "SETTLE", 3, raising=False)
    _, few = jobs_of(spark, "few", lambda: positions(2, block_rows=9))
    many, jobs = jobs_of(spark, "many", lambda: positions(9, block_rows=9))
    assert jobs - few <= 2 * 7
    assert np.allclose(many, positions(9), rtol=1e-6, atol=1e-9)


def plain_umap(spark, links, y, times, n_epochs, negatives=5):
    """Epochs over every link and its draws, one at a time; ``y`` and the number of rows by id."""
    n, links = sum(times.values()), list(links)
    for epoch in range(n_epochs):
        ends = spark.createDataFrame([(a, b, m) for a, b, _ in links for m in range(1, negatives + 1)],
                                     "a long, b long, m int").select(
            F.pmod(F.xxhash64("a", "b", "m", F.lit(0), F.lit(epoch)), F.lit(n)).alias("t")).toPandas()["t"]
        ends = ends.to_numpy().reshape(len(links), negatives)
        move = {r: np.zeros(2) for r in y}
        for (a, b, w), drawn in zip(links, ends):
            for t in (b, *drawn):
                if t == a or t not in y:
                    continue
                diff = y[a] - y[t]
                sq = (diff ** 2).sum()
                power = sq ** umap.CURVE_B
                if t is b:
                    coef = -2 * umap.CURVE_A * umap.CURVE_B * power / sq / (1 + umap.CURVE_A * power) if sq else 0.0
                else:
                    coef = 2 * umap.CURVE_B / ((0.001 + sq) * (1 + umap.CURVE_A * power))
                move[a] += times[a] * times[t] * np.clip(coef * w * diff, -4, 4)
        y = {r: y[r] + (1 - epoch / n_epochs) * move[r] for r in y}
    return y


def test_umap_epochs_over_blocks(spark, points, monkeypatch):
    """Every link and every draw counts, ids with gaps and rows that are there twice
    included, and an epoch takes less than two jobs."""
    monkeypatch.setattr(umap, "LEAST_ROWS", 9)
    for ids in (range(42), [*range(20), 30, 31, 31, *range(33, 52)]):
        x = rows_frame(spark, points[:42]).join(
            spark.createDataFrame(list(enumerate(ids)), "row_id long, id long"), "row_id").select(
            F.col("id").alias("row_id"), "v")
        times = {r: list(ids).count(r) for r in ids}
        start = {r.row_id: np.array(r.y) for r in layout._start(x.select("row_id"), 2, 0, 20.0).collect()}
        (y, graph), _ = jobs_of(spark, "first", lambda: layout.umap(x, 2, 6, n_epochs=7))
        edges = graph.collect()
        top = max(r.w for r in edges)
        links = [e for r in edges for e in ((r.i, r.j, r.w / top), (r.j, r.i, r.w / top))]
        want, got = plain_umap(spark, links, start, times, 7), y.collect()
        assert sorted(r.row_id for r in got) == sorted(ids)
        assert max(np.abs(np.array(r.y) - want[r.row_id]).max() for r in got) < 1e-7
    runs = [jobs_of(spark, f"umap {e}", lambda: layout.umap(x, 2, 6, n_epochs=e))[1] for e in (2, 12)]
    assert runs[1] - runs[0] < 2 * 10


def test_spectral(spark, points, x):
    emb, values = spectral.spectral_embedding(x, 2, 1.0, rounds=12, settled=False)
    w = np.exp(-dist(points) ** 2)
    r = 1 / np.sqrt(w.sum(1))
    want = np.linalg.eigvalsh(w * np.outer(r, r))[::-1][:2]
    assert np.allclose(values, want, atol=1e-3)
    assert emb.count() == 42


def test_linkage_over_matrix_rows_and_dendrogram(spark):
    beads = make_beads(spark, random_frames(2, (4, 4, 4)))
    from foldspark.plans.feature_matrix import dist_map
    square = dist_map(beads)
    z = analysis.matrix_linkage(square, "average").orderBy("step").collect()
    rows = []
    for k, xyz in sorted(random_frames(2, (4, 4, 4)).items()):
        rows.extend(dist(xyz))
    assert np.allclose([r.height for r in z], greedy(dist(np.array(rows)), "average"))
    z = analysis.dendrogram(beads, ["A", "B"], "weighted", norm="vc").collect()
    assert len(z) == 2


def test_sweep_scores_each_setting(spark):
    beads = make_beads(spark, random_frames(4, (4,) * 12))
    out = analysis.sweep(beads, ["A", "B"], ["euclidean"], ["vc", None], ["weighted"], ["svd"],
                         n_clusters=2, n_iterations=1).collect()
    assert {(r.metric, r.norm) for r in out} == {("euclidean", "vc"), ("euclidean", "none")}
    assert all(-1 <= r.silhouette <= 1 for r in out)


def _stored_columns(folder):
    """Columns of every stored table by its folder."""
    import glob
    import os

    import pyarrow.parquet as pq
    return {os.path.dirname(f): set(pq.read_schema(f).names) for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def test_settings_of_a_sweep_run_side_by_side_and_leave_no_x(spark, monkeypatch):
    """No setting gets past the meeting alone; its X is deleted after it."""
    import threading

    meeting, build = threading.Barrier(2), analysis.feature_matrix

    def met(*args, **options):
        meeting.wait(60)
        return build(*args, **options)
    monkeypatch.setattr(analysis, "feature_matrix", met)
    beads = make_beads(spark, random_frames(4, (4,) * 12))
    before = _stored_columns(session.shared_dir(spark))
    out = analysis.sweep(beads, ["A", "B"], ["euclidean"], ["vc", None], ["weighted"], ["svd", "pca"], n_clusters=2,
                         n_iterations=1)
    # in the order of the grid
    assert [(r.norm, r.technique) for r in out.collect()] == [
        (norm, method) for norm in ("vc", "none") for method in ("svd", "pca")]
    left = [c for folder, c in _stored_columns(session.shared_dir(spark)).items() if folder not in before]
    assert left and not any("v" in c for c in left)


def test_a_sweep_stops_at_a_setting_that_fails(spark):
    beads = make_beads(spark, random_frames(4, (4,) * 12))
    with pytest.raises(KeyError, match="unknown norm"):
        analysis.sweep(beads, ["A", "B"], ["euclidean"], ["other", None], ["weighted"], ["svd"], n_clusters=2)


def test_mds_leaves_only_positions(spark, x):
    before = _stored_columns(session.shared_dir(spark))
    layout.mds(x, 2)
    after = _stored_columns(session.shared_dir(spark))
    assert [c for folder, c in after.items() if folder not in before] == [{"row_id", "y"}]


def test_divergence_sums_each_pair_of_tiles_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    y, p = rng.normal(size=(70, 2)), rng.random((70, 70))
    np.fill_diagonal(p, 0.0)
    p = (p + p.T) / (p + p.T).sum()
    calls, reduce_pairs = [], layout.pair_reduce
    monkeypatch.setattr(layout, "pair_reduce", lambda x, kernel, schema, *args, **options: (
        calls.append((schema, options.get("both"))), reduce_pairs(x, kernel, schema, *args, **options))[1])
    found = layout.divergence_of(
        spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(y)], "row_id long, y array<double>"),
        spark.createDataFrame([(i, j, float(p[i, j])) for i in range(70) for j in range(70) if i != j],
                              "a long, b long, p double"), (70, 2))
    q = 1.0 / (1.0 + dist(y) ** 2)
    np.fill_diagonal(q, 0.0)
    q /= q.sum()
    some = p > 0
    assert np.isclose(found, (p[some] * np.log(p[some] / q[some])).sum())
    assert calls == [("row_id long, z double", True)]


def test_squares_of_narrow_rows_lose_no_digits():
    rng = np.random.default_rng(9)
    a, b = 1000.0 + rng.random((50, 2)), 1060.0 + rng.random((40, 2))
    want = ((a[:, None] - b[None]) ** 2).sum(2)
    assert np.abs(pairwise._block_squares(a, b) / want - 1.0).max() < 1e-15


def test_linkage_leaves_only_its_result(spark, tmp_path):
    import os

    from foldspark.operators import linkage

    def tables(folder):
        return {d for d, _, files in os.walk(folder) if any(f.endswith(".parquet") for f in files)}

    folder = session.shared_dir(spark)
    rows = rows_frame(spark, np.random.default_rng(3).normal(size=(60, 4)))
    for method in ("ward", "average"):
        before = tables(folder)
        linkage.merge_events(rows, method, finish_below=8).count()
        assert len(tables(folder) - before) == 1


def test_shared_folder_is_never_a_temporary_one(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == folder.rstrip("/")
    assert not hasattr(session, "tempfile")


@pytest.mark.parametrize("side", [1, 3, 8])
@pytest.mark.parametrize("feature_block", [2048, 3])
def test_super_blocks_meet_every_pair_once(spark, side, feature_block):
    points = np.random.default_rng(5).normal(size=(150, 7))
    x = rows_frame(spark, points)
    out = pairwise.pair_reduce(x, pairwise._all_pairs, "a long, b long, d double", tile_rows=16,
                               feature_block=feature_block, side=side).collect()
    want = dist(points)
    assert len(out) == 150 * 149 // 2 == len({(r.a, r.b) for r in out})
    assert np.allclose([r.d for r in out], [want[r.a, r.b] for r in out])
    near = pairwise.pair_reduce(x, pairwise._nearest_kernel(4, False), "a long, b long, d double", tile_rows=16,
                                feature_block=feature_block, side=side,
                                combine=pairwise.least_per(("a",), ("d", "b"), 4)).collect()
    supers = -(-pairwise.tile_count(150, spark.sparkContext.defaultParallelism, 16) // side)
    assert len(near) <= 150 * 4 * supers  # each super-block gives out four per row, not each tile


def test_a_tile_is_shuffled_once_per_super_block(spark):
    x = rows_frame(spark, np.random.default_rng(6).normal(size=(400, 3)))
    for tiles, side in ((12, 4), (13, 4), (9, 1)):
        copies = pairwise.scheduled(x, (), 3, tiles, side, True).groupBy("t").count().agg(F.max("count")).first()[0]
        assert copies <= tiles // side + 1


def test_registered_layouts_and_sweep_run_the_whole_job(monkeypatch):
    from foldspark import workload

    class Called(Exception):
        pass

    def spy(*args, **options):
        raise Called(args, options)
    monkeypatch.setattr(workload, "_rows", lambda spark, sf: None)
    monkeypatch.setattr(workload.tables, "beads", lambda spark, sf: None)
    monkeypatch.setattr(workload.session, "cut", lambda df: df)
    for module, name in ((layout, "tsne"), (layout, "umap"), (analysis, "sweep")):
        monkeypatch.setattr(module, name, spy)
    for name in ("red_tsne_layout", "red_umap_layout"):
        with pytest.raises(Called) as call:
            getattr(workload, name)(None, "")
        assert call.value.args == ((None, 2), {})
    with pytest.raises(Called) as call:
        workload.mdl_sweep(None, "")
    assert [len(set(grid)) for grid in call.value.args[0][2:6]] == [5, 4, 4, 5]


def _same_reduction(out, matrix, k):
    """Values, loadings up to their sign rule, and scores against numpy's."""
    _, s, vt = np.linalg.svd(matrix, full_matrices=False)
    v = vt[:k].T
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    loadings = out.components.toPandas().pivot(index="f", columns="k", values="loading").to_numpy()
    assert np.allclose(loadings, v, atol=1e-8)
    scores = [r["e"] for r in out.embed.orderBy("row_id").collect()]
    assert np.allclose(scores, matrix @ v, atol=1e-7)
    total = (matrix ** 2).sum()
    assert np.allclose([r["ratio"] for r in out.spectrum.orderBy("k").collect()], s[:k] ** 2 / total)


def test_reduction_of_more_columns_than_rows(spark):
    """Loadings of 5,000 columns come from three column blocks."""
    p = np.random.default_rng(3).normal(size=(30, 5000)) + 4.0
    out = reduce.pca(rows_frame(spark, p, cluster=["a"] * 30).repartition(3), 3)
    assert out.embed.columns == ["row_id", "cluster", "e"]
    _same_reduction(out, p - p.mean(0), 3)


def test_reduction_by_rounds_and_restarts(spark, monkeypatch):
    """Small blocks take several rounds, and a small limit restarts the basis."""
    for name, value in (("TILE_COLUMNS", 25), ("TILE_ROWS", 40), ("BLOCK", 8), ("LIMIT", 1), ("_FEW", 1)):
        monkeypatch.setattr(krylov, name, value)
    restarts = []
    extend = krylov._Basis.extend
    monkeypatch.setattr(krylov._Basis, "extend",
                        lambda self, width, turn: (restarts.append(turn is not None), extend(self, width, turn))[1])
    p = np.random.default_rng(4).normal(size=(150, 60)) * 1.12 ** np.arange(60)
    _same_reduction(reduce.svd(rows_frame(spark, p).repartition(3), 2), p, 2)
    assert any(restarts)


def test_reduction_of_low_rank_and_of_nothing(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 12))
    out = reduce.svd(rows_frame(spark, p), 5)
    assert out.spectrum.count() == 3
    _same_reduction(out, p, 3)
    same = reduce.pca(rows_frame(spark, np.full((6, 4), 2.5)), 2)
    assert same.spectrum.count() == same.components.count() == 0
    assert [r["e"] for r in same.embed.collect()] == [[]] * 6
    empty = reduce.pca(rows_frame(spark, np.ones((1, 4))).filter("row_id > 5"), 2)
    assert empty.embed.count() == empty.spectrum.count() == 0


def test_stored_tables_leave_no_shuffle_files(spark):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_")}
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before, kept = shuffles(), session.Rounds(spark)
    counted = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count()
    stored = session.cut(counted), kept.keep("t", counted)
    for _ in range(50):  # they go a moment later
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert [t.count() for t in stored] == [700, 700]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_super_blocks_grow_with_the_rows_and_are_dealt_out_evenly(spark):
    assert pairwise.side_of(601, 6, 64) == 60 and pairwise.side_of(601, 6) == 8 and pairwise.side_of(11, 6, 64) == 2
    rng = np.random.default_rng(21)
    x = rows_frame(spark, rng.normal(0, 1, (300, 4)))
    one = pairwise.pair_reduce(x, lambda a, b, d: {"n": np.array([len(a.ids) * len(b.ids)])}, "n long", tile_rows=16,
                               side=2)
    # ten sides of two tiles: 55 super-blocks, each its own task
    by_task = one.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("n").alias("n"))
    assert by_task.agg(F.sum("n")).first()[0] == 300 * 300
    sides = -(-pairwise.tile_count(300, spark.sparkContext.defaultParallelism, 16) // 2)
    assert by_task.count() == sides * (sides + 1) // 2


def test_squares_are_exact_in_strips_and_in_given_room():
    rng = np.random.default_rng(22)
    a, b = rng.normal(0, 1, (300, 7)), rng.normal(0, 1, (170, 7))
    b[5], b[9] = a[140], a[299] + 1e-9
    room = np.full(300 * 170 + 11, np.nan)
    want = ((a[:, None, :] - b[None, :, :]) ** 2).sum(2)
    for given in (None, room, room[:10]):
        got = pairwise._block_squares(a, b, given)
        assert np.allclose(got, want, rtol=1e-12, atol=0) and got[140, 5] == 0.0
    assert pairwise._block_squares(a, b[:0]).shape == (300, 0)
    whole = pairwise._block_squares(a, a)
    assert (whole == whole.T).all()
