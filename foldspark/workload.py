"""Registered queries: each applies one operator to the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark import session
from foldspark.functions.expressions import safe_divide
from foldspark.operators import (clean, density, distance, evaluate, graph, hic, kmeans, layout,
                                 linkage, model, normalise, pairwise, reduce, shape)
from foldspark.operators.prepare import PREPS
from foldspark.plans import analysis, report
from foldspark.plans import feature_matrix as fm
from foldspark.schemas import FRAME_KEY
from foldspark.sources import logs, matrices, sinks, tables, trajectories

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(session.tune(spark), sf_dir)
    QUERIES[fn.__name__] = run
    return fn


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, r6(c))
    return df


def reduce_frames(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def row_sums(x: DataFrame, *keep: str) -> DataFrame:
    """Plain, position-weighted and squared sums of each packed row."""
    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda acc, t: acc + t)
    return x.select(
        *keep, F.size("v").cast("long").alias("n"), r6(total(F.col("v"))).alias("s"),
        r6(total(F.transform("v", lambda t, k: t * (k + 1)))).alias("w"),
        r6(total(F.transform("v", lambda t: t * t))).alias("q"))


# ---- sources ---------------------------------------------------------------

@query
def src_replica_range(spark, sf):
    return rounded(trajectories.replica_range(tables.beads(spark, sf), 3, 7), "x", "y", "z")


@query
def src_stride(spark, sf):
    return rounded(trajectories.every_nth(tables.beads(spark, sf), 160), "x", "y", "z")


@query
def src_bead_selection(spark, sf):
    return rounded(trajectories.select_beads(
        tables.beads(spark, sf), tables.bead_types(spark, sf), "A2"), "x", "y", "z")


def _stored_beads(spark, sf) -> str:
    path = session.fresh_path(spark, "beads")
    sinks.write_beads(tables.beads(spark, sf), path)
    return path


@query
def src_registered_labels(spark, sf):
    path = _stored_beads(spark, sf)
    loaded = trajectories.load_beads(
        spark, {"first": f"{path}/label=A", "second": f"{path}/label=C"},
        replicas=(2, 9), stride=160)
    return rounded(loaded, "x", "y", "z")


@query
def src_matrix_text(spark, sf):
    contacts, width = tables.contacts_with_gaps(spark, sf), hic.map_width(tables.contacts(spark, sf))
    read = []
    for source in ("sim", "exp"):
        path = session.fresh_path(spark, "matrix")
        matrices.write_matrix(contacts.filter(F.col("source") == source), width, path)
        read.append(matrices.read_matrix(spark, path).select(
            F.lit(source).alias("source"), "i", "j", F.isnan("v").alias("missing"),
            F.nanvl("v", F.lit(0.0)).alias("v")))
    return reduce_frames(read)


@query
def src_log_scan(spark, sf):
    path = session.fresh_path(spark, "logs")
    logs.write_logs(tables.metrics_raw(spark, sf), path)
    entries = logs.scan(spark, path)
    return (entries.filter(F.col("entry").contains(logs.MARKER))
            .groupBy("technique").agg(F.count(F.lit(1)).alias("entries")))


# ---- sinks -----------------------------------------------------------------

@query
def snk_beads_roundtrip(spark, sf):
    path = _stored_beads(spark, sf)
    folders = {label: f"{path}/label={label}" for label in tables.LABELS}
    return rounded(trajectories.load_beads(spark, folders, replicas=(0, 100), stride=1), "x", "y", "z")


@query
def snk_matrix_reuse(spark, sf):
    root = session.fresh_path(spark, "x")
    version = sinks.input_version(tables.beads(spark, sf))
    key = sinks.fingerprint(tables.LABELS, version, metric="euclidean", norm="none", prep="weighted")
    sinks.materialised(spark, root, key,
                       lambda: fm.feature_matrix(tables.beads(spark, sf), tables.LABELS))

    def again():
        raise AssertionError("the stored table must be reused")
    return row_sums(sinks.materialised(spark, root, key, again), *FRAME_KEY, "row_id")


@query
def snk_metrics_append(spark, sf):
    path = session.fresh_path(spark, "metrics")
    summary = report.dedup(tables.metrics_raw(spark, sf))
    sinks.append_metrics(summary, path)
    sinks.append_metrics(summary, path, kind="clustering")
    sinks.append_metrics(summary, path, kind="clustering")
    return (spark.read.parquet(path).groupBy("kind", *report.KEYS)
            .agg(F.count(F.lit(1)).alias("n"), r6(F.max("ch")).alias("ch")))


@query
def snk_csv(spark, sf):
    path = session.fresh_path(spark, "summary")
    sinks.write_summary(report.dedup(tables.metrics_raw(spark, sf)), path)
    return rounded(sinks.read_summary(spark, path), "silhouette", "ch", "db")


# ---- shape -----------------------------------------------------------------

@query
def shp_pad_beads(spark, sf):
    return rounded(shape.pad_beads(tables.beads(spark, sf)), "x", "y", "z")


@query
def shp_pad_frames(spark, sf):
    return rounded(shape.pad_frames(tables.beads(spark, sf)), "x", "y", "z")


@query
def shp_pad_matrix(spark, sf):
    beads = tables.beads(spark, sf)
    width = fm.extent(beads)[0]
    padded = shape.pad_matrices(distance.distances(beads, "contact", square=True), width)
    return padded.groupBy(FRAME_KEY).agg(
        F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("v") == 0, 1)).alias("zeros"),
        r6(F.sum("v")).alias("total"))


@query
def shp_flatten(spark, sf):
    beads = tables.beads(spark, sf)
    return rounded(shape.flatten(distance.distances(beads, "euclidean"), fm.extent(beads)[0]), "v")


@query
def shp_stack(spark, sf):
    return shape.stack(tables.beads(spark, sf), ["C", "A", "D", "B"])


@query
def shp_square(spark, sf):
    return rounded(shape.square(distance.distances(tables.beads(spark, sf), "euclidean")), "v")


@query
def shp_symmetrise(spark, sf):
    contacts = tables.contacts(spark, sf)
    return hic.symmetrise(contacts, hic.map_width(contacts))


@query
def shp_rows(spark, sf):
    beads = tables.beads(spark, sf)
    return (shape.matrix_rows(distance.distances(beads, "euclidean", square=True))
            .groupBy(*FRAME_KEY, "row").agg(
                F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("v") * (F.col("f") + 1))).alias("w")))


# ---- filters, imputation, sampling -----------------------------------------

def _shown(df: DataFrame) -> DataFrame:
    """Finite values rounded, NaN as -1, huge values as -2 (they have no 6th decimal)."""
    v = F.col("v")
    return df.withColumn("v", F.when(F.isnan(v), F.lit(-1.0)).when(v > 1e300, F.lit(-2.0))
                         .otherwise(r6(v)))


@query
def flt_inf(spark, sf):
    dirty = tables.beads_with_gaps(spark, sf, infinite=True)
    return _shown(clean.clamp_infinite(distance.distances(dirty, "contact")))


@query
def flt_nan_mean(spark, sf):
    dirty = tables.beads_with_gaps(spark, sf)
    filled = clean.fill_label_mean(distance.distances(dirty, "euclidean", square=True), tables.LABELS)
    return rounded(filled.filter(F.col("i") < F.col("j")), "v")


def _bad_x(spark, sf) -> DataFrame:
    pairs = distance.distances(tables.beads_signed(spark, sf), "pearsons")
    return shape.flatten(normalise.log_transform(pairs), fm.extent(tables.beads(spark, sf))[0])


@query
def flt_final_fill(spark, sf):
    return rounded(clean.fill_bad_with_mean(_bad_x(spark, sf)), "v")


@query
def flt_minmax(spark, sf):
    return rounded(clean.scale_to_unit(_bad_x(spark, sf)), "v")


@query
def flt_finite_rows(spark, sf):
    dirty = tables.beads_with_gaps(spark, sf, infinite=True)
    rows = shape.matrix_rows(distance.distances(dirty, "euclidean", square=True))
    key = [*FRAME_KEY, "row"]
    return (clean.finite_rows(rows, key).groupBy(key)
            .agg(F.count(F.lit(1)).alias("n"), r6(F.sum("v")).alias("total")))


@query
def flt_cutoff(spark, sf):
    return clean.cutoff(tables.contacts(spark, sf), 60.0)


@query
def flt_nan_zero(spark, sf):
    return clean.nan_to_zero(tables.contacts_with_gaps(spark, sf))


@query
def flt_max_frames(spark, sf):
    return rounded(clean.first_frames(tables.beads(spark, sf), 500), "x", "y", "z")


@query
def flt_safe_divide(spark, sf):
    beads = tables.beads(spark, sf)
    return beads.select(*FRAME_KEY, "bead", r6(safe_divide(F.col("x"), F.col("z"))).alias("ratio"))


@query
def flt_bootstrap(spark, sf):
    drawn = clean.bootstrap(tables.features(spark, sf), 300, seed=42)
    total = F.aggregate("v", F.lit(0.0), lambda acc, t: acc + t)
    return drawn.select("draw", "row_id", "cluster", F.size("v").alias("width"), r6(total).alias("total"))


# ---- distances and norms ---------------------------------------------------

def _distance_query(name: str, metric: str, signed: bool = False) -> None:
    def run(spark, sf):
        beads = tables.beads_signed(spark, sf) if signed else tables.beads(spark, sf)
        return rounded(distance.distances(beads, metric), "v")
    run.__name__ = name
    query(run)


_distance_query("dst_euclidean", "euclidean")
_distance_query("dst_contact", "contact")
_distance_query("dst_log2_contact", "log2_contact", signed=True)
_distance_query("dst_pearson_cpu", "pearsons", signed=True)
_distance_query("dst_pearson_true", "pearsons_true", signed=True)
_distance_query("dst_spearman_cpu", "spearman", signed=True)
_distance_query("dst_spearman_true", "spearman_true", signed=True)


@query
def dst_map(spark, sf):
    return rounded(fm.dist_map(tables.beads(spark, sf), "B", "contact", "vc", max_frames=900), "v")


def _norm_query(name: str, norm: str, metric: str = "euclidean", **options) -> None:
    def run(spark, sf):
        square = distance.distances(tables.beads(spark, sf), metric, square=True)
        if norm in ("ice", "kr"):
            options["width"] = fm.extent(tables.beads(spark, sf))[0]
        return rounded(normalise.normalise(square, norm, **options), "v")
    run.__name__ = name
    query(run)


_norm_query("nrm_log", "log_transform")
_norm_query("nrm_vc", "vc")
_norm_query("nrm_ice", "ice")
_norm_query("nrm_kr", "kr", metric="contact")
_norm_query("nrm_ice_10", "ice", max_iter=10)
_norm_query("nrm_kr_10", "kr", metric="contact", max_iter=10)
_norm_query("nrm_ice_asymmetric", "ice", metric="spearman")


@query
def nrm_balanced(spark, sf):
    """Row sums of the balanced maps."""
    beads = tables.beads(spark, sf)
    square = distance.distances(beads, "euclidean", square=True)
    even = normalise.ice(square, max_iter=300, tol=1e-13, balanced=True, width=fm.extent(beads)[0])
    return even.groupBy(*FRAME_KEY, "i").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 3).alias("row_sum"))


# ---- preprocessing and the feature matrix ----------------------------------

def _matrix_query(name: str, **options) -> None:
    def run(spark, sf):
        # derived once; several passes read it
        beads = session.cut(tables.beads(spark, sf))
        x = fm.feature_matrix(beads, tables.LABELS, **options)
        return row_sums(x, *FRAME_KEY, "row_id")
    run.__name__ = name
    query(run)


_matrix_query("feature_matrix", metric="euclidean", norm="vc")
_matrix_query("pre_single", metric="contact", prep="single")
_matrix_query("pre_complete", metric="euclidean", norm="log_transform", prep="complete")
_matrix_query("pre_average", metric="log2_contact", prep="average")
_matrix_query("pre_chunked", metric="euclidean", prep="single", chunks=12)


# ---- Hi-C ------------------------------------------------------------------

def _hic(spark, sf, source):
    base = tables.contacts_with_gaps(spark, sf) if source == "exp" else tables.contacts(spark, sf)
    return base.filter(F.col("source") == source), hic.map_width(tables.contacts(spark, sf))


def _sim_map(spark, sf):
    contacts, width = _hic(spark, sf, "sim")
    return hic.simulation(contacts, width), width


def _exp_map(spark, sf, **options):
    contacts, width = _hic(spark, sf, "exp")
    return hic.experiment(contacts, width=width, **options), width


@query
def hic_simulation(spark, sf):
    return rounded(_sim_map(spark, sf)[0], "v")


@query
def hic_experiment(spark, sf):
    return rounded(_exp_map(spark, sf, cutoff=0.2)[0], "v")


@query
def hic_first(spark, sf):
    return rounded(_exp_map(spark, sf, norm="first")[0], "v")


@query
def hic_scaling(spark, sf):
    return rounded(hic.scaling(*_exp_map(spark, sf)), "mean", "std")


@query
def hic_composite(spark, sf):
    return rounded(hic.composite(_exp_map(spark, sf)[0], _sim_map(spark, sf)[0]), "v")


@query
def hic_composite_strict(spark, sf):
    return rounded(hic.composite(_exp_map(spark, sf)[0], _sim_map(spark, sf)[0], strict=True), "v")


@query
def hic_scaling_compare(spark, sf):
    return rounded(hic.compare_scaling(hic.scaling(*_exp_map(spark, sf)),
                                       hic.scaling(*_sim_map(spark, sf))), "exp", "sim")


@query
def hic_error_range(spark, sf):
    return rounded(hic.error_range(hic.scaling(*_sim_map(spark, sf))), "min_error", "max_error")


# ---- metrics report --------------------------------------------------------

def _logged(spark, sf) -> str:
    path = session.fresh_path(spark, "logs")
    logs.write_logs(tables.metrics_raw(spark, sf), path)
    return path


def _settings(df: DataFrame) -> DataFrame:
    return df.groupBy(report.KEYS).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("silhouette")).alias("silhouette"),
        r6(F.sum("ch")).alias("ch"), r6(F.sum("db")).alias("db"))


@query
def log_parse(spark, sf):
    return _settings(logs.parse(logs.scan(spark, _logged(spark, sf))))


@query
def log_parse_strict(spark, sf):
    return _settings(logs.parse(logs.scan(spark, _logged(spark, sf)), strict=True))


def _summary(spark, sf) -> DataFrame:
    return report.dedup(tables.metrics_raw(spark, sf))


@query
def log_dedup(spark, sf):
    return rounded(_summary(spark, sf), "silhouette", "ch", "db")


@query
def log_best(spark, sf):
    return rounded(report.best_rows(_summary(spark, sf)), "value")


@query
def log_pivot(spark, sf):
    cells = [f"{m}_{n}" for m in tables.METRICS for n in tables.NORMS]
    scores = [report.pivot_scores(tables.metrics_raw(spark, sf), s, cells).withColumn("score", F.lit(s))
              for s in ("silhouette", "ch", "db")]
    return rounded(reduce_frames(scores), *cells)


@query
def log_best_worst(spark, sf):
    return rounded(report.best_worst_cells(tables.metrics_raw(spark, sf)), "value")


@query
def log_normalise(spark, sf):
    return rounded(report.normalise_scores(_summary(spark, sf)), "silhouette", "ch", "db")


@query
def log_five_numbers(spark, sf):
    return rounded(report.five_numbers(_summary(spark, sf)), "low", "q1", "median", "q3", "high")


@query
def log_central(spark, sf):
    return rounded(report.central(_summary(spark, sf), "median"), "silhouette", "ch", "db")


@query
def log_central_mean(spark, sf):
    return rounded(report.central(_summary(spark, sf), "mean"), "silhouette", "ch", "db")


@query
def log_best_by_technique(spark, sf):
    return rounded(report.best_rows(report.normalise_scores(_summary(spark, sf)), True), "value")


@query
def log_distinct(spark, sf):
    return report.distinct_values(tables.metrics_raw(spark, sf), ["technique", "method"])


@query
def log_select(spark, sf):
    return rounded(report.select_scores(_summary(spark, sf), "db"), "db")


@query
def log_report(spark, sf):
    out = report.report(spark, _logged(spark, sf), session.fresh_path(spark, "summary"))
    return rounded(out["normalised"], "silhouette", "ch", "db")


# ---- row distances and reductions ------------------------------------------

def _rows(spark, sf) -> DataFrame:
    return tables.features(spark, sf).drop("cluster")


@query
def dst_rowpairs(spark, sf):
    return rounded(pairwise.row_pairs(_rows(spark, sf)), "d")


@query
def red_covariance(spark, sf):
    return rounded(reduce.covariance(_rows(spark, sf)), "cov")


@query
def red_variance_total(spark, sf):
    cov = reduce.covariance(_rows(spark, sf))
    return cov.filter("f = g").agg(r6(F.sum("cov")).alias("total"))


@query
def red_top_loadings(spark, sf):
    """Ten largest loadings of the first component."""
    return rounded(analysis.run_reduction("pca", _rows(spark, sf), 1)[1]["top_loadings"], "importance")


@query
def red_n95(spark, sf):
    """Features in order, weighted by their variance share, as a given spectrum."""
    cov = reduce.covariance(_rows(spark, sf)).filter("f = g")
    total = cov.agg(F.sum("cov").alias("t")).scalar()
    spectrum = cov.select((F.col("f") + 1).alias("k"), (F.col("cov") / total).alias("ratio"))
    return reduce.components_for(spectrum)


@query
def red_pca(spark, sf):
    out = reduce.pca(_rows(spark, sf), 3)
    return rounded(out.spectrum, "value", "ratio")


@query
def red_n_share(spark, sf):
    """Components that reach a twentieth of the variance, from the PCA spectrum."""
    return reduce.components_for(reduce.pca(_rows(spark, sf), 3).spectrum, 0.05)


@query
def red_pca_scores(spark, sf):
    return reduce.pca(_rows(spark, sf), 2).embed.select(
        "row_id", r6(F.element_at("e", 1)).alias("c1"), r6(F.element_at("e", 2)).alias("c2"))


@query
def red_svd(spark, sf):
    return rounded(reduce.svd(_rows(spark, sf), 3).spectrum, "value", "ratio")


@query
def red_pca_moments(spark, sf):
    """Sums of powers of all explained variances."""
    rows = _rows(spark, sf)
    value = F.col("value")
    return reduce.pca(rows, pairwise.shape_of(rows)[1]).spectrum.agg(
        r6(F.sum(value)).alias("m1"), r6(F.sum(value * value)).alias("m2"),
        r6(F.sum(value * value * value)).alias("m3"))


@query
def red_svd_moments(spark, sf):
    rows = _rows(spark, sf)
    square = F.col("value") * F.col("value")
    return reduce.svd(rows, pairwise.shape_of(rows)[1]).spectrum.agg(
        F.round(F.sum(square), 4).alias("m1"), F.round(F.sum(square * square), 4).alias("m2"))


@query
def red_pca_norms(spark, sf):
    """Scores on all components keep each centred row's length."""
    rows = _rows(spark, sf)
    embed = reduce.pca(rows, pairwise.shape_of(rows)[1]).embed
    return embed.select("row_id", r6(F.aggregate(
        "e", F.lit(0.0), lambda acc, t: acc + t * t)).alias("norm"))


@query
def red_knn(spark, sf):
    return rounded(pairwise.nearest(_rows(spark, sf), 5), "d")


@query
def red_tsne_p_rows(spark, sf):
    """Neighbours, total weight and perplexity of each row."""
    p = layout.conditional_p(_rows(spark, sf), 30.0)
    return p.groupBy(F.col("a").alias("row_id")).agg(
        F.count("p").alias("neighbours"), F.round(F.sum("p"), 6).alias("total"),
        F.round(F.exp(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))), 3)
        .alias("perplexity"))


@query
def red_tsne_joint(spark, sf):
    """The joint weights add up to 1 and are symmetric."""
    rows = _rows(spark, sf)
    p = layout.joint_p(layout.conditional_p(rows, 30.0), rows.count())
    return p.agg(F.round(F.sum("p"), 6).alias("total"),
                 F.round(F.sum(F.when(F.col("a") < F.col("b"), F.col("p")).otherwise(-F.col("p"))), 6)
                 .alias("skew"))


@query
def red_umap_rho(spark, sf):
    """Nearest positive distance and total weight log2(15) of each row."""
    gap = F.greatest(F.col("d") - F.col("rho"), F.lit(0.0))
    return layout.local_scales(_rows(spark, sf), 15).groupBy(F.col("a").alias("row_id")).agg(
        r6(F.max("rho")).alias("rho"), F.round(F.sum(F.exp(-gap / F.col("sigma"))), 3).alias("total"))


@query
def red_umap_graph(spark, sf):
    graph_ = layout.fuzzy_graph(layout.local_scales(_rows(spark, sf), 15))
    return graph_.select("i", "j", F.round("w", 4).alias("w"))


@query
def red_mds_stress(spark, sf):
    y, history = layout.mds(_rows(spark, sf), 2)
    return y.select("row_id", F.lit(history[-1]).alias("stress"),
                    F.element_at("y", 1).alias("c1"), F.element_at("y", 2).alias("c2"))


@query
def red_tsne_layout(spark, sf):
    y, divergence = layout.tsne(_rows(spark, sf), 2)
    return y.select("row_id", F.lit(divergence).alias("divergence"),
                    F.element_at("y", 1).alias("c1"), F.element_at("y", 2).alias("c2"))


@query
def red_umap_layout(spark, sf):
    y, _ = layout.umap(_rows(spark, sf), 2)
    return y.select("row_id", F.element_at("y", 1).alias("c1"), F.element_at("y", 2).alias("c2"))


# ---- clustering ------------------------------------------------------------

@query
def clu_inertia_k1(spark, sf):
    return rounded(kmeans.total_inertia(_rows(spark, sf)), "inertia")


@query
def clu_kmeans(spark, sf):
    assign, facts = kmeans.kmeans(_rows(spark, sf), 5)
    return assign.select("row_id", "cluster", F.lit(facts["best_inertia"]).alias("inertia"))


@query
def clu_elbow(spark, sf):
    return spark.createDataFrame(kmeans.inertia_curve(_rows(spark, sf), 10), "k int, inertia double")


@query
def clu_spectral(spark, sf):
    return analysis.run_clustering("spectral", _rows(spark, sf), 5, 2)[0]


@query
def clu_dbscan(spark, sf):
    return density.dbscan(_rows(spark, sf), 1.16, 5)


@query
def clu_core_distance(spark, sf):
    return rounded(pairwise.core_distances(_rows(spark, sf), 5), "core")


@query
def clu_optics(spark, sf):
    out = density.optics(_rows(spark, sf), min_samples=5, xi=0.01, min_cluster_size=0.02)
    return out.select("row_id", "cluster", "ord", "pred", r6("core").alias("core"),
                      F.when(F.col("reach") < 1e300, r6("reach")).alias("reach"))


@query
def clu_optics_order(spark, sf):
    out = density.optics_order(_rows(spark, sf), min_samples=5)
    return out.select("row_id", "ord", F.when(F.col("reach") < 1e300, r6("reach")).alias("reach"),
                      r6("core").alias("core"))


@query
def clu_single_cut(spark, sf):
    """Components of the single-linkage tree below a height."""
    rows = _rows(spark, sf)
    events = linkage.merge_events(rows, "single").filter(F.col("height") <= 1.1)
    comp = graph.components(events.select("a", "b")).withColumnRenamed("id", "row_id")
    return rows.select("row_id").join(comp, "row_id", "left").select(
        "row_id", F.coalesce("comp", "row_id").alias("cluster"))


@query
def clu_hierarchical(spark, sf):
    return linkage.hierarchical(_rows(spark, sf), 5, "ward")[0]


def _linkage_query(method: str) -> None:
    def run(spark, sf):
        return rounded(linkage.linkage(_rows(spark, sf), method), "height")
    run.__name__ = f"lnk_{method}"
    query(run)


for _method in linkage.METHODS:
    _linkage_query(_method)


@query
def lnk_single_heights(spark, sf):
    return rounded(linkage.linkage(_rows(spark, sf), "single").select("step", "height"), "height")


@query
def lnk_truncated(spark, sf):
    return rounded(linkage.truncated(linkage.linkage(_rows(spark, sf), "ward"), 10), "height")


# ---- evaluation and model selection ----------------------------------------

@query
def evl_silhouette(spark, sf):
    points = evaluate.silhouette_points(tables.features(spark, sf))
    return points.agg(r6(F.avg("s")).alias("silhouette"))


@query
def evl_silhouette_points(spark, sf):
    return rounded(evaluate.silhouette_series(tables.features(spark, sf)), "s")


@query
def evl_ch(spark, sf):
    return rounded(evaluate.calinski_harabasz(tables.features(spark, sf)), "ch")


@query
def evl_db(spark, sf):
    return rounded(evaluate.davies_bouldin(tables.features(spark, sf)), "db")


@query
def evl_scores(spark, sf):
    return rounded(evaluate.evaluate(tables.features(spark, sf)), "silhouette", "ch", "db")


@query
def evl_sizes(spark, sf):
    return evaluate.sizes(tables.features(spark, sf))


@query
def evl_core_counts(spark, sf):
    return evaluate.core_counts(density.dbscan(_rows(spark, sf), 1.16, 5))


@query
def evl_contingency(spark, sf):
    named = tables.features(spark, sf).withColumn(
        "label", F.element_at(F.array(*[F.lit(l) for l in tables.LABELS]),
                              (F.col("row_id") % 4 + 1).cast("int")))
    return evaluate.contingency(named)


@query
def evl_reachability(spark, sf):
    out = density.reachability(density.optics_order(_rows(spark, sf), 5), by_order=True)
    return out.withColumn("reach", F.when(F.col("reach") < 1e300, r6("reach")))


@query
def mdl_knee(spark, sf):
    return model.knee(tables.curve(spark, sf))


@query
def mdl_kde(spark, sf):
    """Densities along both components of a reduction."""
    embed = session.cut(analysis.run_reduction("pca", tables.features(spark, sf), 2)[0])
    drawn = [model.kde(embed.withColumn("c", F.element_at("e", k)), "c").withColumn("k", F.lit(k))
             for k in (1, 2)]
    return rounded(reduce_frames(drawn), "at", "density")


@query
def mdl_optimal_k(spark, sf):
    return model.optimal_k(_rows(spark, sf))


@query
def mdl_score_embedding(spark, sf):
    embed = session.cut(analysis.run_reduction("svd", _rows(spark, sf), 2)[0])
    return analysis.score_embedding(embed, "kmeans", 5)[1]


@query
def mdl_sweep(spark, sf):
    """The whole grid."""
    return analysis.sweep(session.cut(tables.beads(spark, sf)), tables.LABELS, tables.METRICS, tables.NORMS,
                          list(PREPS), list(analysis.REDUCTIONS), n_clusters=4)
