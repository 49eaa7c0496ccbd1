"""DuckDB statements with the results the registered queries must give."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

KEY = "label, replica, frame"


def r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def keyed(*aliases: str) -> str:
    """Equality of the frame key between two aliases."""
    a, b = aliases
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in ("label", "replica", "frame"))


BEADS = """beads AS (
  SELECT chr(65 + CAST(l_orderkey % 4 AS INTEGER)) AS label,
         CAST((l_orderkey // 4) % 20 + 1 AS INTEGER) AS replica, l_orderkey AS frame,
         CAST((l_linenumber - 1) * 2 + l_suppkey % 2 AS INTEGER) AS bead,
         max(l_quantity) AS x, max(l_extendedprice) / 1000 AS y, 100 * max(l_discount + 0.0) AS z
  FROM lineitem GROUP BY ALL)"""
SIGNED = "signed AS (SELECT label, replica, frame, bead, x - 25 AS x, y - 50 AS y, z - 5 AS z FROM beads)"
GAPS = """gaps AS (SELECT label, replica, frame, bead,
  CASE WHEN bead = 3 AND frame % 7 = 0 THEN 'NaN'::DOUBLE ELSE x END AS x, y, z FROM beads)"""
GAPS_INF = """gaps AS (SELECT label, replica, frame, bead,
  CASE WHEN bead = 3 AND frame % 7 = 0 THEN 'NaN'::DOUBLE
       WHEN bead = 2 AND frame % 11 = 0 THEN 'Infinity'::DOUBLE ELSE x END AS x, y, z FROM beads)"""
XYZ = f"{r6('x')} AS x, {r6('y')} AS y, {r6('z')} AS z"
WIDTH = "w AS (SELECT max(bead) + 1 AS n FROM beads)"

_LOG = "CASE WHEN {0} + 2.220446049250313e-16 > 0 THEN log2({0} + 2.220446049250313e-16) ELSE 0.0 END"
_MEAN = "(({0}.x + {0}.y + {0}.z) / 3)"
_STD = ("sqrt((({0}.x - {1}) * ({0}.x - {1}) + ({0}.y - {1}) * ({0}.y - {1})"
        " + ({0}.z - {1}) * ({0}.z - {1})) / 3)")


def _centred(t: str, c: str) -> str:
    m = _MEAN.format(t)
    s = _STD.format(t, m)
    return f"(CASE WHEN {s} <> 0 THEN ({t}.{c} - {m}) / {s} ELSE 0.0 END)"


def _rank(t: str, c: str) -> str:
    """0-based rank of a coordinate, ties in axis order."""
    terms = []
    for o in "xyz":
        if o != c:
            terms.append(f"({t}.{o} {'<=' if o < c else '<'} {t}.{c})::INTEGER")
    return f"({' + '.join(terms)})::DOUBLE"


def _metric(name: str) -> str:
    if name == "euclidean":
        return "sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"
    if name == "contact":
        return "abs(a.x-b.x) + abs(a.y-b.y) + abs(a.z-b.z)"
    if name == "log2_contact":
        return " + ".join(f"abs({_LOG.format('a.' + c)} - {_LOG.format('b.' + c)})" for c in "xyz")
    if name == "pearsons":
        return "1 - (" + " + ".join(f"{_centred('a', c)} * b.{c}" for c in "xyz") + ") / 3"
    if name == "pearsons_true":
        return "1 - (" + " + ".join(f"{_centred('a', c)} * {_centred('b', c)}" for c in "xyz") + ") / 3"
    if name == "spearman":
        return "1 - (" + " + ".join(f"{_rank('a', c)} * b.{c}" for c in "xyz") + ") / 3"
    if name == "spearman_true":
        return "1 - (" + " + ".join(f"({_rank('a', c)} - 1) * ({_rank('b', c)} - 1)" for c in "xyz") + ") / 2"
    raise KeyError(name)


ASYMMETRIC = ("pearsons", "spearman")


def pairs(metric: str, source: str = "beads", square: bool = False, name: str = "pairs") -> str:
    """CTE of per-frame distances."""
    value = _metric(metric)
    if metric in ASYMMETRIC:
        where = ""
    elif square:
        where = ""
        value = f"CASE WHEN a.bead = b.bead THEN 0.0 ELSE {value} END"
    else:
        where = "WHERE a.bead < b.bead"
    return f"""{name} AS (SELECT a.label, a.replica, a.frame, a.bead AS i, b.bead AS j, {value} AS v
  FROM {source} a JOIN {source} b ON {keyed('a', 'b')} {where})"""


F_INDEX = "CAST(i AS BIGINT) * n - CAST(i AS BIGINT) * (i + 1) // 2 + (j - i - 1)"
FLOG = "CASE WHEN v > -1 THEN log2(v + 1) WHEN v = -1 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END"
VC = (f"CASE WHEN sum(v) OVER (PARTITION BY {KEY}, i) <> 0 "
      f"THEN v / sum(v) OVER (PARTITION BY {KEY}, i) ELSE 0.0 END")

# ---- sources and sinks -----------------------------------------------------

ORACLES["src_replica_range"] = f"""WITH {BEADS}
SELECT {KEY}, bead, {XYZ} FROM beads WHERE replica BETWEEN 3 AND 7"""
ORACLES["src_stride"] = f"""WITH {BEADS},
f AS (SELECT label, replica, min(frame) AS first FROM beads GROUP BY ALL)
SELECT {KEY}, bead, {XYZ} FROM beads JOIN f USING (label, replica) WHERE (frame - first) % 160 = 0"""
ORACLES["src_bead_selection"] = f"""WITH {BEADS},
sel AS (SELECT label, bead, CAST(row_number() OVER (PARTITION BY label ORDER BY bead) - 1 AS INTEGER) AS pos
        FROM (SELECT DISTINCT label, bead FROM beads WHERE bead % 3 = 1))
SELECT {KEY}, sel.pos AS bead, {XYZ} FROM beads JOIN sel USING (label, bead)"""
ORACLES["src_registered_labels"] = f"""WITH {BEADS},
picked AS (SELECT CASE label WHEN 'A' THEN 'first' ELSE 'second' END AS label, replica, frame, bead, x, y, z
           FROM beads WHERE label IN ('A', 'C') AND replica BETWEEN 2 AND 9),
f AS (SELECT label, replica, min(frame) AS first FROM picked GROUP BY ALL)
SELECT {KEY}, bead, {XYZ} FROM picked JOIN f USING (label, replica) WHERE (frame - first) % 160 = 0"""
ORACLES["snk_beads_roundtrip"] = f"WITH {BEADS} SELECT {KEY}, bead, {XYZ} FROM beads"

CONTACTS = """n AS (SELECT max(l_suppkey) + 1 AS n FROM lineitem),
contacts AS (
  SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'sim' ELSE 'exp' END AS source,
         CAST(l_suppkey AS INTEGER) AS i, CAST(l_partkey % n.n AS INTEGER) AS j, sum(l_quantity) AS v
  FROM lineitem, n GROUP BY ALL)"""
CONTACT_GAPS = """gaps AS (SELECT source, i, j,
  CASE WHEN (i + j) % 17 = 0 THEN 'NaN'::DOUBLE ELSE v END AS v FROM contacts)"""
CWIDTH = "cw AS (SELECT max(greatest(i, j)) + 1 AS width FROM contacts)"
AXIS = "axis AS (SELECT CAST(unnest(range(width)) AS INTEGER) AS k FROM cw)"

ORACLES["src_matrix_text"] = f"""WITH {CONTACTS}, {CONTACT_GAPS}, {CWIDTH}, {AXIS}
SELECT s.source, a.k AS i, b.k AS j, coalesce(isnan(v), false) AS missing,
       CASE WHEN isnan(v) THEN 0.0 ELSE coalesce(v, 0.0) END AS v
FROM (VALUES ('sim'), ('exp')) s(source) CROSS JOIN axis a CROSS JOIN axis b
LEFT JOIN gaps ON gaps.source = s.source AND gaps.i = a.k AND gaps.j = b.k"""

METRICS_RAW = """metrics AS (
  SELECT ['MDS', 'PCA', 'SVD', 't-sne', 'UMAP'][CAST(l_partkey % 5 + 1 AS INTEGER)] AS technique,
         ['single', 'weighted', 'complete', 'average'][CAST(l_suppkey % 4 + 1 AS INTEGER)] AS method,
         ['contact', 'euclidean', 'log2_contact', 'pearsons', 'spearman'][CAST(l_orderkey % 5 + 1 AS INTEGER)] AS metric,
         ['log_transform', 'vc', 'kr', 'ice'][CAST(l_linenumber % 4 + 1 AS INTEGER)] AS norm,
         l_extendedprice % 700 / 350 - 1 AS silhouette, l_extendedprice / 97 AS ch,
         l_extendedprice % 90 / 7 + l_tax AS db
  FROM lineitem)"""
DEDUP = """summary AS (SELECT technique, method, metric, norm, avg(silhouette) AS silhouette,
  avg(ch) AS ch, avg(db) AS db FROM metrics GROUP BY ALL)"""
KEYS4 = "technique, method, metric, norm"
SCORES3 = f"{r6('silhouette')} AS silhouette, {r6('ch')} AS ch, {r6('db')} AS db"

ORACLES["src_log_scan"] = f"""WITH {METRICS_RAW}
SELECT technique, count(*) AS entries FROM metrics GROUP BY ALL"""
ORACLES["snk_metrics_append"] = f"""WITH {METRICS_RAW}, {DEDUP}
SELECT kind, {KEYS4}, n, {r6('ch')} AS ch FROM summary,
  (VALUES ('reduction', 1::BIGINT), ('clustering', 2::BIGINT)) k(kind, n)"""
ORACLES["snk_csv"] = f"WITH {METRICS_RAW}, {DEDUP} SELECT {KEYS4}, {SCORES3} FROM summary"

# ---- shape -----------------------------------------------------------------

ORACLES["shp_pad_beads"] = f"""WITH {BEADS},
top AS (SELECT label, max(bead) AS top FROM beads GROUP BY ALL),
grid AS (SELECT {KEY}, CAST(unnest(range(top + 1)) AS INTEGER) AS bead
         FROM (SELECT DISTINCT {KEY} FROM beads) JOIN top USING (label))
SELECT {KEY}, bead, {r6('coalesce(x, 0.0)')} AS x, {r6('coalesce(y, 0.0)')} AS y,
       {r6('coalesce(z, 0.0)')} AS z
FROM grid LEFT JOIN beads USING ({KEY}, bead)"""
ORACLES["shp_pad_frames"] = f"""WITH {BEADS},
per AS (SELECT label, replica, count(DISTINCT frame) AS n, max(frame) AS last FROM beads GROUP BY ALL),
most AS (SELECT label, max(n) AS most FROM per GROUP BY ALL),
top AS (SELECT label, max(bead) AS top FROM beads GROUP BY ALL),
ghost AS (SELECT label, replica, top, last + unnest(range(1, most - n + 1)) AS frame
          FROM per JOIN most USING (label) JOIN top USING (label))
SELECT {KEY}, bead, {XYZ} FROM beads
UNION ALL SELECT label, replica, frame, CAST(unnest(range(top + 1)) AS INTEGER), 0.0, 0.0, 0.0 FROM ghost"""
ORACLES["shp_pad_matrix"] = f"""WITH {BEADS}, {WIDTH}, {pairs('contact')},
ax AS (SELECT CAST(unnest(range(n)) AS INTEGER) AS k FROM w),
grid AS (SELECT {KEY}, p.k AS i, q.k AS j FROM (SELECT DISTINCT {KEY} FROM beads), ax p, ax q WHERE p.k < q.k)
SELECT {KEY}, count(*) AS cells, count(*) FILTER (coalesce(v, 0.0) = 0) AS zeros,
       {r6('sum(coalesce(v, 0.0))')} AS total
FROM grid LEFT JOIN pairs USING ({KEY}, i, j) GROUP BY ALL"""
ORACLES["shp_flatten"] = f"""WITH {BEADS}, {WIDTH}, {pairs('euclidean')}
SELECT {KEY}, {F_INDEX} AS f, {r6('v')} AS v FROM pairs, w"""
ORACLES["shp_stack"] = f"""WITH {BEADS}
SELECT {KEY}, row_number() OVER (ORDER BY CASE label WHEN 'C' THEN 0 WHEN 'A' THEN 1 WHEN 'D' THEN 2 ELSE 3 END, replica, frame) - 1 AS row_id
FROM (SELECT DISTINCT {KEY} FROM beads)"""
ORACLES["shp_square"] = f"""WITH {BEADS}, {pairs('euclidean')}
SELECT {KEY}, i, j, {r6('v')} AS v FROM pairs
UNION ALL SELECT {KEY}, j, i, {r6('v')} FROM pairs
UNION ALL SELECT DISTINCT {KEY}, k, k, 0.0 FROM (SELECT {KEY}, i AS k FROM pairs UNION ALL SELECT {KEY}, j FROM pairs)"""
ORACLES["shp_symmetrise"] = f"""WITH {CONTACTS}, {CWIDTH}, {AXIS}
SELECT source, i, j, v FROM contacts WHERE i < j
UNION ALL SELECT source, j, i, v FROM contacts WHERE i < j
UNION ALL SELECT source, k, k, 1.0 FROM axis, (SELECT DISTINCT source FROM contacts)"""
ORACLES["shp_rows"] = f"""WITH {BEADS}, {pairs('euclidean', square=True)}
SELECT {KEY}, i AS row, count(*) AS n, {r6('sum(v * (j + 1))')} AS w FROM pairs GROUP BY ALL"""

# ---- filters ---------------------------------------------------------------

_SHOWN = f"CASE WHEN isnan(v) THEN -1.0 WHEN v > 1e300 THEN -2.0 ELSE {r6('v')} END"
ORACLES["flt_inf"] = f"""WITH {BEADS}, {GAPS_INF}, {pairs('contact', 'gaps')},
c AS (SELECT {KEY}, i, j, CASE WHEN isinf(v) THEN 1.7976931348623157e308 / 2 ELSE v END AS v FROM pairs)
SELECT {KEY}, i, j, {_SHOWN} AS v FROM c"""
ORACLES["flt_nan_mean"] = f"""WITH {BEADS}, {GAPS}, {pairs('euclidean', 'gaps', square=True)},
m AS (SELECT label, avg(v) FILTER (NOT isnan(v)) AS m FROM pairs GROUP BY ALL)
SELECT {KEY}, i, j, {r6('CASE WHEN isnan(v) THEN m ELSE v END')} AS v
FROM pairs JOIN m USING (label) WHERE i < j"""
_BAD_X = f"""{BEADS}, {SIGNED}, {WIDTH}, {pairs('pearsons', 'signed')},
x AS MATERIALIZED (SELECT {KEY}, {F_INDEX} AS f, {FLOG} AS v FROM pairs, w WHERE i < j)"""
ORACLES["flt_final_fill"] = f"""WITH {_BAD_X},
m AS (SELECT avg(v) FILTER (NOT isnan(v)) AS m FROM x)
SELECT {KEY}, f, {r6('CASE WHEN isnan(v) OR isinf(v) THEN m ELSE v END')} AS v,
       isnan(v) OR isinf(v) AS was_bad FROM x, m"""
ORACLES["flt_minmax"] = f"""WITH {_BAD_X},
m AS (SELECT avg(v) AS m, min(v) AS lo, max(v) AS hi FROM x WHERE isfinite(v))
SELECT {KEY}, f, {r6('((CASE WHEN isfinite(v) THEN v ELSE m END) - lo) / (hi - lo)')} AS v FROM x, m"""
ORACLES["flt_finite_rows"] = f"""WITH {BEADS}, {GAPS_INF}, {pairs('euclidean', 'gaps', square=True)}
SELECT {KEY}, i AS row, count(*) AS n, {r6('sum(v)')} AS total FROM pairs
GROUP BY ALL HAVING bool_and(isfinite(v))"""
ORACLES["flt_cutoff"] = f"""WITH {CONTACTS}
SELECT source, i, j, CASE WHEN v < 60 THEN 0.0 ELSE v END AS v FROM contacts"""
ORACLES["flt_nan_zero"] = f"""WITH {CONTACTS}, {CONTACT_GAPS}
SELECT source, i, j, CASE WHEN isnan(v) THEN 0.0 ELSE v END AS v FROM gaps"""
ORACLES["flt_max_frames"] = f"""WITH {BEADS},
f AS (SELECT {KEY}, row_number() OVER (PARTITION BY label ORDER BY replica, frame) AS n
      FROM (SELECT DISTINCT {KEY} FROM beads))
SELECT {KEY}, bead, {XYZ} FROM beads JOIN f USING ({KEY}) WHERE n <= 500"""
ORACLES["flt_safe_divide"] = f"""WITH {BEADS}
SELECT {KEY}, bead, {r6('CASE WHEN z <> 0 THEN x / z ELSE 0.0 END')} AS ratio FROM beads"""
ORACLES["flt_bootstrap"] = f"""WITH d AS (
  SELECT range AS draw, CAST('0x' || substr(md5(range || '-42'), 1, 12) AS BIGINT)
         % (SELECT count(*) FROM embeddings) AS row_id FROM range(300))
SELECT draw, row_id, label AS cluster, len(embedding) AS width,
  {r6('list_sum([x::DOUBLE FOR x IN embedding])')} AS total
FROM d JOIN embeddings ON vec_id = row_id"""

# ---- distances and norms ---------------------------------------------------

for _name, _m, _src in [
        ("dst_euclidean", "euclidean", "beads"), ("dst_contact", "contact", "beads"),
        ("dst_log2_contact", "log2_contact", "signed"), ("dst_pearson_cpu", "pearsons", "signed"),
        ("dst_pearson_true", "pearsons_true", "signed"), ("dst_spearman_cpu", "spearman", "signed"),
        ("dst_spearman_true", "spearman_true", "signed")]:
    ORACLES[_name] = f"""WITH {BEADS}, {SIGNED}, {pairs(_m, _src)}
SELECT {KEY}, i, j, {r6('v')} AS v FROM pairs"""
ORACLES["dst_map"] = f"""WITH {BEADS},
f AS (SELECT {KEY}, row_number() OVER (ORDER BY replica, frame) AS n
      FROM (SELECT DISTINCT {KEY} FROM beads WHERE label = 'B')),
kept AS (SELECT beads.* FROM beads JOIN f USING ({KEY}) WHERE n <= 900),
{pairs('contact', 'kept', square=True)}
SELECT {KEY}, i, j, {r6(VC)} AS v FROM pairs"""
ORACLES["nrm_log"] = f"""WITH {BEADS}, {pairs('euclidean', square=True)}
SELECT {KEY}, i, j, {r6(FLOG)} AS v FROM pairs"""
ORACLES["nrm_vc"] = f"""WITH {BEADS}, {pairs('euclidean', square=True)}
SELECT {KEY}, i, j, {r6(VC)} AS v FROM pairs"""


def balancing(metric: str, rounds: int, tol: float = 1e-5) -> str:
    """The balancing recurrence unrolled; a frame stops once its bias settles."""
    ctes = [BEADS, pairs(metric, square=True).replace("pairs AS (", "pairs AS MATERIALIZED ("),
            f"b0 AS MATERIALIZED (SELECT DISTINCT {KEY}, i, 1.0::DOUBLE AS b, false AS done FROM pairs)"]
    for t in range(rounds):
        ctes.append(f"""r{t} AS (SELECT p.label, p.replica, p.frame, p.i, sum(p.v / bj.b) AS r
  FROM pairs p JOIN b{t} bj ON {keyed('p', 'bj')} AND p.j = bj.i GROUP BY ALL),
c{t} AS (SELECT p.label, p.replica, p.frame, p.j AS i, sum(p.v / bi.b) AS c
  FROM pairs p JOIN b{t} bi ON {keyed('p', 'bi')} AND p.i = bi.i GROUP BY ALL),
n{t} AS (SELECT {KEY}, i, b, done, CASE WHEN done THEN b
    WHEN r <> 0 AND c <> 0 THEN b * sqrt((r / b) * (c / b)) ELSE 1.0 END AS nb
  FROM b{t} JOIN r{t} USING ({KEY}, i) JOIN c{t} USING ({KEY}, i)),
b{t + 1} AS MATERIALIZED (SELECT {KEY}, i, nb AS b,
    done OR sum(abs(nb - b)) OVER (PARTITION BY {KEY}) < {tol} AS done FROM n{t})""")
    return f"""WITH {', '.join(ctes)}
SELECT p.label, p.replica, p.frame, p.i, p.j, {r6('p.v / (x.b * y.b)')} AS v FROM pairs p
JOIN b{rounds} x ON {keyed('p', 'x')} AND p.i = x.i JOIN b{rounds} y ON {keyed('p', 'y')} AND p.j = y.i"""


ORACLES["nrm_ice_10"] = balancing("euclidean", 10)
ORACLES["nrm_kr_10"] = balancing("contact", 10)
ORACLES["nrm_ice_asymmetric"] = balancing("spearman", 100)
ORACLES["nrm_ice"] = balancing("euclidean", 100)
ORACLES["nrm_kr"] = balancing("contact", 100)
ORACLES["nrm_balanced"] = f"""WITH {BEADS}, f AS (SELECT {KEY}, count(*) AS n FROM beads GROUP BY {KEY})
SELECT {KEY}, bead AS i, n, CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END AS row_sum FROM beads JOIN f USING ({KEY})"""


# ---- preprocessing and X ---------------------------------------------------

_G = {"weighted": "v", "single": "exp(-v / hi)", "complete": "1 / (1 + v)",
      "average": "(v - lo) / (hi - lo)"}


def matrix(metric: str, norm: str = "none", prep: str = "weighted", chunks: int | None = None) -> str:
    value = {"none": "v", "vc": VC, "log_transform": FLOG}[norm]
    chunk = "0" if chunks is None else f"row_id // greatest(1, (SELECT count(*) FROM frames) // {chunks})"
    return f"""WITH {BEADS}, {WIDTH}, {pairs(metric, square=True)},
frames AS (SELECT {KEY}, row_number() OVER (ORDER BY {KEY}) - 1 AS row_id
           FROM (SELECT DISTINCT {KEY} FROM beads)),
normed AS (SELECT {KEY}, i, j, {value} AS v FROM pairs),
ax AS (SELECT CAST(unnest(range(n)) AS INTEGER) AS k FROM w),
grid AS (SELECT {KEY}, row_id, {chunk} AS chunk, p.k AS i, q.k AS j, n FROM frames, ax p, ax q, w WHERE p.k < q.k),
x AS (SELECT {KEY}, row_id, chunk, {F_INDEX} AS f, coalesce(v, 0.0) AS v
      FROM grid LEFT JOIN normed USING ({KEY}, i, j)),
e AS (SELECT chunk, min(v) AS lo, max(v) AS hi FROM x GROUP BY ALL),
p AS (SELECT {KEY}, row_id, f, {_G[prep]} AS v FROM x JOIN e USING (chunk)),
s AS (SELECT min(v) AS lo, max(v) AS hi FROM p),
u AS (SELECT {KEY}, row_id, f, (v - lo) / (hi - lo) AS v FROM p, s)
SELECT {KEY}, row_id, count(*) AS n, {r6('sum(v)')} AS s, {r6('sum(v * (f + 1))')} AS w,
       {r6('sum(v * v)')} AS q FROM u GROUP BY ALL"""


ORACLES["feature_matrix"] = matrix("euclidean", "vc")
ORACLES["pre_single"] = matrix("contact", prep="single")
ORACLES["pre_complete"] = matrix("euclidean", "log_transform", "complete")
ORACLES["pre_average"] = matrix("log2_contact", prep="average")
ORACLES["pre_chunked"] = matrix("euclidean", prep="single", chunks=12)
ORACLES["snk_matrix_reuse"] = matrix("euclidean")

# ---- Hi-C ------------------------------------------------------------------


def _map(source: str, table: str, cut: float = 0.0, first: bool = False, name: str = "m") -> str:
    scaled = f"""{name}_u AS (SELECT i, j, CASE WHEN isnan(v) THEN 0.0 ELSE v END AS v
  FROM {table} WHERE source = '{source}' AND i < j),
{name}_s AS (SELECT i, j, CASE WHEN t <> 0 THEN v / t ELSE 0.0 END AS v FROM {name}_u
  JOIN (SELECT i, max(abs(v)) AS t FROM {name}_u GROUP BY i) USING (i)),"""
    last = f"{name}_s"
    if first:
        scaled += f"""
{name}_k AS (SELECT i, coalesce(max(v) FILTER (j = i + 1), 0.0) AS f, greatest(max(v), 0.0) AS t
  FROM {name}_s GROUP BY i),
{name}_f AS (SELECT i, j, CASE WHEN i >= width - 1 OR f = t THEN v WHEN f = 0 THEN 0.0
  WHEN v / f > 1 THEN 0.5 ELSE v / f END AS v FROM {name}_s JOIN {name}_k USING (i), cw),"""
        last = f"{name}_f"
    return f"""{scaled}
{name}_c AS (SELECT i, j, CASE WHEN v < {cut} THEN 0.0 ELSE v END AS v FROM {last}),
{name} AS (SELECT i, j, v FROM {name}_c UNION ALL SELECT j, i, v FROM {name}_c
  UNION ALL SELECT k, k, 1.0 FROM axis)"""


def _curve(name: str, table: str) -> str:
    return f"""{name} AS (SELECT g.s, avg(coalesce(v, 0.0)) AS mean, stddev_pop(coalesce(v, 0.0)) AS std
  FROM (SELECT a.k AS i, b.k AS j, b.k - a.k AS s FROM axis a, axis b WHERE b.k >= a.k) g
  LEFT JOIN {table} ON {table}.i = g.i AND {table}.j = g.j GROUP BY g.s)"""


_HIC = f"WITH {CONTACTS}, {CONTACT_GAPS}, {CWIDTH}, {AXIS}"
ORACLES["hic_simulation"] = f"{_HIC}, {_map('sim', 'contacts')} SELECT 'sim' AS source, i, j, {r6('v')} AS v FROM m"
ORACLES["hic_experiment"] = f"{_HIC}, {_map('exp', 'gaps', 0.2)} SELECT 'exp' AS source, i, j, {r6('v')} AS v FROM m"
ORACLES["hic_first"] = f"{_HIC}, {_map('exp', 'gaps', first=True)} SELECT 'exp' AS source, i, j, {r6('v')} AS v FROM m"
ORACLES["hic_scaling"] = f"""{_HIC}, {_map('exp', 'gaps')}, {_curve('c', 'm')}
SELECT 'exp' AS source, s, {r6('mean')} AS mean, {r6('std')} AS std FROM c"""
_BOTH = f"{_HIC}, {_map('exp', 'gaps', name='e')}, {_map('sim', 'contacts', name='s')}"
ORACLES["hic_composite"] = f"""{_BOTH} SELECT i, j, {r6('CASE WHEN i <= j THEN coalesce(e.v, 0.0) ELSE coalesce(s.v, 0.0) END')} AS v
FROM e FULL JOIN s USING (i, j)"""
ORACLES["hic_composite_strict"] = f"""{_BOTH} SELECT i, j,
{r6('CASE WHEN i <= j THEN coalesce(e.v, 0.0) ELSE 0.0 END + CASE WHEN j <= i + 1 THEN coalesce(s.v, 0.0) ELSE 0.0 END')} AS v
FROM e FULL JOIN s USING (i, j)"""
ORACLES["hic_scaling_compare"] = f"""{_BOTH}, {_curve('ce', 'e')}, {_curve('cs', 's')}
SELECT s, {r6('ce.mean')} AS exp, {r6('cs.mean')} AS sim FROM ce FULL JOIN cs USING (s)"""
ORACLES["hic_error_range"] = f"""{_HIC}, {_map('sim', 'contacts')}, {_curve('c', 'm')}
SELECT {r6('min(std)')} AS min_error, {r6('max(std)')} AS max_error FROM c"""

# ---- metrics report --------------------------------------------------------

_LOGGED = """logged AS (SELECT technique, method, metric, norm,
  CAST(printf('%.4f', silhouette) AS DOUBLE) AS silhouette, CAST(printf('%.4f', ch) AS DOUBLE) AS ch,
  CAST(printf('%.4f', db) AS DOUBLE) AS db FROM metrics)"""
_SUMS = f"count(*) AS n, {r6('sum(silhouette)')} AS silhouette, {r6('sum(ch)')} AS ch, {r6('sum(db)')} AS db"
ORACLES["log_parse"] = f"WITH {METRICS_RAW}, {_LOGGED} SELECT {KEYS4}, {_SUMS} FROM logged GROUP BY {KEYS4}"
ORACLES["log_parse_strict"] = f"""WITH {METRICS_RAW}, {_LOGGED}
SELECT technique, 'kmeans' AS method, metric, norm, {_SUMS} FROM logged
WHERE printf('%.4f', silhouette) NOT LIKE '-%' GROUP BY technique, metric, norm"""
_SUMMARY = f"WITH {METRICS_RAW}, {DEDUP}"
ORACLES["log_dedup"] = f"{_SUMMARY} SELECT {KEYS4}, {SCORES3} FROM summary"
_LONG = f"""long AS (SELECT {KEYS4}, 'silhouette' AS score, silhouette AS value, silhouette AS good FROM {{0}}
  UNION ALL SELECT {KEYS4}, 'ch', ch, ch FROM {{0}} UNION ALL SELECT {KEYS4}, 'db', db, -db FROM {{0}})"""
ORACLES["log_best"] = f"""{_SUMMARY}, {_LONG.format('summary')}
SELECT score, {KEYS4}, {r6('value')} AS value FROM long
QUALIFY row_number() OVER (PARTITION BY score ORDER BY good DESC, {KEYS4}) = 1"""
ORACLES["log_pivot"] = f"WITH {METRICS_RAW} " + " UNION ALL ".join(
    f"SELECT '{s}' AS score, technique, method, " + ", ".join(
        f"round(avg({s}) FILTER (metric = '{m}' AND norm = '{n}'), 6) + 0.0 AS {m}_{n}"
        for m in ("contact", "euclidean", "log2_contact", "pearsons", "spearman")
        for n in ("log_transform", "vc", "kr", "ice")) + " FROM metrics GROUP BY ALL"
    for s in ("silhouette", "ch", "db"))
ORACLES["log_best_worst"] = f"""{_SUMMARY}, {_LONG.format('summary')},
ends AS (SELECT score, technique, max(good) AS best, min(good) AS worst FROM long GROUP BY ALL)
SELECT score, {KEYS4}, {r6('value')} AS value, good = best AS is_best
FROM long JOIN ends USING (score, technique) WHERE good IN (best, worst)"""
_UNIT = """unit AS (SELECT technique, method, metric, norm,
  (silhouette - min(silhouette) OVER ()) / (max(silhouette) OVER () - min(silhouette) OVER ()) AS silhouette,
  (ch - min(ch) OVER ()) / (max(ch) OVER () - min(ch) OVER ()) AS ch,
  1 - (db - min(db) OVER ()) / (max(db) OVER () - min(db) OVER ()) AS db FROM {0})"""
ORACLES["log_normalise"] = f"{_SUMMARY}, {_UNIT.format('summary')} SELECT {KEYS4}, {SCORES3} FROM unit"
ORACLES["log_five_numbers"] = f"""{_SUMMARY}, {_LONG.format('summary')}
SELECT technique, score, {r6('min(value)')} AS low, {r6('quantile_cont(value, 0.25)')} AS q1,
  {r6('median(value)')} AS median, {r6('quantile_cont(value, 0.75)')} AS q3, {r6('max(value)')} AS high
FROM long GROUP BY ALL"""
ORACLES["log_central"] = f"""{_SUMMARY} SELECT technique, {r6('median(silhouette)')} AS silhouette,
  {r6('median(ch)')} AS ch, {r6('median(db)')} AS db FROM summary GROUP BY ALL"""
ORACLES["log_central_mean"] = f"""{_SUMMARY} SELECT technique, {r6('avg(silhouette)')} AS silhouette,
  {r6('avg(ch)')} AS ch, {r6('avg(db)')} AS db FROM summary GROUP BY ALL"""
ORACLES["log_best_by_technique"] = f"""{_SUMMARY}, {_UNIT.format('summary')}, {_LONG.format('unit')}
SELECT score, {KEYS4}, {r6('value')} AS value FROM long
QUALIFY row_number() OVER (PARTITION BY score, technique ORDER BY good DESC, {KEYS4}) = 1"""
ORACLES["log_distinct"] = f"""WITH {METRICS_RAW}
SELECT DISTINCT 'technique' AS field, technique AS value FROM metrics
UNION ALL SELECT DISTINCT 'method', method FROM metrics"""
ORACLES["log_select"] = f"{_SUMMARY} SELECT {KEYS4}, {r6('db')} AS db FROM summary"
ORACLES["log_report"] = f"""WITH {METRICS_RAW}, {_LOGGED}, means AS (SELECT {KEYS4},
  avg(silhouette) AS silhouette, avg(ch) AS ch, avg(db) AS db FROM logged GROUP BY ALL),
{_UNIT.format('means')} SELECT {KEYS4}, {SCORES3} FROM unit"""


# ---- rows of features ------------------------------------------------------

EMB = """emb AS (SELECT vec_id AS row_id, label AS cluster, embedding::DOUBLE[] AS v FROM embeddings)"""
ALL_PAIRS = """dist AS MATERIALIZED (SELECT a.row_id AS a, b.row_id AS b, a.cluster AS ca, b.cluster AS cb,
  list_distance(a.v, b.v) AS d FROM emb a, emb b)"""
CELLS = "cells AS (SELECT row_id, cluster, unnest(range(len(v))) AS f, unnest(v) AS t FROM emb)"

ORACLES["dst_rowpairs"] = f"WITH {EMB}, {ALL_PAIRS} SELECT a, b, {r6('d')} AS d FROM dist WHERE a < b"
ORACLES["red_covariance"] = f"""WITH {EMB}, {CELLS}
SELECT p.f, q.f AS g, {r6('covar_samp(p.t, q.t)')} AS cov FROM cells p JOIN cells q USING (row_id)
WHERE p.f <= q.f GROUP BY p.f, q.f"""
ORACLES["red_variance_total"] = f"""WITH {EMB}, {CELLS}
SELECT {r6('sum(s)')} AS total FROM (SELECT var_samp(t) AS s FROM cells GROUP BY f)"""
ORACLES["red_n95"] = f"""WITH {EMB}, {CELLS}, s AS (SELECT f + 1 AS k, var_samp(t) AS s FROM cells GROUP BY f),
c AS (SELECT k, sum(s) OVER (ORDER BY k) / sum(s) OVER () AS c FROM s)
SELECT coalesce(min(k) FILTER (c >= 0.95), 1) AS k FROM c"""
_KNN = """knn AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM dist WHERE a <> b)"""
ORACLES["red_knn"] = f"""WITH {EMB}, {ALL_PAIRS}, {_KNN}
SELECT a, b, {r6('d')} AS d, rank FROM knn WHERE rank <= 5"""
ORACLES["red_tsne_p_rows"] = f"""WITH {EMB}
SELECT row_id, least(90, (SELECT count(*) - 1 FROM emb)) AS neighbours, 1.0 AS total, 30.0 AS perplexity FROM emb"""
ORACLES["red_tsne_joint"] = "SELECT 1.0 AS total, 0.0 AS skew FROM embeddings LIMIT 1"
ORACLES["red_umap_rho"] = f"""WITH {EMB}, {ALL_PAIRS}
SELECT a AS row_id, {r6('min(d) FILTER (d > 0)')} AS rho, round(log2(15), 3) AS total
FROM dist WHERE a <> b GROUP BY a"""

# ---- clustering ------------------------------------------------------------

ORACLES["clu_inertia_k1"] = f"""WITH {EMB}, {CELLS}
SELECT {r6('sum(s)')} AS inertia FROM (SELECT var_pop(t) * count(*) AS s FROM cells GROUP BY f)"""
ORACLES["clu_core_distance"] = f"""WITH {EMB}, {ALL_PAIRS},
r AS (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS n FROM dist)
SELECT a AS row_id, {r6('d')} AS core FROM r WHERE n = 5"""
_DBSCAN = f"""WITH RECURSIVE {EMB}, {ALL_PAIRS},
core AS MATERIALIZED (SELECT a AS id FROM dist WHERE d <= 1.16 GROUP BY a HAVING count(*) >= 5),
link AS MATERIALIZED (SELECT a, b FROM dist WHERE d <= 1.16 AND a IN (FROM core) AND b IN (FROM core)),
reach AS (SELECT id, id AS low FROM core UNION SELECT link.b, reach.low FROM reach JOIN link ON link.a = reach.id),
comp AS (SELECT id, min(low) AS comp FROM reach GROUP BY id),
inside AS (SELECT id, comp FROM comp UNION ALL
  SELECT a, min(comp) FROM dist JOIN comp ON comp.id = dist.b
  WHERE d <= 1.16 AND a NOT IN (FROM core) GROUP BY a),
named AS (SELECT id, CAST(dense_rank() OVER (ORDER BY comp) - 1 AS INTEGER) AS cluster FROM inside),
assign AS (SELECT row_id, coalesce(named.cluster, -1) AS cluster, row_id IN (FROM core) AS is_core
  FROM emb LEFT JOIN named ON id = row_id)"""
ORACLES["clu_dbscan"] = f"{_DBSCAN} SELECT row_id, cluster, is_core FROM assign"
ORACLES["evl_core_counts"] = f"{_DBSCAN} SELECT cluster, count(*) AS n FROM assign WHERE is_core GROUP BY ALL"
ORACLES["clu_single_cut"] = f"""WITH RECURSIVE {EMB}, {ALL_PAIRS},
link AS MATERIALIZED (SELECT a, b FROM dist WHERE d <= 1.1),
reach AS (SELECT row_id AS id, row_id AS low FROM emb UNION SELECT link.b, reach.low FROM reach JOIN link ON link.a = reach.id)
SELECT id AS row_id, min(low) AS cluster FROM reach GROUP BY id"""

# ---- evaluation and model selection ----------------------------------------

_SIL = f"""WITH {EMB}, {ALL_PAIRS},
m AS (SELECT a, ca, cb, CASE WHEN ca = cb THEN sum(d) / nullif(count(*) - 1, 0) ELSE avg(d) END AS m
      FROM dist GROUP BY a, ca, cb),
p AS (SELECT a AS row_id, ca AS cluster, max(m) FILTER (ca = cb) AS ai, min(m) FILTER (ca <> cb) AS bi
      FROM m GROUP BY ALL),
s AS (SELECT row_id, cluster, CASE WHEN ai IS NULL OR bi IS NULL OR greatest(ai, bi) = 0 THEN 0.0
      ELSE (bi - ai) / greatest(ai, bi) END AS s FROM p)"""
_CENTRES = f"""{EMB}, {CELLS}, mu AS (SELECT cluster, f, avg(t) AS m FROM cells GROUP BY ALL),
spread AS (SELECT row_id, cells.cluster, sum((t - m) * (t - m)) AS q FROM cells JOIN mu USING (cluster, f) GROUP BY ALL)"""
_CH = """ch AS (SELECT (b / (k - 1)) / (w / (n - k)) AS ch FROM
  (SELECT sum(c * (m - g) * (m - g)) AS b FROM mu JOIN (SELECT f, avg(t) AS g FROM cells GROUP BY f) USING (f)
     JOIN (SELECT cluster, count(*) AS c FROM emb GROUP BY ALL) USING (cluster)),
  (SELECT sum(q) AS w, count(*) AS n, count(DISTINCT cluster) AS k FROM spread))"""
_DB = """sig AS (SELECT cluster, avg(sqrt(q)) AS s FROM spread GROUP BY ALL),
gap AS (SELECT p.cluster AS i, q.cluster AS j, sqrt(sum((p.m - q.m) * (p.m - q.m))) AS d
  FROM mu p JOIN mu q USING (f) WHERE p.cluster <> q.cluster GROUP BY ALL),
db AS (SELECT avg(r) AS db FROM (SELECT i, max((a.s + b.s) / d) AS r FROM gap
  JOIN sig a ON a.cluster = i JOIN sig b ON b.cluster = j GROUP BY i))"""
ORACLES["evl_silhouette"] = f"{_SIL} SELECT {r6('avg(s)')} AS silhouette FROM s"
ORACLES["evl_silhouette_points"] = f"""{_SIL} SELECT row_id, cluster, {r6('s')} AS s,
row_number() OVER (PARTITION BY cluster ORDER BY s, row_id) - 1 AS rank FROM s"""
ORACLES["evl_ch"] = f"WITH {_CENTRES}, {_CH} SELECT {r6('ch')} AS ch FROM ch"
ORACLES["evl_db"] = f"WITH {_CENTRES}, {_DB} SELECT {r6('db')} AS db FROM db"
ORACLES["evl_scores"] = (f"{_SIL}, {_CENTRES.removeprefix(EMB + ', ')}, {_CH}, {_DB} "
                         f"SELECT (SELECT {r6('avg(s)')} FROM s) AS silhouette, {r6('ch')} AS ch, {r6('db')} AS db FROM ch, db")
ORACLES["evl_sizes"] = "SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY ALL"
ORACLES["evl_contingency"] = """SELECT label AS cluster, ['A', 'B', 'C', 'D'][CAST(vec_id % 4 + 1 AS INTEGER)] AS label,
count(*) AS n FROM embeddings GROUP BY 1, 2"""
ORACLES["mdl_knee"] = """WITH curve AS (SELECT l_linenumber AS series, k, sum(l_extendedprice) AS y
  FROM lineitem, (SELECT unnest(range(2, 16)) AS k) WHERE floor(l_quantity / 3) >= k GROUP BY ALL),
u AS (SELECT series, k, (max(y) OVER s - y) / (max(y) OVER s - min(y) OVER s)
        - (k - min(k) OVER s) / (max(k) OVER s - min(k) OVER s)::DOUBLE AS d, count(*) OVER s AS n
      FROM curve WINDOW s AS (PARTITION BY series)),
e AS (SELECT *, lead(d) OVER w AS nx, d >= coalesce(lag(d) OVER w, d) AND d >= coalesce(lead(d) OVER w, d) AS top,
        d <= coalesce(lag(d) OVER w, d) AND d <= coalesce(lead(d) OVER w, d) AS low
      FROM u WINDOW w AS (PARTITION BY series ORDER BY k)),
t AS (SELECT *, last_value(CASE WHEN low THEN 0.0 WHEN top THEN d - 1.0 / (n - 1) END IGNORE NULLS) OVER w AS th,
        last_value(CASE WHEN top THEN k END IGNORE NULLS) OVER w AS cand
      FROM e WINDOW w AS (PARTITION BY series ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT series, min_by(cand, k) FILTER (cand IS NOT NULL AND nx IS NOT NULL AND nx < th) AS knee FROM t GROUP BY series"""
# ---- walks over the distance matrix ----------------------------------------

def _walk(core: str) -> str:
    """Visit rows one by one, always the unvisited row with the least weight (ties:
    lowest row). ``core`` is 0 for a plain spanning tree; for reachability it is
    the distance to the fifth neighbour."""
    return f"""WITH RECURSIVE {EMB}, {ALL_PAIRS},
line AS MATERIALIZED (SELECT a, list(d ORDER BY b) AS ds, {core} AS core FROM dist GROUP BY a),
walk(n, cur, w, seen, reach) AS (
  SELECT 0::BIGINT, 0::BIGINT, 'Infinity'::DOUBLE, [0::BIGINT],
         list_transform(ds, lambda d: greatest(core, d)) FROM line WHERE a = 0
  UNION ALL
  SELECT n + 1, line.a, pick.w, list_append(seen, line.a),
         list_transform(list_zip(reach, line.ds), lambda t: least(t[1], greatest(line.core, t[2])))
  FROM (SELECT walk.n, walk.seen, walk.reach,
          list_min(list_filter(list_transform(walk.reach, lambda r, i: {{'w': r, 'i': i - 1}}),
                               lambda t: NOT list_contains(walk.seen, t.i))) AS pick
        FROM walk) JOIN line ON line.a = pick.i)"""


_CORE5 = "list_sort(list(d))[5]"
ORACLES["lnk_single_heights"] = f"""{_walk('0.0')}
SELECT row_number() OVER (ORDER BY w) - 1 AS step, {r6('w')} AS height FROM walk WHERE n > 0"""
ORACLES["clu_optics_order"] = f"""{_walk(_CORE5)}
SELECT cur AS row_id, n AS ord, CASE WHEN n > 0 THEN {r6('w')} END AS reach, {r6('core')} AS core
FROM walk JOIN line ON line.a = cur"""


# ---- spectra ---------------------------------------------------------------
# Sums of powers of eigenvalues are traces of matrix powers.

ORACLES["red_pca_moments"] = f"""WITH {EMB}, {CELLS},
c AS MATERIALIZED (SELECT p.f AS f, q.f AS g, covar_samp(p.t, q.t) AS c FROM cells p JOIN cells q USING (row_id) GROUP BY p.f, q.f),
s AS (SELECT x.f, y.g, sum(x.c * y.c) AS c FROM c x JOIN c y ON x.g = y.f GROUP BY x.f, y.g)
SELECT (SELECT {r6('sum(c)')} FROM c WHERE f = g) AS m1, (SELECT {r6('sum(c * c)')} FROM c) AS m2,
       (SELECT {r6('sum(c.c * s.c)')} FROM c JOIN s ON c.f = s.g AND c.g = s.f) AS m3"""
ORACLES["red_svd_moments"] = f"""WITH {EMB}, {CELLS},
c AS (SELECT p.f AS f, q.f AS g, sum(p.t * q.t) AS c FROM cells p JOIN cells q USING (row_id) GROUP BY p.f, q.f)
SELECT (SELECT round(sum(c), 4) FROM c WHERE f = g) AS m1, (SELECT round(sum(c * c), 4) FROM c) AS m2"""
ORACLES["red_pca_norms"] = f"""WITH {EMB}, {CELLS}, m AS (SELECT f, avg(t) AS m FROM cells GROUP BY f)
SELECT row_id, {r6('sum((t - m) * (t - m))')} AS norm FROM cells JOIN m USING (f) GROUP BY row_id"""

# ---- one merge at a time ---------------------------------------------------

_UNION = {
    "single": "least(x.d, y.d)",
    "complete": "greatest(x.d, y.d)",
    "average": "(np * x.d + nq * y.d) / (np + nq)",
    "weighted": "(x.d + y.d) / 2",
    "ward": "sqrt(greatest(((np + nk) * x.d * x.d + (nq + nk) * y.d * y.d - nk * h * h) / (np + nq + nk), 0))",
}


def greedy_linkage(method: str) -> str:
    """Cells (a, b) hold distances, (a, a) sizes, (-1, q) the merge that absorbed q."""
    near = "recurring.t o, who WHERE o.a >= 0 AND o.d < 'Infinity' AND (o.a = who.{0} OR o.b = who.{0})"
    return f"""WITH RECURSIVE {EMB},
t(a, b, d, n, p) USING KEY (a, b) AS (
  SELECT a.row_id, b.row_id, CASE WHEN a.row_id < b.row_id THEN list_distance(a.v, b.v) ELSE 'Infinity'::DOUBLE END,
         1::BIGINT, 0::BIGINT
  FROM emb a JOIN emb b ON a.row_id <= b.row_id
  UNION
  (WITH pick AS (SELECT m.a AS p, m.b AS q, m.d AS h FROM (
     SELECT min({{'d': d, 'a': a, 'b': b}}) AS m FROM recurring.t WHERE a >= 0 AND d < 'Infinity')),
   size AS (SELECT a AS id, n FROM recurring.t WHERE a = b),
   who AS (SELECT p, q, h, sp.n AS np, sq.n AS nq FROM pick JOIN size sp ON sp.id = p JOIN size sq ON sq.id = q),
   x AS (SELECT CASE WHEN o.a = who.p THEN o.b ELSE o.a END AS k, o.d FROM {near.format('p')}),
   y AS (SELECT CASE WHEN o.a = who.q THEN o.b ELSE o.a END AS k, o.d FROM {near.format('q')}),
   z AS (SELECT x.k, {_UNION[method]} AS d FROM x JOIN y USING (k)
         JOIN (SELECT id, n AS nk FROM size) s ON s.id = x.k, who)
   SELECT least(who.p, k), greatest(who.p, k), z.d, 0, 0 FROM z, who
   UNION ALL SELECT least(q, k), greatest(q, k), 'Infinity'::DOUBLE, 0, 0 FROM y, who WHERE k <> p
   UNION ALL SELECT p, q, 'Infinity'::DOUBLE, 0, 0 FROM who
   UNION ALL SELECT p, p, 'Infinity'::DOUBLE, np + nq, 0 FROM who
   UNION ALL SELECT -1, q, h, np + nq, p FROM who)),
m AS MATERIALIZED (SELECT row_number() OVER (ORDER BY d) - 1 AS step, p, b AS q, d AS height, n AS size FROM t WHERE a = -1),
ids AS (SELECT m.step, m.height, m.size,
  coalesce((SELECT max(e.step) FROM m e WHERE e.p = m.p AND e.step < m.step) + (SELECT count(*) FROM emb), m.p) AS l,
  coalesce((SELECT max(e.step) FROM m e WHERE e.p = m.q AND e.step < m.step) + (SELECT count(*) FROM emb), m.q) AS r FROM m)
SELECT step, least(l, r) AS a, greatest(l, r) AS b, {r6('height')} AS height, size FROM ids"""


for _m in _UNION:
    ORACLES[f"lnk_{_m}"] = greedy_linkage(_m)

_WARD = greedy_linkage("ward")
ORACLES["lnk_truncated"] = f"{_WARD} ORDER BY step DESC LIMIT 9"
# A cluster is named by its lowest row: follow the merges below the cut.
ORACLES["clu_hierarchical"] = _WARD.partition("ids AS (SELECT m.step")[0] + """low AS (
  SELECT p, q FROM m WHERE step < (SELECT count(*) FROM emb) - 5),
up(row_id, root) AS (SELECT row_id, row_id FROM emb
  UNION ALL SELECT up.row_id, low.p FROM up JOIN low ON low.q = up.root),
named AS (SELECT row_id, min(root) AS root FROM up GROUP BY row_id)
SELECT row_id, CAST(dense_rank() OVER (ORDER BY root) AS INTEGER) AS cluster FROM named"""
ORACLES["evl_reachability"] = f"SELECT row_id, ord, reach FROM ({ORACLES['clu_optics_order']})"


def spectrum(centred: bool) -> str:
    """Three leading eigenpairs of the (centred) products by repeated squaring of
    the matrix, deflated after each: ``pairs(k, value, vector)``."""
    entry = "covar_samp(p.t, q.t)" if centred else "sum(p.t * q.t)"
    ctes = [EMB, CELLS, f"""entry AS (SELECT p.f AS f, q.f AS g, {entry} AS c
  FROM cells p JOIN cells q USING (row_id) GROUP BY p.f, q.f)""",
            "m1 AS MATERIALIZED (SELECT list(r ORDER BY f) AS m FROM (SELECT f, list(c ORDER BY g) AS r FROM entry GROUP BY f))",
            "total AS (SELECT sum(c) AS t FROM entry WHERE f = g)"]
    for k in (1, 2, 3):
        ctes.append(f"""s{k}(step, m) AS (SELECT 0, m FROM m{k} UNION ALL
  SELECT step + 1, [[x / t FOR x IN r] FOR r IN n] FROM (SELECT step, n, list_sum([n[i][i] FOR i IN range(1, len(n) + 1)]) AS t FROM (
    SELECT step, [[list_inner_product(r, c) FOR c IN m] FOR r IN m] AS n FROM s{k} WHERE step < 18)))""")
        ctes.append(f"""w{k} AS (SELECT m[top] AS r FROM (SELECT m, list_position(d, list_max(d)) AS top FROM (
  SELECT m, [m[i][i] FOR i IN range(1, len(m) + 1)] AS d FROM s{k} WHERE step = 18)))""")
        ctes.append(f"""u{k} AS (SELECT [x / sqrt(list_inner_product(r, r)) FOR x IN r] AS v FROM w{k})""")
        ctes.append(f"""e{k} AS MATERIALIZED (SELECT v, list_inner_product(v, [list_inner_product(r, v) FOR r IN m]) AS value FROM u{k}, m{k})""")
        ctes.append(f"""m{k + 1} AS MATERIALIZED (SELECT [[m[i][j] - value * v[i] * v[j] FOR j IN range(1, len(v) + 1)]
  FOR i IN range(1, len(v) + 1)] AS m FROM m{k}, e{k})""")
    pairs_ = " UNION ALL ".join(f"SELECT {k} AS k, value, v FROM e{k}" for k in (1, 2, 3))
    # the largest loading of each component is positive
    ctes.append(f"""pairs AS MATERIALIZED (SELECT k, value, CASE WHEN list_max(v) >= -list_min(v) THEN v ELSE [-x FOR x IN v] END AS v
  FROM ({pairs_}))""")
    return "WITH RECURSIVE " + ", ".join(ctes)


ORACLES["red_pca"] = f"{spectrum(True)} SELECT k, {r6('value')} AS value, {r6('value / t')} AS ratio FROM pairs, total"
ORACLES["red_n_share"] = f"""{spectrum(True)},
running AS (SELECT k, sum(value) OVER (ORDER BY k) / t AS c FROM pairs, total)
SELECT coalesce(min(k) FILTER (c >= 0.05), 1) AS k FROM running"""
ORACLES["red_svd"] = f"{spectrum(False)} SELECT k, {r6('sqrt(value)')} AS value, {r6('value / t')} AS ratio FROM pairs, total"
ORACLES["red_top_loadings"] = f"""{spectrum(True)}, l AS (SELECT unnest(range(len(v))) AS f, unnest(v) AS x FROM pairs WHERE k = 1)
SELECT f, {r6('abs(x)')} AS importance FROM l ORDER BY abs(x) DESC, f LIMIT 10"""
ORACLES["red_pca_scores"] = f"""{spectrum(True)}, mean AS (SELECT list(a ORDER BY f) AS a FROM (SELECT f, avg(t) AS a FROM cells GROUP BY f)),
e AS (SELECT row_id, k, list_inner_product([x[1] - x[2] FOR x IN list_zip(emb.v, a)], pairs.v) AS e FROM emb, mean, pairs)
SELECT row_id, {r6('max(e) FILTER (k = 1)')} AS c1, {r6('max(e) FILTER (k = 2)')} AS c2 FROM e GROUP BY row_id"""
ORACLES["mdl_kde"] = f"""{spectrum(True)}, mean AS (SELECT list(a ORDER BY f) AS a FROM (SELECT f, avg(t) AS a FROM cells GROUP BY f)),
e AS MATERIALIZED (SELECT cluster, k, list_inner_product([x[1] - x[2] FOR x IN list_zip(emb.v, a)], pairs.v) AS e
  FROM emb, mean, pairs WHERE k < 3),
h AS (SELECT cluster, k, stddev_samp(e) * pow(count(*), -0.2) AS h, min(e) AS lo, max(e) AS hi FROM e GROUP BY ALL),
g AS (SELECT cluster, k, h, g, lo - 3 * h + (hi - lo + 6 * h) * g / 199 AS pos FROM h, (SELECT unnest(range(200))::INTEGER AS g))
SELECT cluster, k, g, {r6('pos')} AS at, {r6('avg(exp(-0.5 * pow((pos - e) / h, 2)) / sqrt(2 * pi())) / any_value(h)')} AS density
FROM g JOIN e USING (cluster, k) GROUP BY cluster, k, g, pos"""
ORACLES["red_umap_graph"] = f"""WITH RECURSIVE {EMB}, {ALL_PAIRS}, {_KNN},
near AS MATERIALIZED (SELECT a, list(greatest(d - rho, 0)) AS gap, any_value(rho) AS rho, avg(d) AS mean FROM (
  SELECT a, d, min(d) FILTER (d > 0) OVER (PARTITION BY a) AS rho FROM knn WHERE rank <= 14) GROUP BY a),
turn(step, a, lo, hi, s, done) AS (
  SELECT 0, a, 0.0::DOUBLE, 'Infinity'::DOUBLE, 1.0::DOUBLE, false FROM near
  UNION ALL
  SELECT step + 1, a, CASE WHEN done OR abs(total - log2(15)) < 1e-5 OR total > log2(15) THEN lo ELSE s END,
         CASE WHEN done OR abs(total - log2(15)) < 1e-5 OR total <= log2(15) THEN hi ELSE s END,
         CASE WHEN done OR abs(total - log2(15)) < 1e-5 THEN s WHEN total > log2(15) THEN (lo + s) / 2
              WHEN isinf(hi) THEN s * 2 ELSE (s + hi) / 2 END,
         done OR abs(total - log2(15)) < 1e-5
  FROM (SELECT turn.*, list_sum([exp(-g / s) FOR g IN gap]) AS total FROM turn JOIN near USING (a) WHERE step < 64)),
scale AS (SELECT a, greatest(s, 1e-3 * mean) AS sigma, rho FROM turn JOIN near USING (a) WHERE step = 64),
w AS (SELECT least(a, b) AS i, greatest(a, b) AS j, exp(-greatest(d - rho, 0) / sigma) AS w
  FROM knn JOIN scale USING (a) WHERE rank <= 14)
SELECT i, j, round(sum(w) - CASE WHEN count(*) > 1 THEN max(w) * min(w) ELSE 0 END, 4) AS w FROM w GROUP BY i, j"""
