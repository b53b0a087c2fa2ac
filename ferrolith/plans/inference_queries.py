"""Inference, fusion and clustering queries, each with the SQL that says the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ferrolith.operators import density, gls, joint, metrics, nearest, splits, tensors, topology, validation
from ferrolith.functions import chem
from ferrolith.plans.queries import WITH, query, rounded
from ferrolith.plans.stand_ins import ELEMENTS, materials, read

_LOGIT = "(ln(least(greatest({0}, 1e-9), 1 - 1e-9)) - ln(1 - least(greatest({0}, 1e-9), 1 - 1e-9)))"


def _evidence(spark, sf_dir):
    """Materials with three channels, each missing in some rows, and a label that some lack."""
    m = materials(spark, sf_dir)
    return m.select(
        "jid", "formula", F.when(F.col("size") % 7 != 0, F.col("ehull") * 10 - 0.5).alias("si_score"), F.when(F.col("size") % 9 != 0, F.col("spillage")).alias("spillage"),
        F.when(F.col("size") % 5 != 0, F.col("poisson")).alias("ml_probability"), F.when(F.col("size") % 2 == 0, F.col("ehull")).alias("ml_uncertainty"),
        F.when(F.col("part") % 4 != 0, F.when(F.col("spillage") + F.col("size") / 100 > 0.75, 1.0).otherwise(0.0)).alias("y"), F.col("optb88vdw_bandgap").alias("band_gap"),
    )


_R = "(CASE WHEN regr_count({0}, {1}) >= 8 AND sqrt(regr_sxx({0}, {1}) * regr_syy({0}, {1})) > 1e-12 THEN 0.75::DOUBLE * regr_sxy({0}, {1}) / sqrt(regr_sxx({0}, {1}) * regr_syy({0}, {1})) ELSE 0 END)"
_SIG = "(1 / (1 + exp(-least(greatest({0}, -50), 50))))"
_EVIDENCE = f"""ev AS (SELECT jid, CASE WHEN size % 7 <> 0 THEN {_SIG.format('((ehull * 10 - 0.5::DOUBLE) / 0.35::DOUBLE)')} END AS p1, CASE WHEN size % 9 <> 0 THEN {_SIG.format('((spillage - 0.5::DOUBLE) / 0.1::DOUBLE)')} END AS p2, CASE WHEN size % 5 <> 0 THEN poisson END AS p3,
  greatest(0.05::DOUBLE, least(1.0::DOUBLE, 1 / (1 + 1.5::DOUBLE * CASE WHEN size % 2 = 0 THEN ehull ELSE 0.5::DOUBLE END))) AS c3, CASE WHEN part % 4 <> 0 THEN CASE WHEN spillage + size / 100::DOUBLE > 0.75::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS y, optb88vdw_bandgap AS gap FROM materials),
er AS (SELECT *, p1 - y AS e1, p2 - y AS e2, p3 - y AS e3 FROM ev),
ft AS (SELECT (2 + count(e1) - sum(abs(e1))) / (4 + count(e1)) AS r1, (2 + count(e2) - sum(abs(e2))) / (4 + count(e2)) AS r2, (2 + count(e3) - sum(abs(e3))) / (4 + count(e3)) AS r3, {_R.format('e1', 'e2')} AS a, {_R.format('e1', 'e3')} AS b, {_R.format('e2', 'e3')} AS c FROM er),
inf AS (SELECT ev.*, CASE WHEN p1 IS NULL THEN 0 ELSE 1 END AS h1, CASE WHEN p2 IS NULL THEN 0 ELSE 1 END AS h2, CASE WHEN p3 IS NULL THEN 0 ELSE 1 END AS h3, CASE WHEN p1 IS NULL THEN 0 ELSE 0.45::DOUBLE * r1 END AS i1, CASE WHEN p2 IS NULL THEN 0 ELSE 0.35::DOUBLE * r2 END AS i2, CASE WHEN p3 IS NULL THEN 0 ELSE 0.2::DOUBLE * r3 * c3 END AS i3,
  a * (p1 IS NOT NULL AND p2 IS NOT NULL)::INT AS a, b * (p1 IS NOT NULL AND p3 IS NOT NULL)::INT AS b, c * (p2 IS NOT NULL AND p3 IS NOT NULL)::INT AS c FROM ev, ft),
wt AS (SELECT *, greatest(sqrt(i1) * ((1 - c*c) * sqrt(i1) + (b*c - a) * sqrt(i2) + (a*c - b) * sqrt(i3)), 0) AS w1, greatest(sqrt(i2) * ((b*c - a) * sqrt(i1) + (1 - b*b) * sqrt(i2) + (a*b - c) * sqrt(i3)), 0) AS w2, greatest(sqrt(i3) * ((a*c - b) * sqrt(i1) + (a*b - c) * sqrt(i2) + (1 - a*a) * sqrt(i3)), 0) AS w3 FROM inf),
po AS (SELECT *, CASE WHEN h1 + h2 + h3 = 0 THEN coalesce(y, 0.5::DOUBLE) ELSE {_SIG.format(f"((w1 * coalesce({_LOGIT.format('p1')}, 0) + w2 * coalesce({_LOGIT.format('p2')}, 0) + w3 * coalesce({_LOGIT.format('p3')}, 0)) / (w1 + w2 + w3))")} END AS p,
  CASE WHEN h1 + h2 + h3 = 0 THEN 12.0::DOUBLE ELSE greatest(24 * (i1 + i2 + i3) / (1 + (CASE h1 + h2 + h3 WHEN 3 THEN (abs(a) + abs(b) + abs(c)) / 3 WHEN 2 THEN abs(a) + abs(b) + abs(c) ELSE 0 END) * (h1 + h2 + h3 - 1)), 1) END AS n FROM wt)"""
_TEMPS = "tm AS (SELECT 0.25::DOUBLE * pow(32.0::DOUBLE, i / 160.0::DOUBLE) AS t FROM range(161) AS q(i))"
_SCALED = f"least(greatest({_SIG.format(_LOGIT.format('p') + ' / {0}')}, 1e-9), 1 - 1e-9)"
_NLL = "-(y * ln({0}) + (1 - y) * ln(1 - {0}))"
_WHOLE = f"tw AS (SELECT first(t ORDER BY v, t) AS t FROM (SELECT t, avg({_NLL.format('q')}) AS v FROM (SELECT t, y, {_SCALED.format('t')} AS q FROM po, tm WHERE y IS NOT NULL) GROUP BY t))"


@query(f"""{WITH}, {_EVIDENCE}, {_TEMPS}, {_WHOLE}, fin AS (SELECT jid, gap, n, {_SCALED.format('t')} AS p FROM po, tw), iv AS (SELECT *, 1 + p * n AS al, 1 + (1 - p) * n AS be FROM fin),
hw AS (SELECT *, al / (al + be) AS m, 1.96::DOUBLE * sqrt(al * be / ((al + be) * (al + be) * (al + be + 1))) AS d FROM iv)
SELECT jid, round(p, 6) AS topological_probability, round(n, 6) AS n_eff, round(least(greatest(m - d, 0), 1), 6) AS topology_ci_low, round(least(greatest(m + d, 0), 1), 6) AS topology_ci_high,
CASE WHEN p >= 0.55 THEN CASE WHEN coalesce(gap, 0) <= 0.05 THEN 'TSM' ELSE 'TI' END ELSE 'TRIVIAL' END AS topo_class FROM hw""")
def topology_inference(spark, sf_dir):
    """Reliability and correlation of channels, pooled, scaled by a fitted temperature, with intervals and classes."""
    table = topology.channel_columns(_evidence(spark, sf_dir))
    channels = topology.fit_channels(table, "y")
    fitted = topology.fit_temperature(topology.pooled(table, channels, "y"), "probability", "y", "jid")
    got = topology.infer(table, channels, "y", fitted.whole, exact=False, relabel=True)
    return rounded(got, "topological_probability", "n_eff", "topology_ci_low", "topology_ci_high").select("jid", "topological_probability", "n_eff", "topology_ci_low", "topology_ci_high", "topo_class")


@query(f"""{WITH}, {_EVIDENCE}, {_TEMPS}, {_WHOLE}, fo AS (SELECT *, CAST('0x' || substr(md5('0:' || jid), 1, 8) AS BIGINT) % 3 AS fold FROM po WHERE y IS NOT NULL),
sm AS (SELECT fold, t, sum({_NLL.format('q')}) AS v, count(*) AS k FROM (SELECT fold, t, y, {_SCALED.format('t')} AS q FROM fo, tm) GROUP BY ALL),
tf AS (SELECT f AS fold, first(t ORDER BY v, t) AS t FROM (SELECT f, t, sum(v) / sum(k) AS v FROM sm, range(3) AS g(f) WHERE fold <> f GROUP BY ALL) GROUP BY f),
ev2 AS (SELECT y, least(greatest(p, 1e-9), 1 - 1e-9) AS q0, {_SCALED.format('t')} AS q1 FROM fo JOIN tf USING (fold)),
e0 AS (SELECT sum(abs(d)) AS e FROM (SELECT sum(q0 - y) AS d FROM ev2 GROUP BY least(floor(q0 * 10), 9))), e1 AS (SELECT sum(abs(d)) AS e FROM (SELECT sum(q1 - y) AS d FROM ev2 GROUP BY least(floor(q1 * 10), 9)))
SELECT count(*) AS before_n, round(any_value(e0.e) / count(*), 6) AS before_ece, round(avg((q0 - y) * (q0 - y)), 6) AS before_brier, round(avg({_NLL.format('q0')}), 6) AS before_nll,
count(*) AS after_n, round(any_value(e1.e) / count(*), 6) AS after_ece, round(avg((q1 - y) * (q1 - y)), 6) AS after_brier, round(avg({_NLL.format('q1')}), 6) AS after_nll,
'cross_fit' AS eval_scheme, round(any_value(tw.t), 6) AS temperature, round((SELECT avg(t) FROM tf), 6) AS temperature_cv_mean, round((SELECT stddev_pop(t) FROM tf), 6) AS temperature_cv_std, 3 AS folds_used FROM ev2, e0, e1, tw""")
def topology_diagnostics(spark, sf_dir):
    """How well calibrated the pooled chances are, before and after cross-fitted temperatures."""
    table = topology.channel_columns(_evidence(spark, sf_dir))
    chances = topology.pooled(table, topology.fit_channels(table, "y"), "y")
    got = topology.diagnose(chances, "probability", "y", "jid", topology.fit_temperature(chances, "probability", "y", "jid"))
    return rounded(got, *(f"{w}_{m}" for w in ("before", "after") for m in ("ece", "brier", "nll")), "temperature", "temperature_cv_mean", "temperature_cv_std")


#: Four gap sources: their reliability and how their errors go together, strongly for the first two.
SOURCES = {"dft": 0.7, "mbj": 0.8, "hse": 0.9, "ml": 0.6}
CORRELATION = np.array([[1, 0.9, 0.5, 0.2], [0.9, 1, 0.6, 0.1], [0.5, 0.6, 1, 0.3], [0.2, 0.1, 0.3, 1]])


def _blocks() -> list[list[float]]:
    """For each mask the inverse of its block of CORRELATION, solved here for the SQL."""
    out = []
    for mask in range(16):
        on = np.array([mask >> i & 1 for i in range(4)], bool)
        block = np.zeros((4, 4))
        block[np.ix_(on, on)] = np.linalg.solve(CORRELATION[np.ix_(on, on)], np.eye(on.sum())) if on.any() else 0
        out.append(block.ravel().tolist())
    return out


def _active(step: int, of: str) -> str:
    """One step of the active set: weights of the mask, then the mask without its most negative source."""
    raw = ", ".join(f"u[{i + 1}] * ({' + '.join(f'inv[mask + 1][{i * 4 + j + 1}] * u[{j + 1}]' for j in range(4))})" for i in range(4))
    return f"""r{step} AS (SELECT * REPLACE (CASE WHEN list_min(w) < -1e-12 THEN mask - CAST(pow(2, list_position(w, list_min(w)) - 1) AS INTEGER) ELSE mask END AS mask), w AS done FROM
(SELECT entity, v, u, mask, [x / list_sum(r) FOR x IN r] AS w FROM (SELECT entity, v, u, mask, [{raw}] AS r FROM {of}, blocks)))"""


@query(f"""{WITH}, blocks AS (SELECT {_blocks()} AS inv),
s AS (SELECT jid AS entity, [optb88vdw_bandgap, mbj_bandgap, hse_gap, CASE WHEN size % 4 <> 1 THEN ehull * 20 END] AS x, size FROM materials),
u AS (SELECT entity, [coalesce(y, 0) FOR y IN x] AS v, list_transform(x, lambda y, i: CASE WHEN y IS NULL THEN 0.0::DOUBLE ELSE 1 / ([0.35::DOUBLE, 0.2::DOUBLE, 0.12::DOUBLE, 0.5::DOUBLE][i] / sqrt(greatest([0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 0.6::DOUBLE][i] * exp(-(size % 3) / 5::DOUBLE), 1e-6))) END) AS u,
  CAST(list_sum(list_transform(x, lambda y, i: CASE WHEN y IS NULL THEN 0 ELSE pow(2, i - 1) END)) AS INTEGER) AS mask FROM s),
k AS (SELECT * FROM u WHERE mask > 0), {_active(1, 'k')}, {_active(2, 'r1')}, {_active(3, 'r2')}, {_active(4, 'r3')},
f AS (SELECT entity, v, u, [greatest(x, 0) / list_sum([greatest(z, 0) FOR z IN done]) FOR x IN done] AS w FROM r4),
c AS (SELECT *, list_transform(w, lambda x, i: CASE WHEN u[i] > 0 THEN x / u[i] ELSE 0 END) AS q FROM f)
SELECT entity, round(w[1] * v[1] + w[2] * v[2] + w[3] * v[3] + w[4] * v[4], 6) AS mean, round(sqrt({' + '.join(f'{CORRELATION[i, j]}::DOUBLE * q[{i + 1}] * q[{j + 1}]' for i in range(4) for j in range(4))}), 6) AS std,
round(1 / (w[1] * w[1] + w[2] * w[2] + w[3] * w[3] + w[4] * w[4]), 6) AS n_eff, round(w[1], 6) AS w_dft, round(w[2], 6) AS w_mbj FROM c""")
def gls_sources(spark, sf_dir):
    """Least-variance means of up to four correlated sources, no weight below 0."""
    m = materials(spark, sf_dir)
    each = [("dft", "optb88vdw_bandgap", 0.35), ("mbj", "mbj_bandgap", 0.2), ("hse", "hse_gap", 0.12), ("ml", "ml", 0.5)]
    m = m.withColumn("ml", F.when(F.col("size") % 4 != 1, F.col("ehull") * 20))
    rows = m.select(F.col("jid").alias("entity"), F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.col(c).alias("value"), F.lit(sd).alias("std")) for s, c, sd in each))).alias("e"), ((F.col("size") % 3) / 5).alias("drift"))
    got = gls.fuse(rows.select("entity", "e.*", "drift"), SOURCES, CORRELATION)
    return rounded(got.select("entity", "mean", "std", "n_eff", F.coalesce(F.try_element_at("weights", F.lit("dft")), F.lit(0.0)).alias("w_dft"), F.coalesce(F.try_element_at("weights", F.lit("mbj")), F.lit(0.0)).alias("w_mbj")), "mean", "std", "n_eff", "w_dft", "w_mbj")


_DBSCAN = """n AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) <= {0}),
c AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 5), cc AS (SELECT a, b FROM n WHERE a IN (FROM c) AND b IN (FROM c)),
r AS (SELECT a, a AS m FROM c UNION SELECT cc.b, r.m FROM r JOIN cc ON r.a = cc.a WHERE r.m < cc.b), k AS (SELECT a, min(m) AS m FROM r GROUP BY a),
e AS (SELECT n.a, min(m) AS m FROM n JOIN k ON n.b = k.a WHERE n.a NOT IN (FROM c) GROUP BY 1)
SELECT p.vec_id, coalesce(k.m, e.m) AS cluster, k.m IS NOT NULL AS core FROM p LEFT JOIN k ON p.vec_id = k.a LEFT JOIN e ON p.vec_id = e.a"""
EPS = 0.02


@query(f"""WITH RECURSIVE x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT vec_id, [e[1] / sqrt(list_dot_product(e, e)), e[2] / sqrt(list_dot_product(e, e))] AS v FROM x), {_DBSCAN.format(EPS)}""")
def embedding_density(spark, sf_dir):
    """Density clusters of the first two coordinates of the unit embeddings."""
    e = read(spark, sf_dir, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    return density.dbscan(e.select("vec_id", F.array(F.get("e", F.lit(0)) / norm, F.get("e", F.lit(1)) / norm).alias("v")), "vec_id", "v", EPS)


@query("""WITH RECURSIVE p AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), """ + _DBSCAN.format(1.18))
def embedding_density_all(spark, sf_dir):
    """Density clusters in all coordinates."""
    return density.dbscan(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1.18)


_SHARE = "[" + ", ".join(f"(CASE WHEN e1 = '{e}' THEN c1 ELSE 0 END + CASE WHEN e2 = '{e}' THEN c2 ELSE 0 END) / (c1 + c2)" for e in ELEMENTS) + "]"


@query(f"""{WITH}, v AS (SELECT jid, part, {_SHARE} AS v FROM materials), n AS (SELECT a.jid, max(list_cosine_similarity(a.v, b.v)) AS s FROM v a JOIN v b ON b.part % 9 = 0 AND b.jid <> a.jid WHERE a.part % 20 = 0 GROUP BY 1)
SELECT v.jid, round(n.s, 6) AS nearest, round(1 / (1 + exp(-(least(greatest(1 - coalesce(n.s, 0), 0), 1) - 0.35::DOUBLE) / 0.35::DOUBLE)), 6) AS ood_score FROM v LEFT JOIN n USING (jid) WHERE part % 20 = 0""")
def composition_ood(spark, sf_dir):
    """How far every twentieth material is from its nearest reference composition."""
    m = materials(spark, sf_dir).select("jid", "part", chem.fraction_vector(chem.parse_formula(F.col("formula")), ELEMENTS).alias("v"))
    got = nearest.nearest(m.where("part % 20 = 0"), m.where("part % 9 = 0"), "jid", "v")
    return rounded(got.withColumn("ood_score", topology.ood_score(F.col("nearest"))), "nearest", "ood_score").select("jid", "nearest", "ood_score")


_JOINT = ("optb88vdw_bandgap", "ehull", "shear_modulus_gv")
_TO = [[float(w) for w in v] for v in joint.directions(joint.DIRECTIONS, 4)]
_Z = "[" + ", ".join(" + ".join(f"f[{i + 1}] * {w!r}::DOUBLE" for i, w in enumerate(v)) for v in _TO) + "]"


@query(f"""{WITH}, s AS (SELECT jid, part % 2 AS side, CAST('0x' || substr(md5((part % 2) || ':' || jid), 1, 8) AS BIGINT) AS u, optb88vdw_bandgap AS a, CASE WHEN part % 2 = 1 THEN ehull * 1.5::DOUBLE ELSE ehull END AS b, shear_modulus_gv AS c FROM materials),
md AS (SELECT median(a) AS ma FROM s), r AS (SELECT side, u, coalesce(a, ma) AS a, b, c, CASE WHEN a IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS i FROM s, md),
m1 AS (SELECT median(a) AS ma, median(b) AS mb, median(c) AS mc, median(i) AS mi, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc, stddev_pop(i) AS si FROM r),
m2 AS (SELECT 1.4826::DOUBLE * median(abs(a - ma)) AS ka, 1.4826::DOUBLE * median(abs(b - mb)) AS kb, 1.4826::DOUBLE * median(abs(c - mc)) AS kc, 1.4826::DOUBLE * median(abs(i - mi)) AS ki FROM r, m1),
z AS (SELECT side, u, [(a - ma) / CASE WHEN ka > 1e-8 THEN ka ELSE sa END, (b - mb) / CASE WHEN kb > 1e-8 THEN kb ELSE sb END, (c - mc) / CASE WHEN kc > 1e-8 THEN kc ELSE sc END, (i - mi) / CASE WHEN ki > 1e-8 THEN ki ELSE si END] AS f FROM r, m1, m2),
n AS (SELECT count(*) AS n, count(*) FILTER (side = 0) AS o FROM z), k AS (SELECT side, u, k, zs[k] AS z FROM (SELECT side, u, {_Z} AS zs FROM z), range(1, {joint.DIRECTIONS + 1}) AS q(k)),
b AS (SELECT * FROM (SELECT unnest(range(1, 100)) AS b, unnest({joint.multipliers(99).tolist()}) AS x) UNION ALL SELECT 0, 0),
l AS (SELECT k, b, z, lead(z) OVER w - z AS gap, sum(old) OVER w AS c, row_number() OVER w AS i FROM (SELECT k, b, z, u, side, CASE WHEN b = 0 THEN (side = 0)::INT ELSE ((CAST(u AS HUGEINT) * x) % 4294967296 < floor(o * 4294967296.0::DOUBLE / n))::INT END AS old FROM k, b, n) WINDOW w AS (PARTITION BY k, b ORDER BY z, u, side)),
t AS (SELECT k, b, max(c) AS o, max(i) AS n FROM l GROUP BY 1, 2), h AS (SELECT k, b, any_value(o) AS o, any_value(n) AS n, sum(gap * (f * (1 - g) + g * (1 - f))) AS x, sum(gap * 2 * f * (1 - f)) AS y, sum(gap * 2 * g * (1 - g)) AS v FROM (SELECT l.*, o, n, c / o AS f, (i - c) / (n - o) AS g FROM l JOIN t USING (k, b)) GROUP BY 1, 2),
d AS (SELECT b, greatest({joint.spread(4)!r}::DOUBLE * avg(2 * x - y * o / (o - 1) - v * (n - o) / (n - o - 1)), 0) AS d FROM h GROUP BY 1), d0 AS (SELECT d AS e FROM d WHERE b = 0)
SELECT any_value(n.o) AS n_old, any_value(n.n - n.o) AS n_new, 4 AS n_features, round(any_value(e), 6) AS energy_distance, (1 + count(*) FILTER (b > 0 AND d >= e - 1e-12)) / 100 AS pvalue, (1 + count(*) FILTER (b > 0 AND d >= e - 1e-12)) <= 5 AND any_value(e) >= 0.2 AS alert FROM d, d0, n""")
def joint_drift(spark, sf_dir):
    """All rows of two halves: energy distance of three properties together, and its permutation test."""
    m = materials(spark, sf_dir)
    old, new = m.where("part % 2 = 0"), m.where("part % 2 = 1").withColumn("ehull", F.col("ehull") * 1.5)
    return rounded(joint.joint_drift(old, new, list(_JOINT), "jid", permutations=99).drop("reason"), "energy_distance")


def _eigen(c: str) -> str:
    """Eigenvalues of the SQL list ``c`` of a, b, c, d, e, f (diagonal, then below it): the same trigonometric solution."""
    return f"""(SELECT CASE WHEN p > 0 THEN [q + 2 * p * cos(phi + 2 * pi() / 3), 3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3)), q + 2 * p * cos(phi)] ELSE [q, q, q] END FROM (SELECT q, p, acos(least(greatest(det / (2 * p * p * p), -1), 1)) / 3 AS phi FROM
(SELECT q, p, (a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e) AS det FROM (SELECT *, sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM
(SELECT {c}[1] AS a, {c}[2] AS b, {c}[3] AS c, {c}[4] AS d, {c}[5] AS e, {c}[6] AS f, ({c}[1] + {c}[2] + {c}[3]) / 3 AS q)))))"""


@query(f"""{WITH}, t AS (SELECT jid, [bulk_modulus_kv, shear_modulus_gv, density, spillage * 9, ehull, formation_energy_peratom] AS t, [bulk_modulus_kv * 1.1::DOUBLE, shear_modulus_gv + size % 5, density, spillage * 9, ehull + 1, formation_energy_peratom] AS p, 0.5::DOUBLE AS up FROM materials),
e AS (SELECT jid, {_eigen('t')} AS et, {_eigen('p')} AS ep, t, p, up FROM t)
SELECT jid, round(et[1], 5) AS least, round(et[3], 5) AS most, round(sqrt((p[1] - t[1]) ** 2 + (p[2] - t[2]) ** 2 + (p[3] - t[3]) ** 2 + (p[4] + up - t[4]) ** 2 + (p[4] - t[4]) ** 2 + 2 * (p[5] - t[5]) ** 2), 5) AS frobenius,
round(2 * up / 9, 5) AS asymmetry, CASE WHEN et[2] - et[1] > 1e-6 AND et[3] - et[2] > 1e-6 AND ep[2] - ep[1] > 1e-6 AND ep[3] - ep[2] > 1e-6 THEN 1.0::DOUBLE END AS agreement FROM e""")
def tensor_eigenvalues(spark, sf_dir):
    """Eigenvalues and errors of a predicted tensor of each material."""
    m = materials(spark, sf_dir)
    side = lambda a, b, c, d, e, f, up: F.array(F.array(a, d + up, e), F.array(d, b, f), F.array(e, f, c))
    a, b, c, d, e, f = (F.col("bulk_modulus_kv"), F.col("shear_modulus_gv"), F.col("density"), F.col("spillage") * 9, F.col("ehull"), F.col("formation_energy_peratom"))
    m = m.select("jid", side(a, b, c, d, e, f, F.lit(0.0)).alias("t"), side(a * 1.1, b + F.col("size") % 5, c, d, e + 1, f, F.lit(0.5)).alias("p"))
    scored = tensors.with_agreement(m, "t", "p")
    t, p = tensors.entries(F.col("t")), tensors.entries(F.col("p"))
    gap = F.sqrt(sum(((t[i][j] - p[i][j]) * (t[i][j] - p[i][j]) for i in tensors.AXES for j in tensors.AXES), F.lit(0.0)))
    skew = sum((F.abs(p[i][j] - p[j][i]) for i in tensors.AXES for j in tensors.AXES), F.lit(0.0)) / 9
    values = tensors.eigenvalues(F.col("t"))
    got = scored.select("jid", F.get(values, F.lit(0)).alias("least"), F.get(values, F.lit(2)).alias("most"), gap.alias("frobenius"), skew.alias("asymmetry"), "agreement")
    return got.withColumns({n: F.round(n, 5) for n in ("least", "most", "frobenius", "asymmetry")})


@query(f"""{WITH}, r AS (SELECT abs(shear_modulus_gv / 10 - spillage * 9) AS e, ehull + 0.01::DOUBLE AS v, 1 + poisson + size % 40 AS a, density AS b FROM materials WHERE density > 0),
l AS (SELECT 0.5::DOUBLE * ln(pi() / v) - a * ln(2 * b) + (a + 0.5::DOUBLE) * ln(v * e * e + 2 * b) + lgamma(a) - lgamma(a + 0.5::DOUBLE) AS nll, e * (2 * v + a) AS reg FROM r)
SELECT count(*) AS n, round(avg(nll), 6) AS nll, round(avg(reg), 6) AS regularizer, round(avg(nll + 0.01::DOUBLE * reg), 6) AS loss FROM l""")
def evidential_loss(spark, sf_dir):
    """The evidential loss of all materials."""
    m = materials(spark, sf_dir).select((F.col("shear_modulus_gv") / 10).alias("y"), (F.col("spillage") * 9).alias("gamma"), (F.col("ehull") + 0.01).alias("nu"), (1 + F.col("poisson") + F.col("size") % 40).alias("alpha"), F.col("density").alias("beta"))
    return rounded(metrics.evidential_loss(m, "y"), "nll", "regularizer", "loss")


_UNITS = {"density": ["g/cm3"], "ehull": ["ev/atom"]}
_UNIT = "CASE WHEN size % 9 = 0 THEN ' KG/m3 ' WHEN size % 2 = 0 THEN 'g/cm3' END"


def _checked(spark, sf_dir):
    return materials(spark, sf_dir).withColumn("density_unit", F.when(F.col("size") % 9 == 0, " KG/m3 ").when(F.col("size") % 2 == 0, "g/cm3")).withColumn("jid", F.when(F.col("part") % 50 == 0, "M1").otherwise(F.col("jid")))


@query(f"""{WITH} SELECT jid, 'schema' AS "check", 'hse_gap' AS field, NULL::VARCHAR AS found FROM materials WHERE hse_gap IS NULL UNION ALL SELECT jid, 'provenance', 'provenance_type', NULL FROM materials WHERE provenance_type IS NULL
UNION ALL SELECT jid, 'unit', 'density', 'kg/m3' FROM materials WHERE size % 9 = 0""")
def dataset_violations(spark, sf_dir):
    """Every fault of every row, from one scan."""
    m = materials(spark, sf_dir).withColumn("density_unit", F.when(F.col("size") % 9 == 0, " KG/m3 ").when(F.col("size") % 2 == 0, "g/cm3"))
    return validation.violations(m, required=("jid", "hse_gap"), units=_UNITS)


@query(f"""{WITH}, c AS (SELECT * REPLACE (CASE WHEN part % 50 = 0 THEN 'M1' ELSE jid END AS jid) FROM materials), n AS (SELECT count(*) AS n, count(DISTINCT jid) AS d, count(*) FILTER (hse_gap IS NULL) AS s, count(*) FILTER (provenance_type IS NULL) AS p, count(*) FILTER (size % 9 = 0) AS u, avg(shear_modulus_gv) AS m, stddev_pop(shear_modulus_gv) AS sd FROM c),
x AS (SELECT shear_modulus_gv AS v, row_number() OVER (ORDER BY shear_modulus_gv) - 1 AS i, count(*) OVER () // 2 AS h FROM c), md AS (SELECT v AS m FROM x WHERE i = h), y AS (SELECT abs(v - m) AS d, row_number() OVER (ORDER BY abs(v - m)) - 1 AS i, h FROM x, md), mad AS (SELECT d AS k FROM y WHERE i = h),
o AS (SELECT count(*) AS o FROM y, mad WHERE d > 5 * 1.4826::DOUBLE * CASE WHEN k = 0 THEN 1e-10 ELSE k END)
SELECT n AS n_samples, s AS schema_violations, p AS provenance_missing, u AS unit_violations, n - d AS duplicate_count, 0::BIGINT AS leakage_count, o AS outlier_count, round(m, 6) AS shear_modulus_gv_mean, round(sd, 6) AS shear_modulus_gv_std, round(abs(m - 50) / 10, 6) AS shift,
array_to_string(list_filter([CASE WHEN s > 0 THEN 'schema_violations=' || s END, CASE WHEN p > 0 THEN 'provenance_missing=' || p END, CASE WHEN u > 0 THEN 'unit_violations=' || u END, CASE WHEN n > d THEN 'duplicate_count=' || (n - d) END, CASE WHEN o > 0 THEN 'outlier_count=' || o END], lambda x: x IS NOT NULL), ';') AS gate_failures, s + p + u + n - d + o = 0 AS gate_pass FROM n, o""")
def dataset_report(spark, sf_dir):
    """The whole validation of a table in strict mode, with a split that doesn't leak."""
    m = _checked(spark, sf_dir)
    assigned = splits.iid_split(m.select("jid").distinct(), "jid")
    got = validation.validate_dataset(m, properties=("shear_modulus_gv",), required=("jid", "hse_gap"), units=_UNITS, assigned=assigned, baseline_summary={"shear_modulus_gv": {"mean": 50.0, "std": 10.0}}, strict=True)
    got = got.withColumns({"shift": F.col("drift_summary")["shear_modulus_gv"], "gate_failures": F.array_join("gate_failures", ";")})
    return rounded(got, "shear_modulus_gv_mean", "shear_modulus_gv_std", "shift").select("n_samples", "schema_violations", "provenance_missing", "unit_violations", "duplicate_count", "leakage_count", "outlier_count", "shear_modulus_gv_mean", "shear_modulus_gv_std", "shift", "gate_failures", "gate_pass")
