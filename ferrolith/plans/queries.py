"""Operators applied to the test tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.functions import chem, numeric
from ferrolith.operators import acquisition, drift, fusion, learning, metrics, ordered, pareto, pathways, physics, quality, search, selection, similarity, splits
from ferrolith.plans.stand_ins import ELEMENTS, MATERIALS, materials, phi, r6, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
WITH = f"WITH {MATERIALS}"
_LIST_Z = "MAP {" + ", ".join(f"'{e}': {chem.NUMBERS[e]}" for e in ELEMENTS) + "}"


def query(sql: str | None = None):
    """Register the function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


# gap fusion in SQL: present gaps, their sigmas, and the closed form of equal-correlation least squares
_COMPLEX = "CASE WHEN e1 = e2 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, -(c1/(c1+c2)*ln(c1/(c1+c2)) + c2/(c1+c2)*ln(c2/(c1+c2))) / ln(2.0::DOUBLE)) END"
FUSED = f"""g0 AS (SELECT *, 1 + 0.35::DOUBLE * ({_COMPLEX}) AS sc FROM materials),
g1 AS (SELECT *, CASE WHEN hse_gap IS NULL THEN 0 ELSE 1/(0.12::DOUBLE*sc) END AS u1, CASE WHEN mbj_bandgap IS NULL THEN 0 ELSE 1/(0.2::DOUBLE*sc) END AS u2, CASE WHEN optb88vdw_bandgap IS NULL THEN 0 ELSE 1/(0.35::DOUBLE*sc) END AS u3,
  CAST((hse_gap IS NOT NULL)::INT + (mbj_bandgap IS NOT NULL)::INT + (optb88vdw_bandgap IS NOT NULL)::INT AS DOUBLE) AS m,
  coalesce(hse_gap, 0) AS y1, coalesce(mbj_bandgap, 0) AS y2, coalesce(optb88vdw_bandgap, 0) AS y3, coalesce(hse_gap, mbj_bandgap, optb88vdw_bandgap) AS best FROM g0),
g2 AS (SELECT *, (u1*u1+u2*u2+u3*u3 - 0.25/(0.75+m*0.25)*(u1+u2+u3)*(u1+u2+u3))/0.75 AS s1, (u1*u1*y1+u2*u2*y2+u3*u3*y3 - 0.25/(0.75+m*0.25)*(u1+u2+u3)*(u1*y1+u2*y2+u3*y3))/0.75 AS sy FROM g1),
g3 AS (SELECT *, CASE WHEN m > 0 THEN sy/s1 END AS mu FROM g2),
fused AS (SELECT *, CASE WHEN best >= 0 THEN best END AS bandgap_best, mu AS bandgap_fused, m AS bandgap_method_count,
  CASE WHEN m > 0 THEN sqrt(1/s1 + (CASE WHEN u1 > 0 THEN (y1-mu)*(y1-mu) ELSE 0 END + CASE WHEN u2 > 0 THEN (y2-mu)*(y2-mu) ELSE 0 END + CASE WHEN u3 > 0 THEN (y3-mu)*(y3-mu) ELSE 0 END)/m) END AS bandgap_fused_std FROM g3)"""
_MU, _SD = "coalesce(bandgap_fused, bandgap_best)", "greatest(coalesce(bandgap_fused_std, 0.35), 1e-8)"
CLASSED = f"""c0 AS (SELECT *, {_MU} AS mu0, {phi(f"((0.01 - {_MU})/{_SD})")} AS f1, {phi(f"((0.5 - {_MU})/{_SD})")} AS f2, {phi(f"((3.0 - {_MU})/{_SD})")} AS f3 FROM fused),
c1 AS (SELECT *, f1 AS q1, greatest(f2-f1, 0) AS q2, greatest(f3-f2, 0) AS q3, greatest(1-f3, 0) AS q4 FROM c0),
classed AS (SELECT *, q1/(q1+q2+q3+q4) AS p_metal, q2/(q1+q2+q3+q4) AS p_semimetal, q3/(q1+q2+q3+q4) AS p_semiconductor, q4/(q1+q2+q3+q4) AS p_insulator,
  CASE WHEN mu0 IS NULL THEN 'unknown' WHEN q1 >= greatest(q1,q2,q3,q4) THEN 'metal' WHEN q2 >= greatest(q1,q2,q3,q4) THEN 'semimetal' WHEN q3 >= greatest(q1,q2,q3,q4) THEN 'semiconductor' ELSE 'insulator' END AS conductivity_class FROM c1)"""
_SOLID = "bulk_modulus_kv > 0 AND shear_modulus_gv > 0"


@query(f"""{WITH}, {FUSED}, {CLASSED} SELECT jid, formula, round(bandgap_fused, 6) AS bandgap_fused, conductivity_class, round(bulk_modulus_kv / shear_modulus_gv, 6) AS pugh_ratio, ehull
FROM classed WHERE ehull <= 0.1 AND bandgap_best BETWEEN 0.5 AND 3.2 AND bulk_modulus_kv / shear_modulus_gv > 1.75 ORDER BY bulk_modulus_kv DESC, jid LIMIT 50""")
def search_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived columns, then a multi-criteria search, then the best 50."""
    table = physics.elastic_columns(fusion.class_columns(fusion.gap_columns(materials(spark, sf_dir))))
    found = search.search(table, search.build_criteria(ehull_max=0.1, ductile=True, bandgap_best=(0.5, 3.2)) | {"no_such_column": 1}, "bulk_modulus_kv", ascending=False)
    return rounded(found.select("jid", "formula", "bandgap_fused", "conductivity_class", "pugh_ratio", "ehull"), "bandgap_fused", "pugh_ratio")


@query(f"{WITH} SELECT jid, source_key, size FROM materials WHERE source_key IN ('Brand#11', 'Brand#22') AND size BETWEEN 5 AND 40 AND label = 1")
def search_in_eq_range(spark, sf_dir):
    return materials(spark, sf_dir).where(search.criterion("source_key", ["Brand#11", "Brand#22"]) & search.criterion("size", (5, 40)) & search.criterion("label", 1)).select("jid", "source_key", "size")


@query(f"{WITH} SELECT jid, round(density, 6) AS density FROM materials WHERE density <= 6.5 AND ehull >= 0.08")
def filter_expressions(spark, sf_dir):
    tests = dict(search.parse_filter(t) for t in ("density < 6.5", "ehull >= 0.08"))
    return rounded(search.search(materials(spark, sf_dir), tests, limit=10**9).select("jid", "density"), "density")


@query(f"{WITH} SELECT jid, formula FROM materials WHERE e1 IN ('Fe', 'O') AND e2 IN ('Fe', 'O') AND e1 <> e2")
def element_subset(spark, sf_dir):
    return search.with_elements(materials(spark, sf_dir), ["Fe", "O"]).select("jid", "formula")


@query(f"{WITH} SELECT jid FROM materials WHERE e1 IN ('Li', 'O', 'Fe') AND e2 IN ('Li', 'O', 'Fe')")
def within_elements(spark, sf_dir):
    return search.within_elements(materials(spark, sf_dir), ["Li", "O", "Fe"]).select("jid")


@query(f"{WITH} SELECT jid FROM materials WHERE e1 IN ('Bi', 'Te', 'Sn') OR e2 IN ('Bi', 'Te', 'Sn')")
def heavy_elements(spark, sf_dir):
    return search.heavy(materials(spark, sf_dir)).select("jid")


@query(f"{WITH} SELECT source_key, count(*) AS n, round(avg(size), 6) AS mean_size FROM materials GROUP BY 1")
def sql_passthrough(spark, sf_dir):
    from ferrolith.sources.writers import sql

    return sql(materials(spark, sf_dir), "SELECT source_key, count(*) AS n, round(avg(size), 6) AS mean_size FROM materials GROUP BY 1")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def dedup_keep_last(spark, sf_dir):
    return ordered.keep_last(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def dedup_keep_first(spark, sf_dir):
    return ordered.keep_first(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("SELECT md5(trim(text)) AS text_md5, count(*) AS n FROM documents GROUP BY trim(text) HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    return quality.duplicates(read(spark, sf_dir, "documents"), "text").select(F.md5("text").alias("text_md5"), "n")


_ASSIGN = "assigned AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 < 8 THEN 'train' WHEN c_custkey % 10 = 8 THEN 'val' ELSE 'test' END AS split, c_nationkey FROM customer UNION ALL SELECT c_custkey, 'test', c_nationkey FROM customer WHERE c_custkey % 50 = 0)"


def _assigned(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 10
    first = c.select(F.col("c_custkey").alias("id"), F.when(k < 8, "train").when(k == 8, "val").otherwise("test").alias("split"), "c_nationkey")
    return first.unionAll(c.where("c_custkey % 50 = 0").select("c_custkey", F.lit("test"), "c_nationkey"))


@query(f"""WITH {_ASSIGN}, d AS (SELECT DISTINCT id, split FROM assigned) SELECT p.l AS "left", p.r AS "right", (SELECT count(*) FROM d a JOIN d b ON a.id = b.id WHERE a.split = p.l AND b.split = p.r) AS n
FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) p(l, r)""")
def leakage_pairs(spark, sf_dir):
    return quality.overlap_counts(_assigned(spark, sf_dir), "id")


@query("SELECT count(*) AS n FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM benchmark)")
def anti_overlap(spark, sf_dir):
    d, b = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark").select(F.md5("text").alias("h"))
    return d.join(b, F.md5(d["text"]) == F.col("h"), "left_anti").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((), (lang), (source))")
def class_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT CAST(count(*) AS BIGINT) AS n_rows, count(hse_gap) AS hse_gap, count(mbj_bandgap) AS mbj_bandgap, count(optb88vdw_bandgap) AS optb88vdw_bandgap FROM materials")
def non_null_counts(spark, sf_dir):
    return materials(spark, sf_dir).agg(F.count("*").alias("n_rows"), *(F.count(c).alias(c) for c in ("hse_gap", "mbj_bandgap", "optb88vdw_bandgap")))


_PROPS = ["ehull", "density", "hse_gap", "shear_modulus_gv"]
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT jid, part, '{p}' AS property, {p} AS value FROM materials WHERE {p} IS NOT NULL" for p in _PROPS) + ")"


def _long(spark, sf_dir):
    return quality.long_form(materials(spark, sf_dir), _PROPS, ["jid", "part"])


@query(f'{WITH}, {_LONG} SELECT property, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS least, round(max(value), 6) AS most FROM long GROUP BY 1')
def property_summary_pop(spark, sf_dir):
    return rounded(quality.summarize(_long(spark, sf_dir)), "mean", "std", "least", "most")


@query(f'{WITH}, {_LONG} SELECT property, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS least, round(max(value), 6) AS most FROM long GROUP BY 1')
def property_summary_samp(spark, sf_dir):
    return rounded(quality.summarize(_long(spark, sf_dir), sample=True), "mean", "std", "least", "most")


@query(f"{WITH}, {_LONG}, m AS (SELECT property, median(value) AS md FROM long GROUP BY 1) SELECT property, round(any_value(md), 6) AS median, round(median(abs(value - md)), 6) AS mad FROM long JOIN m USING (property) GROUP BY 1")
def median_mad(spark, sf_dir):
    return rounded(quality.median_mad(_long(spark, sf_dir)), "median", "mad")


@query(f"""{WITH}, {_LONG}, r AS (SELECT *, row_number() OVER (PARTITION BY property ORDER BY value) AS k, count(*) OVER (PARTITION BY property) AS n FROM long),
m AS (SELECT property, value AS md, n FROM r WHERE k = n // 2 + 1), d AS (SELECT long.*, abs(long.value - md) AS dist, n FROM long JOIN m USING (property)),
s AS (SELECT *, row_number() OVER (PARTITION BY property ORDER BY dist) AS k FROM d), a AS (SELECT property, CASE WHEN dist = 0 THEN 1e-10 ELSE dist END AS mad FROM s WHERE k = n // 2 + 1)
SELECT property, jid, round(value, 6) AS value FROM d JOIN a USING (property) WHERE n >= 3 AND dist > 1.5 * 1.4826 * mad""")
def robust_outliers_upper_median(spark, sf_dir):
    return rounded(quality.outliers(_long(spark, sf_dir), "jid", sigma=1.5), "value")


@query(f"""{WITH}, md AS (SELECT median(ehull) AS a, median(density) AS b FROM materials), mm AS (SELECT median(abs(ehull - a)) AS ma, median(abs(density - b)) AS mb FROM materials, md)
SELECT jid FROM materials, md, mm WHERE abs(ehull - a) * 0.6745 / ma > 1.8 OR abs(density - b) * 0.6745 / mb > 1.8""")
def modified_z_filter(spark, sf_dir):
    return quality.remove_outliers(materials(spark, sf_dir), ["ehull", "density"], cut=1.8)[1].select("jid")


@query(f"""{WITH} SELECT jid, list_filter([CASE WHEN hse_gap IS NULL THEN 'hse_gap' END, CASE WHEN mbj_bandgap IS NULL THEN 'mbj_bandgap' END], lambda x: x IS NOT NULL) AS missing FROM materials WHERE hse_gap IS NULL OR mbj_bandgap IS NULL""")
def schema_violations(spark, sf_dir):
    return quality.schema_violations(materials(spark, sf_dir), ["jid", "hse_gap", "mbj_bandgap"])


@query(f"{WITH} SELECT jid, 'missing' AS provenance_type FROM materials WHERE provenance_type IS NULL")
def provenance_violations(spark, sf_dir):
    return quality.provenance_violations(materials(spark, sf_dir))


@query(f"{WITH} SELECT jid, 'density' AS property, 'kg/m3' AS unit FROM materials WHERE size % 9 = 0")
def unit_check(spark, sf_dir):
    table = materials(spark, sf_dir).withColumn("density_unit", F.when(F.col("size") % 9 == 0, " KG/m3 ").when(F.col("size") % 2 == 0, "g/cm3"))
    return quality.unit_violations(table, ["density", "ehull"], {"density": ["g/cm3"], "ehull": ["ev/atom"]})


TRUST_STATS = {"ehull": {"mean": 0.1, "std": 0.01}, "hse_gap": {"median": 3.0, "mad": 0.5}}
_TRUST = """trust AS (SELECT jid, CAST(CASE provenance_type WHEN 'dft_primary' THEN 30 WHEN 'experimental' THEN 25 WHEN 'db_import' THEN 20 WHEN 'literature' THEN 12 WHEN 'synthetic' THEN 8 ELSE 0 END
+ 5 * ((provenance_type IS NOT NULL)::INT + 1 + (source_version <> '')::INT + 1) + 28 + CASE WHEN abs(ehull - 0.1) / 0.01 <= 3 THEN 7.5 WHEN abs(ehull - 0.1) / 0.01 <= 5 THEN 4 ELSE 0 END + CASE WHEN abs(hse_gap - 3) / (1.4826 * 0.5) <= 3 THEN 7.5 WHEN abs(hse_gap - 3) / (1.4826 * 0.5) <= 5 THEN 4 ELSE 0 END AS DOUBLE) AS trust_score FROM materials)"""


@query(f"{WITH}, {_TRUST} SELECT jid, trust_score, CASE WHEN trust_score >= 70 THEN 'benchmark' WHEN trust_score >= 40 THEN 'curated' ELSE 'raw' END AS trust_tier FROM trust")
def trust_scores(spark, sf_dir):
    return quality.trust(materials(spark, sf_dir), TRUST_STATS).select("jid", "trust_score", "trust_tier")


@query(f"{WITH}, {_TRUST} SELECT t AS trust_tier, (SELECT count(*) FROM trust WHERE CASE WHEN trust_score >= 70 THEN 'benchmark' WHEN trust_score >= 40 THEN 'curated' ELSE 'raw' END = t) AS n FROM (VALUES ('benchmark'), ('curated'), ('raw')) v(t)")
def trust_tiers(spark, sf_dir):
    return quality.tier_counts(quality.trust(materials(spark, sf_dir), TRUST_STATS))


@query(f"""{WITH} SELECT n_rows, missing, list_filter([CASE WHEN missing > 10 THEN 'missing' END, CASE WHEN n_rows > 1000000000 THEN 'n_rows' END], lambda x: x IS NOT NULL) AS failures, missing <= 10 AS gate_pass
FROM (SELECT count(*) AS n_rows, count(*) - count(hse_gap) AS missing FROM materials)""")
def gate_report(spark, sf_dir):
    one = materials(spark, sf_dir).agg(F.count("*").alias("n_rows"), (F.count("*") - F.count("hse_gap")).alias("missing"))
    return quality.gates(one, {"missing": 10, "n_rows": 10**9})


_SIDES = "old AS (SELECT event_type AS property, value FROM events WHERE ts < TIMESTAMP '2024-01-16'), new AS (SELECT event_type AS property, value FROM events WHERE ts >= TIMESTAMP '2024-01-16')"


def _sides(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("property"), "value", "ts", F.col("event_id").alias("key"))
    at = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return e.where(F.col("ts") < at).drop("ts"), e.where(F.col("ts") >= at).drop("ts")


@query(f"""WITH {_SIDES}, a AS (SELECT property, avg(value) AS m, stddev_pop(value) AS s FROM old GROUP BY 1), b AS (SELECT property, avg(value) AS m FROM new GROUP BY 1)
SELECT property, round(abs(b.m - a.m) / CASE WHEN s > 1e-12 THEN s ELSE 1 END, 6) AS shift, abs(b.m - a.m) / CASE WHEN s > 1e-12 THEN s ELSE 1 END > 0.5 AS alert FROM a JOIN b USING (property)""")
def mean_shift(spark, sf_dir):
    return rounded(quality.mean_shift(*_sides(spark, sf_dir)), "shift")


_CDF = """u AS (SELECT property, value, 1 AS o, 0 AS n FROM old UNION ALL SELECT property, value, 0, 1 FROM new), g AS (SELECT property, value, sum(o) AS o, sum(n) AS n FROM u GROUP BY 1, 2),
f AS (SELECT property, value, sum(o) OVER w / sum(o) OVER (PARTITION BY property) AS fo, sum(n) OVER w / sum(n) OVER (PARTITION BY property) AS fn, lead(value) OVER w2 AS nx FROM g WINDOW w AS (PARTITION BY property ORDER BY value ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY property ORDER BY value))"""


@query(f"WITH {_SIDES}, {_CDF} SELECT property, round(sum(abs(fo - fn) * (nx - value)), 6) AS wasserstein FROM f GROUP BY 1")
def wasserstein1(spark, sf_dir):
    return rounded(drift.wasserstein(*_sides(spark, sf_dir)), "wasserstein")


@query(f"WITH {_SIDES}, {_CDF} SELECT property, round(max(abs(fo - fn)), 6) AS ks_stat FROM f GROUP BY 1")
def ks_stat(spark, sf_dir):
    return rounded(drift.kolmogorov_smirnov(*_sides(spark, sf_dir)).select("property", "ks_stat"), "ks_stat")


@query(f"""WITH {_SIDES}, u AS (SELECT property, value, 1 AS o, 0 AS n FROM old UNION ALL SELECT property, value, 0, 1 FROM new), s AS (SELECT property, min(value) AS lo, max(value) AS hi, sum(o) AS so, sum(n) AS sn FROM u GROUP BY 1),
b AS (SELECT property, least(floor((value - lo) / ((hi - lo) / 50)), 49) AS bin, sum(n) / any_value(sn) + 1e-8 AS p, sum(o) / any_value(so) + 1e-8 AS q FROM u JOIN s USING (property) GROUP BY 1, 2)
SELECT property, round(greatest(sum(p * ln(p / q)), 0), 6) AS kl FROM b GROUP BY 1""")
def kl_hist(spark, sf_dir):
    return rounded(drift.histogram_kl(*_sides(spark, sf_dir)), "kl")


@query("""WITH t AS (SELECT p_brand AS property, round((sum(p_size) % 97) / 97.0::DOUBLE, 6) AS ks_pvalue FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY ks_pvalue, property) AS k, count(*) OVER () AS m FROM t)
SELECT property, ks_pvalue, round(least(1, min(ks_pvalue * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_value FROM r""")
def bh_qvalues(spark, sf_dir):
    t = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("property")).agg(F.round((F.sum("p_size") % 97) / F.lit(97.0), 6).alias("ks_pvalue"))
    return rounded(drift.q_values(t), "q_value")


@query()
def drift_alerts(spark, sf_dir):
    return drift.drift(*_sides(spark, sf_dir))


@query(f"{WITH} SELECT jid, CASE WHEN e1 = e2 THEN MAP {{e1: c1 + c2}}[e1] ELSE c1 END AS first_count, CASE WHEN e1 = e2 THEN 1 ELSE 2 END AS n_elements, CASE WHEN e1 = e2 THEN c1 + c2 ELSE c1 + c2 END AS n_atoms FROM materials")
def parse_formula(spark, sf_dir):
    p = chem.parse_formula(F.col("formula"))
    return materials(spark, sf_dir).select("jid", p.alias("p")).select("jid", F.get(F.map_values("p"), F.lit(0)).alias("first_count"), F.size("p").alias("n_elements"), chem.n_atoms(F.col("p")).alias("n_atoms"))


@query(f"{WITH} SELECT CASE WHEN e1 = e2 THEN e1 ELSE least(e1, e2) || '-' || greatest(e1, e2) END AS system, count(*) AS n FROM materials GROUP BY 1")
def chem_system(spark, sf_dir):
    return materials(spark, sf_dir).groupBy(chem.chemical_system(F.col("formula")).alias("system")).agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT jid, round({_COMPLEX}, 6) AS complexity FROM materials")
def formula_entropy(spark, sf_dir):
    return materials(spark, sf_dir).select("jid", r6(chem.complexity(chem.parse_formula(F.col("formula")))).alias("complexity"))


_MASS = dict(zip(chem.SYMBOLS, chem.MASSES, strict=True))
_MASS_SQL = lambda e: f"(CASE {e} " + " ".join(f"WHEN '{s}' THEN {_MASS[s]}::DOUBLE" for s in ("Li", "O", "Fe", "Na", "Cl", "Bi", "Te", "Si", "C", "Sn")) + " END)"


@query(f"{WITH} SELECT jid, round((c1 * {_MASS_SQL('e1')} + c2 * {_MASS_SQL('e2')}), 4) AS molar_mass FROM materials")
def molar_mass(spark, sf_dir):
    return materials(spark, sf_dir).select("jid", F.round(chem.molar_mass(chem.parse_formula(F.col("formula"))), 4).alias("molar_mass"))


@query(f"{WITH} SELECT jid, CASE WHEN spg_number BETWEEN 1 AND 230 THEN CASE WHEN spg_number <= 2 THEN 0 WHEN spg_number <= 15 THEN 1 WHEN spg_number <= 74 THEN 2 WHEN spg_number <= 142 THEN 3 WHEN spg_number <= 167 THEN 4 WHEN spg_number <= 194 THEN 5 ELSE 6 END END AS crystal_system FROM materials")
def crystal_system(spark, sf_dir):
    return materials(spark, sf_dir).select("jid", chem.crystal_system(chem.space_group(F.col("spg_number"))).alias("crystal_system"))


@query(f"{WITH}, {FUSED} SELECT jid, round(bandgap_best, 6) AS bandgap_best, round(bandgap_fused, 6) AS bandgap_fused, round(bandgap_fused_std, 6) AS bandgap_fused_std, bandgap_method_count FROM fused")
def gap_fusion(spark, sf_dir):
    return rounded(fusion.gap_columns(materials(spark, sf_dir)).select("jid", "bandgap_best", "bandgap_fused", "bandgap_fused_std", "bandgap_method_count"), "bandgap_best", "bandgap_fused", "bandgap_fused_std")


@query(f"{WITH}, {FUSED}, {CLASSED} SELECT jid, round(p_metal, 5) AS p_metal, round(p_semimetal, 5) AS p_semimetal, round(p_semiconductor, 5) AS p_semiconductor, round(p_insulator, 5) AS p_insulator, conductivity_class FROM classed")
def class_probabilities(spark, sf_dir):
    names = [f"p_{c}" for c in fusion.CLASSES]
    got = fusion.class_columns(fusion.gap_columns(materials(spark, sf_dir)))
    return got.select("jid", *(r6(F.col(c), 5).alias(c) for c in names), "conductivity_class")


@query(f"{WITH} SELECT jid, round({phi('((0.1 - ehull) / 0.03)')}, 6) AS stability_probability FROM materials WHERE {phi('((0.1 - ehull) / 0.03)')} >= 0.5")
def stability_probability(spark, sf_dir):
    return rounded(search.stable(materials(spark, sf_dir), 0.1, 0.5).select("jid", "stability_probability"), "stability_probability")


_SIG = lambda x: f"(1 / (1 + exp(-least(greatest({x}, -50), 50))))"


@query(f"""{WITH}, p AS (SELECT jid, exp(0.7 * ln(least(greatest({_SIG('(spillage - 0.5) / 0.1')}, 1e-9), 1)) + 0.2 * ln(least(greatest({phi('((0.1 - ehull) / 0.03)')}, 1e-9), 1))
+ 0.1 * ln(least(greatest(coalesce({_SIG('(0.3 - optb88vdw_bandgap) / 0.2')}, 0.5), 1e-9), 1))) AS topo_probability FROM materials) SELECT jid, round(topo_probability, 6) AS topo_probability FROM p WHERE topo_probability >= 0.2""")
def topology_probability(spark, sf_dir):
    m = materials(spark, sf_dir)
    p = search.topology_probability(F.col("spillage"), search.stability_probability(F.col("ehull")), F.col("optb88vdw_bandgap"))
    return rounded(m.select("jid", p.alias("topo_probability")).where("topo_probability >= 0.2"), "topo_probability")


@query(f"""{WITH} SELECT jid, round(CASE WHEN {_SOLID} THEN 9 * bulk_modulus_kv * shear_modulus_gv / (3 * bulk_modulus_kv + shear_modulus_gv) END, 5) AS youngs_modulus, round(bulk_modulus_kv / shear_modulus_gv, 6) AS pugh_ratio,
bulk_modulus_kv / shear_modulus_gv > 1.75 AS is_ductile, round(greatest(2 * pow(pow(shear_modulus_gv / bulk_modulus_kv, 2) * shear_modulus_gv, 0.585) - 3, 0), 5) AS hardness_chen FROM materials""")
def elastic_derived(spark, sf_dir):
    t = physics.elastic_columns(materials(spark, sf_dir))
    return t.select("jid", r6(F.col("youngs_modulus"), 5).alias("youngs_modulus"), r6(F.col("pugh_ratio")).alias("pugh_ratio"), "is_ductile", r6(F.col("hardness_chen"), 5).alias("hardness_chen"))


@query(f"""{WITH}, {FUSED}, {CLASSED} SELECT jid, formula, conductivity_class, ehull FROM classed WHERE ehull <= 0.2 AND conductivity_class = 'insulator' ORDER BY jid LIMIT 50""")
def search_by_class(spark, sf_dir):
    """The first 50 of a conductivity class."""
    table = fusion.class_columns(fusion.gap_columns(materials(spark, sf_dir)))
    return search.search(table, search.build_criteria(ehull_max=0.2) | {"conductivity_class": "insulator"}, "jid", limit=50).select("jid", "formula", "conductivity_class", "ehull")


_EI_Z = "((spillage - 0.5) / greatest(ehull, 1e-9))"


@query(f"{WITH} SELECT jid, round(greatest(greatest(ehull, 1e-9) * ({_EI_Z} * {phi(_EI_Z)} + exp(-0.5 * {_EI_Z} * {_EI_Z}) / sqrt(2 * pi())), 0), 6) AS ei, round({phi(_EI_Z)}, 6) AS pi, round(spillage + 2 * ehull, 6) AS ucb, round(spillage - 2 * ehull, 6) AS lcb FROM materials")
def acquisitions(spark, sf_dir):
    a = lambda n: r6(acquisition.acquire(n, F.col("spillage"), F.col("ehull"), 0.5))
    return materials(spark, sf_dir).select("jid", a("expected_improvement").alias("ei"), a("pi").alias("pi"), a("ucb").alias("ucb"), a("lcb").alias("lcb"))


@query(f"{WITH} SELECT jid, round(spillage, 6) AS x, round(-ehull, 6) AS y FROM materials a WHERE NOT EXISTS (SELECT 1 FROM materials b WHERE b.spillage >= a.spillage AND b.ehull <= a.ehull AND (b.spillage > a.spillage OR b.ehull < a.ehull))")
def pareto_front(spark, sf_dir):
    t = materials(spark, sf_dir).select("jid", F.col("spillage").alias("x"), (-F.col("ehull")).alias("y"))
    return rounded(pareto.pareto_front(t, ["x", "y"]), "x", "y")


@query(f"""{WITH}, g AS (SELECT spillage AS x, max(1 - ehull) AS y FROM materials WHERE spillage > 0 AND 1 - ehull > 0 GROUP BY 1), s AS (SELECT (x - coalesce(lag(x) OVER (ORDER BY x), 0)) * max(y) OVER (ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM g)
SELECT round(sum(a), 6) AS hypervolume FROM s""")
def hypervolume_2d(spark, sf_dir):
    t = materials(spark, sf_dir).select(F.col("spillage").alias("x"), (1 - F.col("ehull")).alias("y"))
    return rounded(pareto.hypervolume_2d(t, "x", "y"), "hypervolume")


@query(f"""{WITH}, a AS (SELECT source_key, jid, ehull, density FROM materials), e AS (SELECT *, lag(ehull) OVER w AS l, lead(ehull) OVER w AS n, max(ehull) OVER v - min(ehull) OVER v AS s FROM a WINDOW w AS (PARTITION BY source_key ORDER BY ehull, jid), v AS (PARTITION BY source_key)),
d AS (SELECT *, lag(density) OVER w AS l2, lead(density) OVER w AS n2, max(density) OVER v - min(density) OVER v AS s2 FROM e WINDOW w AS (PARTITION BY source_key ORDER BY density, jid), v AS (PARTITION BY source_key))
SELECT jid, round(CASE WHEN l IS NULL OR n IS NULL OR l2 IS NULL OR n2 IS NULL THEN NULL ELSE CASE WHEN s > 0 THEN (n - l) / s ELSE 0 END + CASE WHEN s2 > 0 THEN (n2 - l2) / s2 ELSE 0 END END, 6) AS crowding FROM d""")
def crowding_distance(spark, sf_dir):
    return rounded(pareto.crowding(materials(spark, sf_dir), ["ehull", "density"], "source_key", "jid").select("jid", "crowding"), "crowding")


@query(f"""WITH RECURSIVE {MATERIALS}, m AS MATERIALIZED (SELECT jid, spillage AS a, -ehull AS b, density AS c FROM materials),
dom AS MATERIALIZED (SELECT x.jid AS over, y.jid AS jid FROM m x JOIN m y ON x.a >= y.a AND x.b >= y.b AND x.c >= y.c AND (x.a > y.a OR x.b > y.b OR x.c > y.c)),
chain AS (SELECT jid, 0 AS front FROM m UNION SELECT dom.jid, chain.front + 1 FROM chain JOIN dom ON chain.jid = dom.over) SELECT jid, max(front) AS front FROM chain GROUP BY 1""")
def non_dominated_sort(spark, sf_dir):
    t = materials(spark, sf_dir).select("jid", "spillage", (-F.col("ehull")).alias("e"), "density")
    return pareto.fronts(t, ["spillage", "e", "density"], "jid")


def _diverse_sql(k: int) -> str:
    """Greedy picks, one after the other: the score less half the highest cosine to those picked."""
    said = ["t0 AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v, label / 10.0::DOUBLE AS score, 0.0::DOUBLE AS near, false AS gone FROM embeddings)"]
    for i in range(k):
        said.append(f"p{i} AS MATERIALIZED (SELECT vec_id, v FROM t{i} WHERE NOT gone ORDER BY score - 0.5::DOUBLE * near DESC, score DESC, vec_id LIMIT 1)")
        said.append(f"t{i + 1} AS MATERIALIZED (SELECT t.vec_id, t.v, score, greatest(near, list_cosine_similarity(t.v, p.v)) AS near, gone OR t.vec_id = p.vec_id AS gone FROM t{i} t, p{i} p)")
    return "WITH " + ", ".join(said) + " " + " UNION ALL ".join(f"SELECT vec_id, CAST({i} AS INTEGER) AS pick FROM p{i}" for i in range(k))


@query(_diverse_sql(20))
def diverse_selection(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumn("score", F.col("label") / 10)
    return pareto.select_diverse(e, "score", "vec_id", "embedding", 20)


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p0 AS MATERIALIZED (SELECT vec_id, v FROM e ORDER BY vec_id LIMIT 1), d1 AS MATERIALIZED (SELECT e.vec_id, e.v, list_distance(e.v, p0.v) AS d FROM e, p0),
p1 AS MATERIALIZED (SELECT vec_id, v FROM d1 ORDER BY d DESC, vec_id LIMIT 1), d2 AS MATERIALIZED (SELECT d1.vec_id, d1.v, least(d, list_distance(d1.v, p1.v)) AS d FROM d1, p1),
p2 AS MATERIALIZED (SELECT vec_id, v FROM d2 ORDER BY d DESC, vec_id LIMIT 1), d3 AS MATERIALIZED (SELECT d2.vec_id, d2.v, least(d, list_distance(d2.v, p2.v)) AS d FROM d2, p2), p3 AS (SELECT vec_id FROM d3 ORDER BY d DESC, vec_id LIMIT 1)
SELECT vec_id, CAST(0 AS INTEGER) AS pick FROM p0 UNION ALL SELECT vec_id, 1 FROM p1 UNION ALL SELECT vec_id, 2 FROM p2 UNION ALL SELECT vec_id, 3 FROM p3""")
def k_center(spark, sf_dir):
    return pareto.k_center(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4)


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0) SELECT q.vec_id, round(max(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 5) AS nearest FROM embeddings e JOIN q ON e.vec_id <> q.vec_id GROUP BY 1""")
def knn_ood(spark, sf_dir):
    """Every twentieth id is a query, against all rows."""
    e = read(spark, sf_dir, "embeddings")
    got = similarity.nearest_cosine(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding")
    return got.select("vec_id", F.round("nearest", 5).alias("nearest"))


@query("""WITH l AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM l GROUP BY 1, 2), g AS (SELECT label, list(v ORDER BY i) AS v FROM m GROUP BY 1)
SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.v, b.v), 5) AS cosine FROM g a JOIN g b ON a.label < b.label""")
def cosine_group_sim(spark, sf_dir):
    return similarity.group_similarity(read(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("cosine", F.round("cosine", 5))


_SHA = "sha256(string_agg(id, chr(10) ORDER BY id))"


@query(f"""WITH a AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand FROM part), p AS (SELECT p_brand, substr(md5(id), 1, 2) AS k, count(*) AS n, {_SHA} AS h FROM a GROUP BY 1, 2)
SELECT p_brand, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, chr(10) ORDER BY k)) AS ids_sha256 FROM p GROUP BY 1""")
def ids_hash(spark, sf_dir):
    return splits.id_hash(read(spark, sf_dir, "part"), "p_partkey", ["p_brand"])


_IID = """h AS (SELECT c_custkey, md5('42:' || c_custkey) AS h FROM customer), k AS (SELECT *, row_number() OVER (ORDER BY CAST('0x' || substr(h, 1, 4) AS INTEGER) % 256, h, c_custkey) AS pos, count(*) OVER () AS n FROM h)"""


@query(f"WITH {_IID} SELECT c_custkey, CASE WHEN pos <= n - 2 * (n // 10) THEN 'train' WHEN pos <= n - n // 10 THEN 'val' ELSE 'test' END AS split FROM k")
def iid_split(spark, sf_dir):
    return splits.iid_split(read(spark, sf_dir, "customer"), "c_custkey")


def _search_sql(groups: str, similar: str) -> str:
    """The search of split_search for (group, trait, n, ls, lc, lq) in ``groups``: a row of state for each restart, a group a step."""
    split = (1, 2, 3)
    after = lambda c, own, i: f"({c}[{i}] + CASE WHEN t = {i} THEN {own} ELSE 0 END - CASE WHEN src = {i} THEN {own} ELSE 0 END)"
    square = lambda x: f"(({x}) * ({x}))"
    size = " + ".join(square(f"({after('sz', 'n', i)} - w[{i}] * nn) / greatest(w[{i}] * nn, 1)") for i in split)
    number = " + ".join(square(f"({after('gr', '1', i)} - w[{i}] * gg) / greatest(w[{i}] * gg, 1)") for i in split)
    label = " + ".join(f"CASE WHEN {after('lc', 'c', i)} <= 0 THEN 1.0::DOUBLE ELSE {square(f'({after('ls', 'l', i)} / {after('lc', 'c', i)} - mean) / scale')} END" for i in split)
    across = lambda s: f"(CASE {s} WHEN 1 THEN 0.5::DOUBLE * near[2] + near[3] WHEN 2 THEN 0.5::DOUBLE * (near[1] + near[3]) WHEN 3 THEN near[1] + 0.5::DOUBLE * near[2] ELSE 0 END)"
    leak = f"(leak + {across('t')} - {across('src')})"
    put = lambda c, own: f"[{', '.join(f'{c}[{i}] + CASE WHEN f = {i} THEN {own} ELSE 0 END - CASE WHEN src = {i} THEN {own} ELSE 0 END' for i in split)}]"
    pick = lambda k: f"CASE WHEN src <> {k} AND cost[{k}] + 1e-12 < l{k - 1} THEN {k} ELSE f{k - 1} END AS f{k}, CASE WHEN src <> {k} AND cost[{k}] + 1e-12 < l{k - 1} THEN cost[{k}] ELSE l{k - 1} END AS l{k}"
    return f"""WITH RECURSIVE {groups},
tot AS (SELECT CAST(sum(n) AS DOUBLE) AS nn, CAST(count(*) AS DOUBLE) AS gg, sum(ls) / sum(lc) AS mean, greatest(sqrt(greatest(sum(lq) / sum(lc) - (sum(ls) / sum(lc)) * (sum(ls) / sum(lc)), 1e-12)), 1e-6) AS scale, [0.8::DOUBLE, 0.1::DOUBLE, 0.1::DOUBLE] AS w FROM g),
o AS (SELECT r, g.*, row_number() OVER (PARTITION BY r ORDER BY n DESC, md5('42:' || r || ':' || "group"), "group") AS k FROM g, range(8) AS t(r)),
near0 AS (SELECT a.r, a.k, a.n, a.ls AS l, a.lc AS c, list(CASE WHEN a.k = b.k THEN 0.0::DOUBLE ELSE {similar} END ORDER BY b.k) AS sim FROM o a JOIN o b ON a.r = b.r GROUP BY ALL),
rec AS (SELECT r, 1 AS u, 0 AS pass, FALSE AS moved, FALSE AS done, [0.0::DOUBLE, 0, 0] AS sz, [0.0::DOUBLE, 0, 0] AS gr, [0.0::DOUBLE, 0, 0] AS ls, [0.0::DOUBLE, 0, 0] AS lc, 0.0::DOUBLE AS leak, list_transform(range(CAST(gg AS BIGINT)), lambda x: 0) AS at_, 0.0::DOUBLE AS final FROM range(8) AS t(r), tot
UNION ALL
SELECT r, CASE WHEN u = gg THEN 1 ELSE u + 1 END, pass + CASE WHEN u = gg THEN 1 ELSE 0 END, CASE WHEN u = gg THEN FALSE ELSE moved OR f <> src END, u = gg AND pass > 0 AND (pass = 64 OR NOT (moved OR f <> src)),
{put('sz', 'n')}, {put('gr', '1')}, {put('ls', 'l')}, {put('lc', 'c')}, leak + {across('f')} - {across('src')}, list_transform(at_, lambda x, i: CASE WHEN i = u THEN f ELSE x END), cost[f]
FROM (SELECT *, CASE WHEN pass > 0 AND gr[src] <= 1 THEN src ELSE f3 END AS f FROM (SELECT *, {pick(3)} FROM (SELECT *, {pick(2)} FROM (SELECT *, {pick(1)} FROM
(SELECT *, CASE WHEN pass = 0 THEN 1e300 ELSE cost[src] END AS l0, CASE WHEN pass = 0 THEN 0 ELSE src END AS f0 FROM
(SELECT *, list_transform([1, 2, 3], lambda t: {size} + 0.15::DOUBLE * ({number}) + 0.2::DOUBLE * ({label}) / 3 + 0.2::DOUBLE * {leak} / greatest(gg * (gg - 1) / 2, 1)) AS cost FROM
(SELECT rec.*, n, l, c, tot.*, at_[u] AS src, [list_sum(list_transform(sim, lambda x, i: CASE WHEN at_[i] = 1 THEN x ELSE 0 END)), list_sum(list_transform(sim, lambda x, i: CASE WHEN at_[i] = 2 THEN x ELSE 0 END)), list_sum(list_transform(sim, lambda x, i: CASE WHEN at_[i] = 3 THEN x ELSE 0 END))] AS near
FROM rec JOIN near0 ON rec.r = near0.r AND rec.u = near0.k, tot WHERE NOT done)))))))),
best AS (SELECT r, at_ FROM rec WHERE done ORDER BY round(final, 9), r LIMIT 1),
dealt AS (SELECT "group", ['train', 'val', 'test'][at_[k]] AS split FROM best JOIN o USING (r))
SELECT jid, "group", split FROM m JOIN dealt USING ("group")"""


_GROUPED = 'g AS (SELECT "group", trait, count(*) AS n, CAST(sum(size) AS DOUBLE) AS ls, CAST(count(size) AS DOUBLE) AS lc, CAST(sum(size * size) AS DOUBLE) AS lq FROM m GROUP BY ALL)'


@query(_search_sql(f"""{MATERIALS}, m AS (SELECT jid, size, list_sort(list_distinct([e1, e2])) AS trait, array_to_string(list_sort(list_distinct([e1, e2])), '-') AS "group" FROM materials), {_GROUPED}""",
"CAST(len(list_intersect(a.trait, b.trait)) AS DOUBLE) / len(list_distinct(list_concat(a.trait, b.trait)))"))
def compositional_split(spark, sf_dir):
    return splits.compositional_split(materials(spark, sf_dir), "jid", target="size")


_SYSTEM = "(({0} > 2)::INT + ({0} > 15)::INT + ({0} > 74)::INT + ({0} > 142)::INT + ({0} > 167)::INT + ({0} > 194)::INT)"


@query(_search_sql(f"""{MATERIALS}, m AS (SELECT jid, size, CASE WHEN spg_number BETWEEN 1 AND 230 THEN spg_number END AS trait, CAST(spg_number AS VARCHAR) AS "group" FROM materials), {_GROUPED}""",
f"coalesce(CASE WHEN {_SYSTEM.format('a.trait')} = {_SYSTEM.format('b.trait')} THEN 0.6::DOUBLE ELSE 0 END + 0.4::DOUBLE * greatest(0, 1 - abs(a.trait - b.trait) / 230::DOUBLE), 0)"))
def prototype_split(spark, sf_dir):
    return splits.prototype_split(materials(spark, sf_dir), "jid", "spg_number", target="size")


@query(f"""WITH {_IID}, a AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN pos <= n - 2 * (n // 10) THEN 'train' WHEN pos <= n - n // 10 THEN 'val' ELSE 'test' END AS split FROM k),
p AS (SELECT split, substr(md5(id), 1, 2) AS k, count(*) AS n, {_SHA} AS h FROM a GROUP BY 1, 2), s AS (SELECT split, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, chr(10) ORDER BY k)) AS h FROM p GROUP BY 1),
j AS (SELECT '{{"seed":42,"splits":{{' || string_agg('"' || split || '":{{"n":' || n || ',"ids_sha256":"' || h || '"}}', ',' ORDER BY split) || '}}}}' AS said FROM s)
SELECT split, n, h AS ids_sha256, CAST(0 AS BIGINT) AS overlap, 42 AS seed, sha256(said) AS manifest_id FROM s, j""")
def split_manifest(spark, sf_dir):
    made = splits.manifest(splits.iid_split(read(spark, sf_dir, "customer"), "c_custkey"), "c_custkey")
    return made.select(F.explode("splits").alias("split", "s"), "overlap", "seed", "manifest_id").select("split", "s.n", "s.ids_sha256", "overlap", "seed", "manifest_id")


_PRED = "pr AS (SELECT doc_id, 1 / (1 + exp(-(ln(n_chars) - 7))) AS p, quality AS y FROM documents JOIN labels USING (doc_id))"


def _scored(spark, sf_dir):
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return d.join(l, "doc_id").select("doc_id", (1 / (1 + F.exp(-(F.ln("n_chars") - 7)))).alias("p"), F.col("quality").alias("y"))


@query(f"""WITH {_PRED}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum((p - y) * (p - y)) AS b, sum(-y * ln(p) - (1 - y) * ln(1 - p)) AS l FROM pr GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(abs(sp - sy)) / sum(n), 6) AS ece, round(sum(b) / sum(n), 6) AS brier, round(sum(l) / sum(n), 6) AS nll FROM b""")
def calibration_metrics(spark, sf_dir):
    return rounded(fusion.calibration(_scored(spark, sf_dir), "p", "y"), "ece", "brier", "nll")


@query(f"""WITH {_PRED}, z AS (SELECT ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) AS z, y FROM pr), t AS (SELECT 0.25 * pow(32.0::DOUBLE, i / 160.0::DOUBLE) AS t FROM range(161) r(i)),
n AS (SELECT t, avg(ln(1 + exp(CASE WHEN y = 1 THEN -z / t ELSE z / t END))) AS nll FROM z, t GROUP BY 1) SELECT round(t, 6) AS temperature, round(nll, 6) AS nll FROM n ORDER BY n.nll, t LIMIT 1""")
def temperature_fit(spark, sf_dir):
    return rounded(fusion.fit_temperature(_scored(spark, sf_dir), "p", "y"), "temperature", "nll")


@query(f"""WITH {_PRED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS k FROM pr)
SELECT round((sum(CASE WHEN y = 1 THEN k ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)), 6) AS auc FROM r""")
def auc(spark, sf_dir):
    return rounded(metrics.auc(_scored(spark, sf_dir), "p", "y"), "auc")


@query(f"""WITH {_PRED}, c AS (SELECT count(*) AS n, CAST(sum((p >= 0.5)::INT * y) AS BIGINT) AS tp, CAST(sum((p >= 0.5)::INT * (1 - y)) AS BIGINT) AS fp, CAST(sum((p < 0.5)::INT * y) AS BIGINT) AS fn, CAST(sum((p < 0.5)::INT * (1 - y)) AS BIGINT) AS tn FROM pr)
SELECT n, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""")
def classification_metrics(spark, sf_dir):
    return rounded(metrics.classification(_scored(spark, sf_dir), "p", "y"), "accuracy", "precision", "recall", "f1")


@query(f"""{WITH}, e AS (SELECT source_key, density AS t, 5 + ehull * 3 AS p FROM materials) SELECT source_key, count(*) AS n, round(avg(abs(t - p)), 6) AS mae, round(sqrt(avg((t - p) * (t - p))), 6) AS rmse,
round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 6) AS r2, round(max(abs(t - p)), 6) AS max_error FROM e GROUP BY 1""")
def regression_metrics(spark, sf_dir):
    t = materials(spark, sf_dir).withColumn("pred", 5 + F.col("ehull") * 3)
    return rounded(metrics.regression(t, "density", "pred", by=["source_key"]), "mae", "rmse", "r2", "max_error")


@query(f"{WITH}, r AS (SELECT abs(density - 5) AS r, row_number() OVER (ORDER BY abs(density - 5)) AS k, count(*) OVER () AS n FROM materials) SELECT round(r, 6) AS quantile FROM r WHERE k = least(ceil((n + 1) * 0.9), n)")
def conformal_quantile(spark, sf_dir):
    return rounded(metrics.conformal_quantile(materials(spark, sf_dir).withColumn("five", F.lit(5.0)), "density", "five"), "quantile")


@query(f"""{WITH}, z AS (SELECT size % 5 AS g, abs(density - 5) / greatest(ehull, 1e-8) AS t FROM materials), o AS (SELECT quantile_cont(t, 0.9) AS w FROM z)
SELECT g, count(*) AS n, round(CASE WHEN count(*) >= 16 THEN quantile_cont(t, 0.9) ELSE any_value(w) END, 5) AS scale FROM z, o GROUP BY 1""")
def conformal_scale(spark, sf_dir):
    t = materials(spark, sf_dir).withColumn("five", F.lit(5.0)).withColumn("g", F.col("size") % 5)
    return fusion.conformal_scale(t, "density", "five", "ehull", group="g").withColumn("scale", r6(F.col("scale"), 5))


@query(f"{WITH} SELECT jid, round((row_number() OVER (ORDER BY density, jid) - 1) / (count(*) OVER () - 1), 6) AS rank01 FROM materials")
def rank_normalize(spark, sf_dir):
    return rounded(ordered.rank_normalized(materials(spark, sf_dir), "density", "jid").select("jid", "rank01"), "rank01")


@query("""SELECT s_suppkey, o_top FROM (SELECT l_suppkey AS s_suppkey, l_orderkey AS o_top, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey) AS k FROM lineitem) WHERE k = 1""")
def top_per_group(spark, sf_dir):
    got = ordered.top_k_per_group(read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_extendedprice"), "l_suppkey", F.desc("l_extendedprice"), 1, "l_orderkey")
    return got.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_orderkey").alias("o_top"))


@query("""SELECT CAST(props ->> 'k' AS BIGINT) AS k, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type").agg(F.count("*").alias("n"))


_MIX = """p AS (SELECT p_brand AS alloy, p_size::DOUBLE AS w, p_retailprice / 200 AS d, p_size * 4.0::DOUBLE + 10 AS b FROM part), v AS (SELECT *, (w / d) / sum(w / d) OVER (PARTITION BY alloy) AS v FROM p)"""


@query(f"WITH {_MIX} SELECT alloy, count(*) AS n_phases, round(sum(v), 6) AS volume_sum, round(sum(v * b), 5) AS bulk_voigt, round(1 / sum(v / b), 5) AS bulk_reuss, round(-sum(v * ln(v)), 6) AS mixing_entropy FROM v GROUP BY 1")
def alloy_mixing(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("alloy"), F.col("p_partkey").alias("phase"), F.col("p_size").cast("double").alias("weight_fraction"), (F.col("p_retailprice") / 200).alias("density"), (F.col("p_size") * 4.0 + 10).alias("bulk"), F.lit(30.0).alias("shear"), F.lit(2.0).alias("conductivity"), F.lit(900.0).alias("melting"))
    got = physics.mix_alloys(p)
    return got.select("alloy", "n_phases", r6(F.col("volume_sum")).alias("volume_sum"), r6(F.col("bulk_voigt"), 5).alias("bulk_voigt"), r6(F.col("bulk_reuss"), 5).alias("bulk_reuss"), r6(F.col("mixing_entropy")).alias("mixing_entropy"))


@query("SELECT label, property, count(*) AS n, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std FROM (SELECT label, 'x' AS property, embedding[1]::DOUBLE AS v FROM embeddings UNION ALL SELECT label, 'y', embedding[2]::DOUBLE FROM embeddings) GROUP BY 1, 2")
def cluster_summary(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    got = quality.cluster_summary(e, "label", ["x", "y"])
    return got.select("label", "property", "n", r6(F.col("mean"), 5).alias("mean"), r6(F.col("std"), 5).alias("std"))


@query("""WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 < 8 THEN 'train' WHEN c_custkey % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM customer),
b AS (SELECT c_custkey AS k, CASE WHEN (c_custkey + 1) % 10 < 8 THEN 'train' WHEN (c_custkey + 1) % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM customer)
SELECT split, round(count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) / count(*), 9) AS jaccard FROM a FULL JOIN b USING (k, split) GROUP BY split""")
def split_jaccard(spark, sf_dir):
    ids = read(spark, sf_dir, "customer").select("c_custkey")
    part = lambda shift: ids.withColumn("split", F.when((F.col("c_custkey") + shift) % 10 < 8, "train").when((F.col("c_custkey") + shift) % 10 == 8, "val").otherwise("test"))
    return splits.jaccard(part(0), part(1), "c_custkey").select("split", F.round("jaccard", 9).alias("jaccard"))


@query(f"""{WITH}, z AS (SELECT greatest(ehull, 1e-9) AS s, density - 5 AS e FROM materials), y AS (SELECT *, e / s AS z FROM z)
SELECT count(*) AS n, round(avg(s), 6) AS mean_std, round(avg(0.5 * ln(2 * pi()) + ln(s) + 0.5 * z * z), 4) AS nll,
round(avg(s * (z * (2 * {phi("z")} - 1) + 2 * exp(-0.5 * z * z) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 5) AS crps,
round(avg((abs(z) <= 1.6448536269514722::DOUBLE)::INT), 6) AS coverage90, round(avg((abs(z) <= 1.959963984540054::DOUBLE)::INT), 6) AS coverage95,
round(avg(2 * 1.959963984540054::DOUBLE * s + 40 * greatest(abs(e) - 1.959963984540054::DOUBLE * s, 0)), 5) AS interval_score, round(avg(z), 4) AS z_mean, round(stddev_pop(z), 4) AS z_std FROM y""")
def energy_uncertainty(spark, sf_dir):
    got = metrics.uncertainty(materials(spark, sf_dir).withColumn("five", F.lit(5.0)), "density", "five", "ehull")
    digits = {"mean_std": 6, "nll": 4, "crps": 5, "coverage90": 6, "coverage95": 6, "interval_score": 5, "z_mean": 4, "z_std": 4}
    return got.withColumns({n: r6(F.col(n), k) for n, k in digits.items()})


@query()
def bootstrap_interval(spark, sf_dir):
    return metrics.bootstrap_mean(materials(spark, sf_dir), "density", "jid", resamples=200)


@query(f"""{WITH}, h AS (SELECT * FROM materials WHERE label = 0), s AS (SELECT """ + ", ".join(f"median({p}) AS m_{p}, CASE WHEN quantile_cont({p}, 0.75) - quantile_cont({p}, 0.25) > 1e-12 * 1.349 THEN (quantile_cont({p}, 0.75) - quantile_cont({p}, 0.25)) / 1.349::DOUBLE ELSE 1 END AS s_{p}" for p in ("ehull", "density", "spillage")) + """ FROM h),
d AS (SELECT jid, label, sqrt((""" + " + ".join(f"pow(({p} - m_{p}) / s_{p}, 2)" for p in ("ehull", "density", "spillage")) + """) / 3) AS d FROM materials, s), b AS (SELECT greatest(quantile_cont(d, 0.95), 1e-12) AS b FROM d WHERE label = 0)
SELECT jid, round(1 - exp(-greatest(d / b - 1, 0)), 6) AS ood FROM d, b""")
def ood_scores(spark, sf_dir):
    m = materials(spark, sf_dir)
    return rounded(quality.ood(m, m.where("label = 0"), ["ehull", "density", "spillage"]).select("jid", "ood"), "ood")


@query(f"""WITH RECURSIVE {MATERIALS}, names AS (SELECT formula AS name, count(*) AS n, length(formula) AS la FROM materials GROUP BY ALL), q AS (SELECT 'Fe2SiO3' AS q, 7 AS lb),
eq AS (SELECT name, i, j FROM (SELECT name, unnest(range(la)) AS i FROM names), (SELECT unnest(range(lb)) AS j FROM q), q WHERE substring(name, i + 1, 1) = substring(q, j + 1, 1)),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY name, j - i ORDER BY i) AS g FROM eq), run AS (SELECT name, i, j, max(i) OVER (PARTITION BY name, j - i, g) - i + 1 AS k FROM isl),
iv AS (SELECT name, 0::BIGINT AS al, la::BIGINT AS ah, 0::BIGINT AS bl, lb::BIGINT AS bh, 0::BIGINT AS k FROM names, q UNION ALL
SELECT name, unnest([al, i + k]), unnest([i, ah]), unnest([bl, j + k]), unnest([j, bh]), unnest([k, 0]) FROM
(SELECT iv.name, al, ah, bl, bh, i, j, least(run.k, ah - i, bh - j) AS k FROM iv JOIN run ON iv.name = run.name AND i >= al AND i < ah AND j >= bl AND j < bh QUALIFY row_number() OVER (PARTITION BY iv.name, al, ah, bl, bh ORDER BY least(run.k, ah - i, bh - j) DESC, i, j) = 1)),
r AS (SELECT name, 2.0::DOUBLE * sum(k) / (la + lb) AS ratio, n FROM iv JOIN names USING (name), q GROUP BY name, la, lb, n),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY ratio DESC, name DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM r WHERE ratio >= 0.5)
SELECT name AS formula, round(ratio, 6) AS ratio, n FROM b WHERE b < 40""")
def fuzzy_search(spark, sf_dir):
    """The formulas of the 40 materials most like one that isn't there."""
    return rounded(search.fuzzy(materials(spark, sf_dir), "Fe2SiO3", cutoff=0.5, k=40), "ratio")


@query(f"""{WITH}, c AS (SELECT jid, 1 / (1 + exp(-(ehull * 10 - 1))) AS p, 0.8::DOUBLE * 0.8::DOUBLE AS w FROM materials UNION ALL SELECT jid, 1 / (1 + exp(-((spillage - 0.5) / 0.1::DOUBLE))), 0.9::DOUBLE * 0.9::DOUBLE FROM materials
UNION ALL SELECT jid, spillage, least(greatest(1 - coalesce(ehull, 0.25), 0.05), 1) * 0.5::DOUBLE FROM materials), k AS (SELECT jid, w, least(greatest(p, 1e-6), 1 - 1e-6) AS p FROM c WHERE p IS NOT NULL),
g AS (SELECT jid, sum(w * ln(p / (1 - p))) AS wl, sum(w) AS w, sum(w * w) AS ww FROM k GROUP BY 1)
SELECT jid, round(1 / (1 + exp(-wl / w)), 6) AS probability, round(w * w / ww / (1 + 0.3::DOUBLE * (w * w / ww - 1)), 6) AS n_eff FROM g""")
def pooled_topology(spark, sf_dir):
    m = materials(spark, sf_dir).withColumns({"si_score": F.col("ehull") * 10 - 1, "ml_probability": F.col("spillage"), "ml_uncertainty": F.col("ehull")})
    return rounded(fusion.pool_logits(fusion.evidence_channels(m), {"si": (8.0, 2.0), "spillage": (9.0, 1.0), "ml": (5.0, 5.0)}), "probability", "n_eff")


@query(f"""{WITH}, f AS (SELECT jid, e1, e2, c1, c2, [greatest((CASE WHEN e1 = x THEN c1 ELSE 0 END + CASE WHEN e2 = x THEN c2 ELSE 0 END) / (c1 + c2), 0) FOR x IN ['Li', 'O', 'Fe', 'Si']] AS w, {_LIST_Z}[e1] AS z1, {_LIST_Z}[e2] AS z2 FROM materials),
g AS (SELECT *, [greatest(CASE WHEN list_sum(w) > 0 THEN x / list_sum(w) ELSE 0.25 END, 1e-8) FOR x IN w] AS q, (c1 * z1 + c2 * z2) / (c1 + c2) AS zm, (c1 * z1 * z1 + c2 * z2 * z2) / (c1 + c2) AS zq FROM f)
SELECT jid, [round(x / list_sum(q), 6) FOR x IN q] AS v, CASE WHEN e1 = e2 THEN e1 || ':' || CAST(c1 + c2 AS VARCHAR) WHEN e1 < e2 THEN e1 || ':' || CAST(c1 AS VARCHAR) || '|' || e2 || ':' || CAST(c2 AS VARCHAR) ELSE e2 || ':' || CAST(c2 AS VARCHAR) || '|' || e1 || ':' || CAST(c1 AS VARCHAR) END AS signature,
round(zm, 6) AS z_mean, round(sqrt(greatest(zq - zm * zm, 0)), 4) AS z_std, CAST(least(z1, z2) AS INTEGER) AS z_least, CAST(greatest(z1, z2) AS INTEGER) AS z_most FROM g""")
def composition_vectors(spark, sf_dir):
    p = chem.parse_formula(F.col("formula"))
    t = materials(spark, sf_dir).select("jid", numeric.clr_softmax(chem.fraction_vector(p, ["Li", "O", "Fe", "Si"])).alias("v"), chem.signature(p).alias("signature"), chem.z_moments(p).alias("z"))
    return t.select("jid", F.transform("v", lambda x: F.round(x, 6)).alias("v"), "signature", r6(F.col("z.mean")).alias("z_mean"), r6(F.col("z.std"), 4).alias("z_std"), F.col("z.least").alias("z_least"), F.col("z.most").alias("z_most"))


@query(f"{WITH}, e AS (SELECT jid, unnest(list_distinct([e1, e2])) AS element FROM materials) SELECT element, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, element LIMIT 24")
def element_frequency(spark, sf_dir):
    return selection.element_frequency(materials(spark, sf_dir))


@query(f"""{WITH}, s AS (SELECT jid, row_number() OVER (ORDER BY spillage DESC, jid) AS r, row_number() OVER (ORDER BY ehull DESC, jid) AS u FROM materials),
t AS (SELECT jid, 'score' AS picked_by FROM s WHERE r <= 14), v AS (SELECT jid FROM s WHERE r > 14 ORDER BY u LIMIT 6) SELECT * FROM t UNION ALL SELECT jid, 'uncertainty' FROM v""")
def hybrid_budget(spark, sf_dir):
    return selection.hybrid_budget(materials(spark, sf_dir), "spillage", "ehull", "jid", 20).select("jid", "picked_by")


@query(f"{WITH} SELECT jid FROM materials ORDER BY md5('42:' || jid), jid LIMIT 25")
def hash_sample(spark, sf_dir):
    return selection.sample(materials(spark, sf_dir), "jid", 25).select("jid")


@query(f"""{WITH}, r AS (SELECT min(spillage) AS a, max(spillage) AS b, min(ehull) AS c, max(ehull) AS d FROM materials)
SELECT jid, round((spillage - a) / (b - a) + (1 - (ehull - c) / (d - c)), 6) AS screen_score FROM materials, r ORDER BY (spillage - a) / (b - a) + (1 - (ehull - c) / (d - c)) DESC, jid LIMIT 30""")
def multi_objective_screen(spark, sf_dir):
    return rounded(selection.screen(materials(spark, sf_dir), {"spillage": True, "ehull": False}, "jid", 30).select("jid", "screen_score"), "screen_score")


@query("""WITH t AS (SELECT unnest(list_filter([CASE WHEN p_type LIKE '%MEDIUM%' THEN 'middle' END, CASE WHEN p_type LIKE '%STANDARD%' OR p_type LIKE '%LARGE%' THEN 'usual' END, CASE WHEN p_type LIKE '%SMALL%' OR p_type LIKE '%MEDIUM%' THEN 'modest' END], lambda x: x IS NOT NULL)) AS tag FROM part) SELECT tag, count(*) AS n FROM t GROUP BY 1""")
def tag_counts(spark, sf_dir):
    rules = {"middle": ["medium"], "usual": ["standard", "large"], "modest": ["small", "medium"]}
    return selection.tag_counts(read(spark, sf_dir, "part").select(selection.tag(F.col("p_type"), rules).alias("tags")))


@query("""WITH o AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Li' ELSE 'Na' END AS "old", 'K' || (o_orderkey % 4) AS "new", CAST(o_orderkey % 10 AS DOUBLE) AS reward FROM orders) SELECT "old", "new", CAST(count(*) AS DOUBLE) AS n, sum(reward) AS reward FROM o GROUP BY 1, 2""")
def substitution_stats(spark, sf_dir):
    k = F.col("o_orderkey")
    moves = read(spark, sf_dir, "orders").select(F.concat(F.when(k % 3 == 0, "Li").otherwise("Na"), F.lit("->K"), (k % 4).cast("string"), F.lit("; bad")).alias("mutations"), (k % 10).cast("double").alias("reward"))
    return selection.update_substitutions(None, moves)


@query("""WITH a AS (SELECT s AS seed, CASE WHEN (c_custkey + s) % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM customer, range(3) t(s)), n AS (SELECT seed, split, count(*) AS n FROM a GROUP BY 1, 2)
SELECT split, count(*) AS seeds, round(avg(n), 6) AS mean, round(stddev_pop(n) / avg(n), 6) AS cv, round((max(n) - min(n)) / avg(n), 6) AS relative_range FROM n GROUP BY 1""")
def seed_stability(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seed"))
    a = c.select("seed", F.when((F.col("c_custkey") + F.col("seed")) % 10 < 8, "train").otherwise("test").alias("split"))
    return rounded(selection.seed_stability(a), "mean", "cv", "relative_range")


@query("""WITH e AS (SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 128) SELECT count(*) AS n, round(sqrt(avg((value / 100) * (value / 100))), 6) AS rms, round(quantile_cont(abs(value / 100), 0.9), 6) AS quantile FROM e""")
def recent_residuals(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.struct("ts", "event_id").alias("o"), (F.col("value") / 100).alias("z"))
    return rounded(quality.rolling_residual_scale(e, "o", "z"), "rms", "quantile")


@query("""WITH RECURSIVE x AS (SELECT s_nationkey AS n, s_suppkey, s_acctbal FROM supplier) SELECT n AS entity, count(*) AS n, round(avg(s_acctbal), 4) AS mean, round(stddev_pop(s_acctbal), 4) AS std FROM x GROUP BY 1""")
def ensemble_spread(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("entity"), "s_acctbal")
    got = metrics.ensemble(s, ["entity"], "s_acctbal").join(s.groupBy("entity").agg(F.count("*").alias("n")), "entity")
    return got.select("entity", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("""WITH RECURSIVE e AS (SELECT n_regionkey AS entity, CAST(n_nationkey AS VARCHAR) AS src, CAST((n_nationkey + d) % 25 AS VARCHAR) AS dst, (n_nationkey % 3) / 10.0::DOUBLE AS dg, (n_nationkey % 5) / 10.0::DOUBLE + 0.1::DOUBLE AS ea FROM nation, (VALUES (5), (10)) t(d)),
ends AS (SELECT n_regionkey AS entity, CAST(min(n_nationkey) AS VARCHAR) AS a, CAST(max(n_nationkey) AS VARCHAR) AS b FROM nation GROUP BY 1),
w AS (SELECT entity, a AS at, [a] AS path, 0.0::DOUBLE AS delta_g, 0.0::DOUBLE AS activation FROM ends UNION ALL SELECT w.entity, e.dst, list_append(path, e.dst), delta_g + dg, activation + ea FROM w JOIN e ON w.entity = e.entity AND w.at = e.src WHERE NOT list_contains(path, e.dst) AND len(path) <= 4),
f AS (SELECT w.entity, path, delta_g, activation, CAST(len(path) - 1 AS INTEGER) AS steps FROM w JOIN ends ON w.entity = ends.entity AND w.at = ends.b WHERE len(path) > 1),
u AS (SELECT * FROM f WHERE activation <= 3 AND delta_g <= 1 AND NOT EXISTS (SELECT 1 FROM f o WHERE o.entity = f.entity AND o.activation <= f.activation AND o.delta_g <= f.delta_g AND o.steps <= f.steps AND (o.activation < f.activation OR o.delta_g < f.delta_g OR o.steps < f.steps))),
g AS (SELECT *, 0.5::DOUBLE * coalesce((activation - min(activation) OVER x) / nullif(max(activation) OVER x - min(activation) OVER x, 0), 0) AS g1, 0.4::DOUBLE * coalesce((delta_g - min(delta_g) OVER x) / nullif(max(delta_g) OVER x - min(delta_g) OVER x, 0), 0) AS g2,
  0.1::DOUBLE * coalesce((steps - min(steps) OVER x) / nullif(max(steps) OVER x - min(steps) OVER x, 0), 0) AS g3 FROM u WINDOW x AS (PARTITION BY entity)),
r AS (SELECT *, greatest(g1, g2, g3) + 0.05::DOUBLE * (g1 + g2 + g3) AS score FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score, list_aggregate(path, 'string_agg', '>')) AS n FROM r)
SELECT entity, path, round(delta_g, 6) AS delta_g, round(activation, 6) AS activation, steps, round(score, 6) AS score, round(exp(-(activation + greatest(delta_g, 0))) / sqrt(greatest(steps, 1)), 6) AS synthesis_score FROM k WHERE n = 1""")
def step_paths(spark, sf_dir):
    """Bounded paths between the nations of each region: the least to the greatest key by steps of 5 and 10."""
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    edges = n.select(F.col("n_regionkey").alias("entity"), k.cast("string").alias("src"), F.explode(F.array(((k + 5) % 25).cast("string"), ((k + 10) % 25).cast("string"))).alias("dst"), (k % 3 / 10).alias("delta_g"), (k % 5 / 10 + 0.1).alias("activation"))
    ends = n.groupBy(F.col("n_regionkey").alias("entity")).agg(F.min(k).cast("string").alias("a"), F.max(k).cast("string").alias("b"))
    found = pathways.paths(edges, ends.select("entity", F.col("a").alias("node")), ends.select("entity", F.col("b").alias("node")))
    return rounded(pathways.synthesis_score(pathways.best_path(pathways.feasible(found))), "delta_g", "activation", "score", "synthesis_score")


@query()
def embedding_clusters(spark, sf_dir):
    return learning.clusters(read(spark, sf_dir, "embeddings"), "embedding", k=10).groupBy("cluster", "label").agg(F.count("*").alias("n"))


@query()
def composition_forest(spark, sf_dir):
    m = materials(spark, sf_dir).select("jid", "part", "formula", "label")
    return learning.composition_forest(m.where("part % 5 <> 0"), m.where("part % 5 = 0"), "label", trees=10).select("jid", "probability")


@query("SELECT r_regionkey, CAST(i * 3 + j AS BIGINT) AS ordinal, [['a', 'b'][i + 1], ['c', 'd', 'e'][j + 1]] AS choice FROM region, range(2) x(i), range(3) y(j)")
def option_products(spark, sf_dir):
    r = read(spark, sf_dir, "region").select("r_regionkey", F.array(F.lit("a"), F.lit("b")).alias("x"), F.array(F.lit("c"), F.lit("d"), F.lit("e")).alias("y"))
    return selection.option_products(r, "r_regionkey", ["x", "y"])
