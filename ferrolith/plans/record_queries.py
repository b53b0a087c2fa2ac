"""Queries over records, pools and filters, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.functions import chem, numeric
from ferrolith.operators import fusion, metrics, physics, records, search, splits
from ferrolith.plans.queries import _IID, _PROPS, FUSED, WITH, query, rounded
from ferrolith.plans.stand_ins import materials, phi, read


@query("""SELECT url, coalesce('figshare_' || nullif(regexp_extract(url, '/files/(\\d+)', 1), ''), 'none') AS version, page_id,
CASE WHEN page_id % 4 = 0 THEN 'idx:' || page_id ELSE 'p' || page_id END AS id FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://host/files/' || page_id || '/a.json' ELSE 'https://host/' || page_id END AS url FROM pages)""")
def record_ids(spark, sf_dir):
    k = F.col("page_id")
    p = read(spark, sf_dir, "pages").select(k, F.when(k % 3 == 0, F.concat(F.lit("https://host/files/"), k.cast("string"), F.lit("/a.json"))).otherwise(F.concat(F.lit("https://host/"), k.cast("string"))).alias("url"))
    p = p.withColumn("jid", F.when(k % 4 != 0, F.concat(F.lit("p"), k.cast("string"))))
    return p.select("url", records.source_version(F.col("url"), default="none").alias("version"), "page_id", records.sample_id(p, "page_id").alias("id"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'pressed' WHEN 'view' THEN 'seen' ELSE 'unknown' END AS state, CASE WHEN event_id % 7 = 0 THEN 'oom' WHEN event_id % 7 = 1 THEN 'interrupt' WHEN event_id % 7 = 2 THEN 'timeout' ELSE 'exception' END AS bucket FROM events""")
def record_aliases(spark, sf_dir):
    k = F.col("event_id") % 7
    said = F.when(k == 0, " CUDA out of memory ").when(k == 1, "KeyboardInterrupt").otherwise(F.col("event_type"))
    kind = F.when(k == 2, "TimeoutError").otherwise("ValueError")
    name = records.aliased(F.concat(F.lit(" "), F.initcap("event_type")), {"click": "pressed", "view": "seen"}, "unknown")
    return read(spark, sf_dir, "events").select("event_id", name.alias("state"), records.error_bucket(said, kind).alias("bucket"))


@query(f"{WITH} SELECT source_key, round(sum(hse_gap), 6) AS total, count(*) AS n, round(sum(hse_gap * hse_gap), 6) AS squares FROM materials WHERE hse_gap IS NOT NULL GROUP BY 1")
def group_label_stats(spark, sf_dir):
    return rounded(records.group_label_stats(materials(spark, sf_dir), "source_key", "hse_gap"), "total", "squares")


_SPLIT = "CASE WHEN part % 10 < 8 THEN 'train' WHEN part % 10 = 8 THEN 'val' ELSE 'test' END"


def _split(df):
    k = F.col("part") % 10
    return df.withColumn("split", F.when(k < 8, "train").when(k == 8, "val").otherwise("test"))


@query(f"{WITH}, s AS (SELECT {_SPLIT} AS split, * FROM materials) " + " UNION ALL ".join(f"SELECT split, '{p}' AS property, count({p}) AS present, count({p}) - count(*) FILTER ({p} < 0.05) AS finite_count, count(*) FILTER ({p} < 0.05) AS nan_count FROM s GROUP BY split" for p in _PROPS))
def split_property_counts(spark, sf_dir):
    m = _split(materials(spark, sf_dir)).withColumns({p: F.when(F.col(p) < 0.05, float("nan")).otherwise(F.col(p)) for p in _PROPS})
    return records.presence(m, _PROPS)


@query("""WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE 'B' END AS grade, ['not_started', 'queued', 'scanned', 'in_progress', 'unknown', 'complete'][CAST(o_custkey % 6 + 1 AS INTEGER)] AS state, o_custkey % 6 AS r FROM orders)
SELECT id, state FROM t WHERE grade = 'A' AND r < 5 ORDER BY r, id LIMIT 40""")
def priority_rank(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    states = F.array(*map(F.lit, records.STATES))
    t = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "A").otherwise("B").alias("grade"), F.get(states, (F.col("o_custkey") % 6).cast("int")).alias("state"))
    return records.priorities(t, 40).select("id", "state")


@query(f"""{WITH} SELECT jid, round(least(greatest(spillage, 0), 1), 6) AS topology, round(coalesce(least(greatest(hse_gap, 0), 1), 0), 6) AS gap, spillage >= 0.5::DOUBLE AND least(greatest(density / 10, 0), 1) >= 0.6::DOUBLE AS ok FROM materials""")
def feasible_points(spark, sf_dir):
    m = materials(spark, sf_dir).withColumn("third", F.col("density") / 10)
    m = m.withColumn("point", records.objective_points(m, ["spillage", "hse_gap", "third"]))
    return rounded(m.select("jid", F.get("point", F.lit(0)).alias("topology"), F.get("point", F.lit(1)).alias("gap"), records.feasible_point(F.col("point"), 0.5, 0.6).alias("ok")), "topology", "gap")


@query(f"{WITH} SELECT 'train_split' AS chosen, count(*) AS n, round(avg(ehull), 6) AS mean FROM materials WHERE {_SPLIT} = 'train'")
def stats_records(spark, sf_dir):
    m = materials(spark, sf_dir)
    chosen, why = records.stats_records(m, _split(m).select("jid", "split"), "jid")
    return rounded(chosen.agg(F.count("*").alias("n"), F.avg("ehull").alias("mean")).withColumn("chosen", F.lit(why)), "mean")


@query("""SELECT pool, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 OR o_custkey % 5 = 0 THEN 'labelled' ELSE 'pool' END AS pool FROM orders) GROUP BY 1""")
def pool_update(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    first = o.where("id % 10 = 0")
    labelled, pool = records.update_pools(first, o.where("id % 10 <> 0"), o.where("o_custkey % 5 = 0").select("id"), "id")
    return labelled.withColumn("pool", F.lit("labelled")).unionByName(pool.withColumn("pool", F.lit("pool"))).groupBy("pool").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"{WITH} SELECT jid, formula FROM materials WHERE part = (SELECT min(part) FROM materials)")
def point_lookup(spark, sf_dir):
    m = materials(spark, sf_dir)
    first = m.agg(F.min_by("jid", "part")).first()[0]
    return records.find_record(m, f" {first} ").select("jid", "formula")


@query(f"{WITH}, s AS (SELECT jid, [e1, e1, e2] AS a FROM materials) SELECT jid, round(len(list_filter(a, lambda x: x = a[1])) / len(a), 6) AS first_share FROM s")
def element_shares(spark, sf_dir):
    names = chem.parse_formula(F.col("formula"))
    m = materials(spark, sf_dir).withColumn("e", F.map_keys(names))
    first, last = F.get("e", F.lit(0)), F.get("e", F.size("e") - 1)
    shares = records.element_shares(F.array(first, F.concat(first, F.lit(" ")), last, F.lit(" ")))
    return rounded(m.select("jid", F.try_element_at(shares, first).alias("first_share")), "first_share")


@query(f"{WITH} SELECT DISTINCT formula FROM materials")
def unique_formulas(spark, sf_dir):
    return records.unique_formulas(materials(spark, sf_dir))


@query(f"""{WITH}, {FUSED}, p AS (SELECT jid, bandgap_best, {phi('((0.1::DOUBLE - ehull) / 0.03::DOUBLE)')} AS chance FROM fused WHERE bandgap_best BETWEEN 2.5 AND 3.5)
SELECT jid, round(chance, 5) AS stability_probability FROM p WHERE chance >= 0.5""")
def stable_in_gap(spark, sf_dir):
    table = fusion.gap_columns(materials(spark, sf_dir))
    found = search.stable(table, probability=0.5, gap=(2.5, 3.5))
    return found.select("jid", (F.round("stability_probability", 5) + F.lit(0.0)).alias("stability_probability"))


@query(f"{WITH} SELECT jid FROM materials WHERE optb88vdw_bandgap <= 2.8")
def topological_by_gap(spark, sf_dir):
    return search.topological(materials(spark, sf_dir).drop("spillage"), most_gap=2.8).select("jid")


@query("""SELECT p_brand, 'p_size' AS property, round(avg(p_size), 6) AS mean, round(stddev_pop(p_size), 6) AS std FROM part GROUP BY 1 UNION ALL
SELECT p_brand, 'p_partkey', round(avg(p_partkey), 6), round(stddev_pop(p_partkey), 6) FROM part GROUP BY 1""")
def baseline_report(spark, sf_dir):
    """The summaries of JSON reports, one for each brand."""
    said = F.struct(*(F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in ("p_size", "p_partkey")))
    reports = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.struct(said.alias("property_summary")).alias("details"))).alias("report"))
    each = reports.select("p_brand", F.explode(records.baseline_summary(F.col("report"))).alias("property", "m"))
    return each.select("p_brand", "property", F.round(F.col("m")["mean"], 6).alias("mean"), F.round(F.col("m")["std"], 6).alias("std"))


@query(f"WITH {_IID} SELECT c_custkey, c_nationkey FROM customer JOIN k USING (c_custkey) WHERE pos > n - n // 10")
def attached_split(spark, sf_dir):
    """The rows of one split."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return splits.attach(c, splits.iid_split(c, "c_custkey"), "c_custkey", "test")


_SOURCES = f"""{WITH}, s AS (SELECT source_key, CASE min(size) % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'none' END AS coverage, 1.0::DOUBLE + count(*) AS alpha, 1.0::DOUBLE + sum(label) AS beta, avg(size) / 100 AS drift_distance FROM materials GROUP BY 1)"""


def _sources(spark, sf_dir):
    m = materials(spark, sf_dir).groupBy("source_key").agg(F.min("size").alias("k"), (1.0 + F.count("*")).alias("alpha"), (1.0 + F.sum("label")).alias("beta"), (F.avg("size") / 100).alias("drift_distance"))
    return m.withColumn("coverage", F.when(F.col("k") % 3 == 0, "full").when(F.col("k") % 3 == 1, "partial").otherwise("none")).drop("k")


@query(f"""{_SOURCES}, c AS (SELECT source_key, CASE coverage WHEN 'full' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END * alpha / (alpha + beta) * exp(-drift_distance) AS score FROM s)
SELECT source_key, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, source_key) AS INTEGER) AS rank FROM c""")
def source_ranking(spark, sf_dir):
    """Sources by coverage, reliability and drift."""
    return rounded(fusion.source_scores(_sources(spark, sf_dir)).select("source_key", "score", "rank"), "score")


@query(f"""{WITH}, o AS (SELECT source_key AS channel, sum(1 - abs(spillage - label)) AS da, sum(abs(spillage - label)) AS db FROM materials WHERE part % 3 = 0 GROUP BY 1), a AS (SELECT source_key AS channel, 1.0::DOUBLE + count(*) AS alpha, 1.0::DOUBLE + sum(label) AS beta FROM materials GROUP BY 1)
SELECT channel, round(alpha + coalesce(da, 0), 6) AS alpha, round(beta + coalesce(db, 0), 6) AS beta FROM a LEFT JOIN o USING (channel)""")
def reliability_update(spark, sf_dir):
    """Beta counts of sources after a third of the rows was checked."""
    checked = materials(spark, sf_dir).where("part % 3 = 0").select(F.col("source_key").alias("channel"), F.col("spillage").alias("p"), "label")
    state = _sources(spark, sf_dir).select(F.col("source_key").alias("channel"), "alpha", "beta")
    return rounded(fusion.update_reliability(state, checked), "alpha", "beta")


@query("""WITH l AS (SELECT o_orderpriority AS k, o_totalprice / 100000 AS x FROM orders)
SELECT k, round(max(x) + ln(avg(exp(2 * x)) / exp(2 * max(x))) / 2, 6) AS risk FROM l GROUP BY 1""")
def entropic_risk(spark, sf_dir):
    """The entropic risk of prices by priority."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), (F.col("o_totalprice") / 100000).alias("x"))
    return rounded(o.groupBy("k").agg(numeric.entropic_risk(F.col("x"), 2.0).alias("risk")), "risk")


@query(f"""{WITH}, v AS (SELECT jid, [c1, c2, spillage] AS v FROM materials), n AS (SELECT jid, v, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) AS n, [x * x / list_sum([y * y FOR y IN v]) FOR x IN v] AS e FROM v)
SELECT jid, round(v[1] / n, 6) AS l2, round(e[1], 6) AS escort, round(exp(v[1] - list_max(v)) / list_sum([exp(y - list_max(v)) FOR y IN v]), 6) AS softmax, round((v[1] * v[3] + v[2] * v[2] + v[3] * v[1]) / (n * n), 6) AS cosine,
round(list_sum([exp(-pow((v[3] * 5 - c * 5 / 19.0::DOUBLE) / (5 / 19.0::DOUBLE), 2)) FOR c IN range(20)]), 6) AS basis FROM n""")
def vector_functions(spark, sf_dir):
    """Column functions of vectors: lengths, shares, powers of shares, cosines, a basis."""
    v = materials(spark, sf_dir).select("jid", F.array((F.regexp_extract("formula", r"^[A-Z][a-z]?([0-9]+)", 1)).cast("double"), F.regexp_extract("formula", r"([0-9]+)$", 1).cast("double"), "spillage").alias("v"))
    unit = numeric.l2_normalize(F.col("v"))
    first = lambda c: F.get(c, F.lit(0))
    got = v.select("jid", first(unit).alias("l2"), first(numeric.escort(F.col("v"), 2.0)).alias("escort"), first(numeric.softmax(F.col("v"))).alias("softmax"), numeric.dot(unit, F.reverse(unit)).alias("cosine"), numeric.total(numeric.gaussian_basis(F.get("v", F.lit(2)) * 5)).alias("basis"))
    return rounded(got, "l2", "escort", "softmax", "cosine", "basis")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity END AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, round(q / sum(q) OVER (PARTITION BY l_orderkey), 6) AS fraction FROM p WHERE q > 0""")
def phase_fractions(spark, sf_dir):
    """Positive fractions of each order's lines."""
    p = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity").cast("double")).alias("fraction"))
    return rounded(physics.normalize_phases(p, ["l_orderkey"]), "fraction")


@query("""WITH s AS (SELECT l_suppkey AS k, l_partkey AS x, avg(l_extendedprice)::DOUBLE AS y FROM lineitem GROUP BY 1, 2), w AS (SELECT k, x, y, lead(x) OVER q AS nx, lead(y) OVER q AS ny FROM s WINDOW q AS (PARTITION BY k ORDER BY x))
SELECT k, round(min(x + (30000 - y) * (nx - x) / (ny - y)), 4) AS crossing FROM w WHERE (y - 30000) * (ny - 30000) <= 0 AND y <> ny GROUP BY 1""")
def level_crossings(spark, sf_dir):
    """Where the prices of each supplier's parts first pass a level."""
    c = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("x")).agg(F.avg("l_extendedprice").cast("double").alias("y"))
    return physics.crossings(c, ["k"], "x", "y", 30000.0).withColumn("crossing", F.round("crossing", 4))


@query("""WITH f AS (SELECT c_nationkey, count(*) AS n_valid, avg(c_acctbal)::DOUBLE AS mae, CASE WHEN c_nationkey % 4 <> 0 THEN stddev_pop(c_acctbal)::DOUBLE END AS spread FROM customer GROUP BY 1),
l AS (SELECT 'mae' AS metric, mae AS v, n_valid FROM f UNION ALL SELECT 'spread', spread, n_valid FROM f)
SELECT metric, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(sum(v * n_valid) / sum(n_valid), 4) AS weighted_mean FROM l WHERE v IS NOT NULL GROUP BY 1""")
def fold_summaries(spark, sf_dir):
    """Metrics over folds, a nation each."""
    f = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n_valid"), F.avg("c_acctbal").cast("double").alias("mae"), F.stddev_pop("c_acctbal").alias("s"))
    folds = f.withColumn("spread", F.when(F.col("c_nationkey") % 4 != 0, F.col("s")))
    return metrics.fold_summary(folds, ["mae", "spread"]).withColumns({c: F.round(c, 4) for c in ("mean", "std", "weighted_mean")})
