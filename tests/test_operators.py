"""Operators on small fixtures, against plain NumPy or stated outcomes; missing values above all."""

import json
import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrolith.functions import chem, numeric
from ferrolith.operators import acquisition, drift, fusion, joint, metrics, ordered, pareto, physics, quality, search, similarity, splits
from ferrolith.sources import readers, writers


def one(df):
    return df.collect()[0]


@pytest.fixture(scope="module")
def properties(spark):
    kind = "jid string, formula string, hse_gap double, mbj_bandgap double, optb88vdw_bandgap double, bulk_modulus_kv double, shear_modulus_gv double, density double, poisson double"
    return spark.createDataFrame([("J1", "SiO2", 1.6, 1.4, 1.2, 150.0, 80.0, 2.65, 0.2), ("J2", "Bi2Te3", None, 0.08, 0.02, 40.0, 18.0, 7.7, 0.3), ("J3", "C", None, None, None, 20.0, 10.0, 2.2, 0.25)], kind)


def test_fused_gaps_and_classes(properties):
    got = {r.jid: r for r in fusion.class_columns(fusion.gap_columns(properties)).collect()}
    assert 1.2 <= got["J1"].bandgap_fused <= 1.6 and got["J1"].bandgap_method_count == 3 and got["J1"].bandgap_fused_std > 0
    assert sum(got["J2"][f"p_{c}"] for c in fusion.CLASSES) == pytest.approx(1)
    assert got["J3"].conductivity_class == "unknown" and got["J3"].p_metal is None and got["J3"].conductivity_confidence is None


def test_fusion_is_least_squares(spark):
    rho, rng = 0.25, np.random.default_rng(1)
    rows = [(i, *(float(x) if rng.random() < 0.7 else None for x in rng.normal(size=3))) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double")
    s = [0.1, 0.2, 0.4]
    mean, sigma, m = fusion.precision_fusion([F.col(c) for c in "abc"], [F.lit(x) for x in s], rho)
    for r in df.select("*", mean.alias("mean"), sigma.alias("sigma"), m.alias("m")).collect():
        at = [i for i, x in enumerate(r[1:4]) if x is not None]
        if not at:
            assert r.mean is None
            continue
        sd = np.array(s)[at]
        inverse = np.linalg.inv(np.outer(sd, sd) * (rho + (1 - rho) * np.eye(len(at))))
        total = inverse.sum()
        assert r.mean == pytest.approx(float(inverse.sum(axis=0) @ np.array([r[1 + i] for i in at]) / total)) and r.sigma == pytest.approx(total**-0.5)


def test_physics(properties):
    got = {r.jid: r for r in physics.elastic_columns(fusion.class_columns(fusion.gap_columns(properties))).collect()}
    j = got["J1"]
    assert j.youngs_modulus == pytest.approx(9 * 150 * 80 / 530) and j.is_ductile and j.hardness_chen > 0 and 100 < j.debye_temperature < 2000
    assert got["J2"].debye_temperature < j.debye_temperature and got["J3"].melting_point_est is None


def test_formulas(spark):
    names = ["Fe2O3", "LiFePO4", "C", "H2O1H2", "Si0.5Ge0.5", "", None, "xx"]
    p = chem.parse_formula(F.col("f"))
    got = spark.createDataFrame([(x,) for x in names], "f string").select("f", p.alias("p"), chem.chemical_system(F.col("f")).alias("s"), chem.complexity(p).alias("c"), chem.molar_mass(p).alias("m"), chem.formula_of(p).alias("back")).collect()
    by = {r.f: r for r in got}
    assert by["Fe2O3"].p == {"Fe": 2, "O": 3} and by["H2O1H2"].p == {"H": 4, "O": 1} and by["Si0.5Ge0.5"].p == {"Si": 0.5, "Ge": 0.5}
    assert by["LiFePO4"].s == "Fe-Li-O-P" and by["C"].c == 0 and by["Fe2O3"].m == pytest.approx(159.687) and by["Fe2O3"].back == "Fe2O3" and by["Si0.5Ge0.5"].back == "Ge0.5Si0.5"
    assert by["Fe2O3"].c == pytest.approx(-(0.4 * math.log(0.4) + 0.6 * math.log(0.6)) / math.log(2))
    assert by[None].p is None and by[""].p is None and by["xx"].p is None


def test_numeric(spark):
    xs = [-8.0, -3.0, -0.5, 0.0, 0.7, 4.0, None]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", numeric.normal_cdf(F.col("x")).alias("p"), numeric.log_normal_cdf(F.col("x")).alias("l"), numeric.finite(F.col("x") / F.lit(1.0)).alias("f")).collect()
    for r in got[:-1]:
        assert r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=1.5e-7)
    assert got[0].l == pytest.approx(math.log(0.5 * math.erfc(8 / math.sqrt(2))), rel=0.01) and got[-1].p is None
    v = spark.createDataFrame([([0.2, 0.3, 0.5],), ([0.0, 0.0, 0.0],)], "v array<double>").select(numeric.renormalize(F.col("v")), numeric.softmax(F.col("v")), numeric.clr_softmax(F.col("v")), numeric.escort(F.col("v"), 2), numeric.l2_normalize(F.col("v"))).collect()
    assert v[0][0] == pytest.approx([0.2, 0.3, 0.5]) and v[1][0] == pytest.approx([1 / 3] * 3) and v[0][2] == pytest.approx([0.2, 0.3, 0.5]) and sum(v[0][1]) == pytest.approx(1)
    assert v[0][3] == pytest.approx([0.04 / 0.38, 0.09 / 0.38, 0.25 / 0.38]) and v[1][4] == [0, 0, 0]


def test_stability_and_topology(spark):
    t = spark.createDataFrame([("A", 0.05), ("B", 0.15), ("C", None)], "jid string, ehull double")
    assert [r.jid for r in search.stable(t, 0.1).collect()] == ["A"]
    t = spark.createDataFrame([("A", 0.03), ("B", 0.11), ("C", 0.30)], "jid string, ehull double")
    assert {r.jid for r in search.stable(t, 0.1, 0.25, noise=0.05).collect()} == {"A", "B"}
    t = spark.createDataFrame([("T1", 0.82, 0.02, 0.06), ("T2", 0.90, 0.45, 2.0), ("T3", 0.56, 0.08, 0.2)], "jid string, spillage double, ehull double, gap double")
    p = search.topology_probability(F.col("spillage"), search.stability_probability(F.col("ehull")), F.col("gap"))
    assert {r.jid for r in t.where(p >= 0.5).collect()} == {"T1", "T3"}


def test_search_rejects(properties):
    with pytest.raises(ValueError):
        search.criterion("density", (3.0, 1.0))
    with pytest.raises(ValueError):
        search.parse_filter("density ~ 3")
    with pytest.raises(ValueError):
        search.check_columns(properties, ["density", "nothing"])
    assert search.search(properties, {"density": (None, 3.0)}, "density", limit=0).count() == 2
    assert search.filled_columns(properties, ["hse_gap", "nothing"]) == ["hse_gap"]
    assert search.build_criteria("insulator", bandgap_best=(0.1, 5.0))["bandgap_best"] == (3.0, 5.0)
    assert search.build_criteria("metal", bandgap_best=(0.1, None)) == {"conductivity_class": "metal", "ehull": (None, 0.1), "bandgap_best": (0.1, None)}


def test_drift(spark):
    def side(values, name="x"):
        return spark.createDataFrame([(name, float(v)) for v in values], "property string, value double")

    a, b = side(range(50)), side(range(10, 60))
    assert one(drift.wasserstein(a, a)).wasserstein == 0 and one(drift.wasserstein(a, b)).wasserstein == pytest.approx(10)
    assert one(drift.mmd(side(range(80)), side(range(20, 100)))).mmd2 > 0
    assert one(drift.histogram_kl(side(range(100)), side(range(100)))).kl < 0.01 < one(drift.histogram_kl(side(range(100)), side(range(50, 150)))).kl
    assert one(drift.histogram_kl(side([1, 2]), side([1, 2]))).kl == 0
    assert one(drift.drift(side(range(100)), side(range(50, 150)))).alert and not one(drift.drift(side(range(100)), side(range(100)))).alert
    ks = one(drift.kolmogorov_smirnov(side([0] * 40 + [1] * 40), side([0] * 10 + [1] * 70)))
    assert ks.ks_stat == pytest.approx(0.375) and ks.ks_pvalue < 0.05
    q = drift.q_values(spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.9)], "property string, ks_pvalue double")).orderBy("ks_pvalue").collect()
    assert [r.q_value for r in q] == pytest.approx([0.003, 0.03, 0.9])
    t = spark.range(300).select("id", F.col("id").cast("double").alias("u"), F.when(F.col("id") % 3 > 0, F.col("id") * 2.0).alias("v"))
    assert one(joint.joint_drift(t, t.withColumn("u", F.col("u") + 500), ["u", "v"], "id", permutations=19)).pvalue <= 0.05


def test_trust_and_outliers(spark):
    kind = "jid string, provenance_type string, source_key string, source_version string, source_id string, e double"
    t = spark.createDataFrame([("a", "dft_primary", "k", "1", "i", 0.5), ("b", "synthetic", None, None, None, 0.5), ("c", None, None, None, None, None)], kind)
    got = {r.jid: r for r in quality.trust(t, {"e": {"mean": 0.0, "std": 1.0}}).collect()}
    assert got["a"].trust_tier == "benchmark" and got["a"].trust_score == 93 and got["b"].trust_tier in ("raw", "curated") and got["c"].trust_score == 28
    v = spark.createDataFrame([("e", str(i), float(x)) for i, x in enumerate([1, 1, 1, 1, 9])], "property string, jid string, value double")
    assert [r.jid for r in quality.outliers(v, "jid").collect()] == ["4"]
    assert quality.outliers(v.limit(2), "jid").count() == 0
    kept, gone = quality.remove_outliers(spark.createDataFrame([(str(i), float(i % 7)) for i in range(50)] + [("x", 99.0), ("n", None)], "jid string, e double"), ["e"])
    assert [r.jid for r in gone.collect()] == ["x"] and kept.count() == 51
    j = spark.createDataFrame([("J1", "-1.0", "na"), ("J2", "-1.1", "1.2"), ("J3", "na", "2.1"), ("J4", "-1.2", " NaN ")], "jid string, a string, b string")
    assert [r.jid for r in quality.label_count_filter(j, ["a", "b"], 2).collect()] == ["J2"]
    assert quality.validate(t, ["jid", "e"], ["e"]).first().asDict() == {"n_rows": 3, "schema_violations": 1, "provenance_violations": 1, "outliers": 0, "duplicates": 0}


def test_pareto(spark):
    x = np.random.default_rng(0).normal(size=(28, 3)).round(2)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    rank, left, level = {}, set(range(28)), 0
    while left:
        best = {i for i in left if not any((x[j] >= x[i]).all() and (x[j] > x[i]).any() for j in left)}
        rank |= dict.fromkeys(best, level)
        left, level = left - best, level + 1
    assert {r.id: r.front for r in pareto.fronts(df, ["a", "b", "c"], "id").collect()} == rank
    assert {r.id for r in pareto.pareto_front(df, ["a", "b", "c"]).collect()} == {i for i, k in rank.items() if k == 0}
    two = spark.createDataFrame([(1.0, 0.2), (0.2, 1.0)], "x double, y double")
    assert one(pareto.hypervolume_2d(two, "x", "y")).hypervolume == pytest.approx(0.36)
    assert pareto.hypervolume(two, ["x", "y"], [0, 0], [1, 1], probes=4000) == pytest.approx(0.36, abs=0.03)
    withnull = df.withColumn("a", F.when(F.col("id") != 3, F.col("a")))
    last = {r.id: r.front for r in pareto.fronts(withnull, ["a", "b", "c"], "id").collect()}
    assert last[3] == max(last.values())


def test_greedy(spark):
    x = np.random.default_rng(2).normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r], float(r[0])) for i, r in enumerate(x)], "id long, v array<double>, s double")
    chosen, near = [0], ((x - x[0]) ** 2).sum(axis=1)
    for _ in range(3):
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    assert [r.id for r in pareto.k_center(df, "id", "v", 4).orderBy("pick").collect()] == chosen
    picks = pareto.select_diverse(df, "s", "id", "v", 5).collect()
    assert picks[0].id == int(np.argmax(x[:, 0])) and len({r.id for r in picks}) == 5


def test_acquisition(spark):
    t = spark.createDataFrame([(0.7, 0.2, 0.3), (-100.0, 1.0, 0.0)], "m double, s double, b double")
    got = t.select(acquisition.expected_improvement(F.col("m"), F.col("s"), F.col("b")).alias("ei"), acquisition.log_expected_improvement(F.col("m"), F.col("s"), F.col("b")).alias("l")).collect()
    assert math.exp(got[0].l) == pytest.approx(got[0].ei, rel=1e-5) and math.isfinite(got[1].l) and got[1].l < 0
    n = spark.createDataFrame([(-0.8, 0.2, [-1.1, -0.9, -1.0], [0.0, 0.0, 0.0])], "m double, s double, om array<double>, os array<double>")
    r = one(n.select(acquisition.noisy_expected_improvement(F.col("m"), F.col("s"), F.col("om"), F.col("os"), maximize=False).alias("nei"), acquisition.expected_improvement(F.col("m"), F.col("s"), -1.1, maximize=False).alias("ei")))
    assert r.nei == pytest.approx(r.ei, abs=1e-6)


def test_policy(spark):
    t = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0, 0.9, 0.0)], "stability double, novelty double, cost double, feasibility double, ood double, conformal double")
    got = {m: [r.utility for r in acquisition.policy_utility(t, m).collect()] for m in ("soft", "hard", "hybrid")}
    base = 1.25 / 1.001
    assert got["soft"] == pytest.approx([base, base - 0.27]) and got["hard"] == pytest.approx([base, -1e9]) and got["hybrid"] == pytest.approx([base, base / 2 - 0.27])


def test_splits(spark):
    assert splits.split_counts(10) == [8, 1, 1] and splits.split_counts(3) == [1, 1, 1] and sum(splits.split_counts(997)) == 997
    df = spark.createDataFrame([(f"s{i}", f) for i, f in enumerate(["Li2O", "Fe2O3", "NaCl", "CuO"] * 5)], "sample_id string, formula string")
    got = splits.compositional_split(df, "sample_id").collect()
    assert len(got) == 20 and all(len({r.split for r in got if r.group == g}) == 1 for g in {r.group for r in got}) and {r.split for r in got} == {"train", "val", "test"}
    big = spark.range(1003).select(F.col("id").alias("k"))
    a, b = splits.iid_split(big, "k"), splits.iid_split(big.repartition(7), "k")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    n = {r.split: r["count"] for r in a.groupBy("split").count().collect()}
    assert [n["train"], n["val"], n["test"]] == splits.split_counts(1003)
    m = one(splits.manifest(a, "k"))
    assert m.overlap == 0 and m.manifest_id == one(splits.manifest(b, "k")).manifest_id
    assert one(splits.jaccard(a, a, "k")).jaccard == 1


def test_metrics(spark):
    t = spark.createDataFrame([(1.0, 1.0), (2.0, float("nan")), (3.0, 5.0)], "t double, p double")
    r = one(metrics.regression(t, "t", "p", empty=0.0))
    assert (r.mae, r.rmse, r.r2) == pytest.approx((1, math.sqrt(2), -1))
    assert one(metrics.regression(t.limit(0), "t", "p", empty=0.0)).mae == 0
    folds = spark.createDataFrame([(9, 0.2, 0.9), (12, 0.4, None)], "n_valid int, mae double, cover double")
    s = {r.metric: r for r in metrics.fold_summary(folds, ["mae", "cover"]).collect()}
    assert s["mae"]["mean"] == pytest.approx(0.3) and s["mae"].weighted_mean == pytest.approx((1.8 + 4.8) / 21) and s["cover"].n == 1
    assert one(metrics.auc(spark.createDataFrame([(0.1, 1), (0.4, 1)], "s double, y int"), "s", "y")).auc == 0.5
    b = one(metrics.bootstrap_mean(spark.range(500).select("id", (F.col("id") % 10).cast("double").alias("v")), "v", "id", resamples=200))
    assert b.low < 4.5 < b.high and b.high - b.low < 1
    assert one(spark.range(1).select(metrics.cross_entropy(F.lit(800.0), F.lit(0)).alias("l"))).l == pytest.approx(800)


def test_ranks(spark):
    v = [3.0, 1.0, 3.0, 2.0, 1.0]
    got = ordered.average_ranks(spark.createDataFrame([(x,) for x in v], "v double"), "v").orderBy("v").collect()
    assert [r["rank"] for r in got] == [1.5, 1.5, 3, 4.5, 4.5]
    big = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), F.lit(1).alias("one"), (F.col("id") % 2).alias("g"))
    run = ordered.cumulative(big, ["g"], "v", {"c": "one"})
    for g in (0, 1):
        assert [r.c for r in run.where(F.col("g") == g).orderBy("v").collect()] == list(range(1, 2501))


def test_similarity(spark):
    rng = np.random.default_rng(4)
    pts = rng.uniform(0, 3, (60, 3))
    df = spark.createDataFrame([("m", i, *map(float, p)) for i, p in enumerate(pts)], "g string, id int, x double, y double, z double")
    got = {(r.src, r.dst) for r in similarity.radius_neighbours(df, "g", "id", ["x", "y", "z"], 0.8, 100).collect()}
    assert got == {(i, j) for i, j in product(range(60), repeat=2) if i != j and np.linalg.norm(pts[i] - pts[j]) <= 0.8}
    v = rng.normal(size=(50, 5))
    e = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = u @ u[:10].T
    c[np.arange(10), np.arange(10)] = -np.inf
    near = {r.id: r.nearest for r in similarity.nearest_cosine(e, e.where("id < 10"), "id", "v", block=4).collect()}
    assert [near[i] for i in range(50)] == pytest.approx(c.max(axis=1).tolist())
    s = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y", "z"]), ("c", ["q"])], "k string, m array<string>")
    assert [tuple(r) for r in similarity.set_jaccard(s, "k", "m").collect()] == [("a", "b", pytest.approx(1 / 3))]


def test_fusion_extras(spark):
    s = fusion.source_scores(spark.createDataFrame([("x", "full", 16.0, 2.0, 0.1), ("y", "partial", 2.0, 11.0, 0.5)], "source_key string, coverage string, alpha double, beta double, drift_distance double"))
    assert [r.source_key for r in s.orderBy("rank").collect()] == ["x", "y"]
    e = spark.createDataFrame([("m", 1.0, 0.1, 16 / 18), ("m", 3.0, 0.5, 2 / 13)], "entity string, value double, std double, reliability double")
    assert 0.9 <= one(fusion.gls_fusion(e, 0.3))["mean"] <= 1.4
    flat = e.withColumn("std", F.lit(0.2)).withColumn("reliability", F.lit(1.0))
    assert one(fusion.gls_fusion(flat, 0.8))["std"] > one(fusion.gls_fusion(flat, 0.0))["std"]
    assert fusion.beta_quantile(2, 3, 0.5) == pytest.approx(0.38572756, abs=1e-6)
    low, high = fusion.beta_interval(F.lit(8.0), F.lit(4.0), exact=True)
    r = one(spark.range(1).select(low.alias("l"), high.alias("h")))
    assert r.l == pytest.approx(fusion.beta_quantile(8, 4, 0.025)) and r.h == pytest.approx(fusion.beta_quantile(8, 4, 0.975))
    state = spark.createDataFrame([("a", 2.0, 1.0)], "channel string, alpha double, beta double")
    new = fusion.update_reliability(state, spark.createDataFrame([("a", 0.9, 1), ("b", 0.2, 1)], "channel string, p double, label int"))
    assert {r.channel: (round(r.alpha, 6), round(r.beta, 6)) for r in new.collect()} == {"a": (2.9, 1.1), "b": (1.2, 1.8)}
    t = fusion.fit_temperature(spark.createDataFrame([(0.99, 0), (0.99, 1), (0.01, 0), (0.01, 1)], "p double, y int"), "p", "y")
    assert one(t).temperature == pytest.approx(8.0)


def test_alloys(spark):
    p = spark.createDataFrame([("x", "a", 0.6, 8.0, 160.0, 80.0, 50.0, 1800.0), ("x", "b", 0.4, 2.7, 70.0, 26.0, 230.0, 930.0)], "alloy string, phase string, weight_fraction double, density double, bulk double, shear double, conductivity double, melting double")
    r = one(physics.mix_alloys(p))
    assert r.volume_sum == pytest.approx(1) and r.bulk_reuss <= r.bulk_vrh <= r.bulk_voigt and r.conductivity_lower <= r.conductivity_geometric <= r.conductivity_upper
    c = spark.createDataFrame([("m", 0.0, 0.0), ("m", 1.0, 0.4), ("m", 2.0, 0.8)], "k string, t double, f double")
    assert one(physics.crossings(c, ["k"], "t", "f", 0.5)).crossing == pytest.approx(1.25)
    iso = [[3.0, 1, 1, 0, 0, 0], [1, 3.0, 1, 0, 0, 0], [1, 1, 3.0, 0, 0, 0], [0, 0, 0, 1.0, 0, 0], [0, 0, 0, 0, 1.0, 0], [0, 0, 0, 0, 0, 1.0]]
    t = spark.createDataFrame([([[float(x) for x in row] for row in iso],)], "c array<array<double>>")
    k, g = physics.voigt(F.col("c"))
    r = one(t.select(k.alias("k"), g.alias("g"), physics.reuss(F.col("c")).alias("r")))
    assert (r.k, r.g) == pytest.approx((5 / 3, 1)) and (r.r.bulk, r.r.shear) == pytest.approx((5 / 3, 1))


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"jid": "a", "formula": "C", "ehull": "na", "density": "2.2", "spg_number": 5}, {"jid": "b", "ehull": 0.1, "spg_number": "x"}]))
    got = {r.jid: r for r in readers.read_properties(spark, str(tmp_path / "p.json")).collect()}
    assert got["a"].ehull is None and got["a"].density == 2.2 and got["b"].ehull == 0.1 and got["b"].spg_number is None and got["a"].spg_number == 5
    (tmp_path / "r.json").write_text(json.dumps({"records": [{"x": 1}, {"x": 2}]}))
    (tmp_path / "r.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "r.csv").write_text("x\n1\n2\n")
    assert [readers.read_records(spark, str(tmp_path / f"r.{e}")).count() for e in ("json", "jsonl", "csv")] == [2, 2, 2]
    with pytest.raises(ValueError):
        readers.read_records(spark, "x.xml")
    assert readers.read_or_empty(spark, str(tmp_path / "none.csv")).count() == 0
    raw = spark.createDataFrame([(" J1 ", "weyl", "0.5"), ("J2", " ", "bad")], "jid string, topo_class string, band_gap string")
    norm = readers.normalize_topology(raw)
    assert [tuple(r)[:6] for r in norm.orderBy("jid").collect()] == [("J1", None, None, "WEYL", 0.5, "custom"), ("J2", None, None, None, None, "custom")]
    merged = readers.merge_keep_last(norm, norm.where("jid = 'J2'").withColumn("source", F.lit("new")))
    assert {r.jid: r.source for r in merged.collect()} == {"J1": "custom", "J2": "new"}
    a = spark.createDataFrame([("J1", "train"), ("J2", "VAL"), ("J3", "bad"), (None, "test"), ("J4", None)], "sample_id string, split string")
    assert sorted(map(tuple, readers.read_assignment(a).collect())) == [("J1", "train"), ("J2", "val")]
    with pytest.raises(ValueError):
        readers.read_assignment(a.unionAll(spark.createDataFrame([("J1", "test")], a.schema)))
    c = spark.createDataFrame([("A", 0.5), ("B", 0.2)], "formula string, acquisition_value double")
    writers.write_iteration(c, str(tmp_path / "it"), 3)
    back = readers.read_iterations(spark, str(tmp_path / "it"))
    last, tail, seeds = readers.resume_state(back)
    assert last == 3 and tail.count() == 2 and [r.formula for r in seeds.collect()] == ["A"]
    (tmp_path / "t.md").write_text("# T\n## Cat\n### one\n- Status: Done\n- Tags: x\n### two\n- Status: Open\n## Other\n### one\n- Status: Late\n")
    assert {(r.id, r.category, r.field, r.value) for r in readers.read_tracker(spark, str(tmp_path / "t.md")).collect()} == {("one", "Cat", "status", "Done"), ("one", "Cat", "tags", "x"), ("two", "Cat", "status", "Open")}
    row = spark.createDataFrame([(float("nan"), 2, "x")], "a double, b int, c string")
    assert json.loads(writers.report_json(row)) == {"a": None, "b": 2, "c": "x"} and "| b | 2 |" in writers.report_markdown(row, "T")
    writers.write_assignment(a.where("sample_id is not null"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 4
    assert one(writers.sql(c, "SELECT count(*) AS n FROM materials")).n == 2


def test_streaming(spark, tmp_path):
    from ferrolith.streaming import monitor

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    base = {r.event_type: (r.m, r.s) for r in events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()}
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = monitor.windowed_shift(stream, base, "ts", "event_type", "value", window="7 days").writeStream.format("memory").queryName("shift").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT sum(n) AS n, max(shift) AS s FROM shift").first()
    assert got.n == events.count() and got.s >= 0
    q = monitor.keep_counts(stream.withColumn("ok", F.col("value") > 50), str(tmp_path / "state"), "event_type", "ok").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    counts = monitor.read_counts(spark, str(tmp_path / "state"), "event_type").agg(F.sum(F.col("alpha") + F.col("beta") - 2)).first()[0]
    assert counts == events.count()
