"""The bounded numpy operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrolith.operators import advanced, pathways, selection


def one(df):
    return df.collect()[0]


def test_small_linear_algebra(spark):
    t = spark.createDataFrame([([0.5, 0.5, 0.5],), ([2.0, -1.0, 0.0],)], "v array<double>")
    got = [r[0] for r in t.select(advanced.simplex_projection(F.col("v"))).collect()]
    assert got[0] == pytest.approx([1 / 3] * 3) and got[1] == pytest.approx([1, 0, 0])
    m = advanced.nearest_correlation(np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1.0]]))
    assert np.linalg.eigvalsh(m).min() > -1e-9 and np.diag(m) == pytest.approx(np.ones(3))
    assert one(advanced.escort_power(t.limit(1), "v")).entropy == pytest.approx(1)
    stat, p = advanced.ks_permutation(np.array([0.0] * 20), np.array([1.0] * 20))
    assert stat == 1 and p < 0.02


def test_rankings(spark):
    t = spark.createDataFrame([(1, 0.8, 0.7, 0.9, 0.0), (2, 0.8, 0.2, 0.9, 0.0), (3, 0.1, 0.1, 0.1, 0.0)], "k int, probability double, ci_low double, ci_high double, ood double")
    assert [r.k for r in advanced.exploration_ranking(t, "k", least=0.2).collect()] == [2, 1]
    known = spark.createDataFrame([("x", "Fe2O3", -1.0)], "jid string, formula string, e double")
    new = spark.createDataFrame([("a", "Fe4O6", -1.0), ("b", "Fe2O3", -2.0)], known.schema)
    assert [tuple(r) for r in advanced.near_copies_of_known(new, known, "jid", "e").collect()] == [("a", "x")]
    pts = spark.createDataFrame([(1.0, 1.0), (0.4, 0.4)], "a double, b double")
    gains = [r[0] for r in pts.select(advanced.hypervolume_gains(pts, np.array([[0.5, 0.5]]), ["a", "b"], [0, 0], [1, 1])).collect()]
    assert gains[0] == pytest.approx(0.75, abs=0.05) and gains[1] == 0
    f = spark.createDataFrame([("NaCl",), ("NaO",), ("Xx1",)], "f string")
    c = [r[0] for r in f.select(advanced.charge_balance(F.col("f"))).collect()]
    assert c[0] == 1 and c[1] == pytest.approx(math.exp(-0.5)) and c[2] == 0.5
    w = advanced.adaptive_weights(pts, {"a": 1.0, "b": 1.0}).collect()
    assert w[0].ranking == pytest.approx(1.0)


def test_gaussian_process(spark):
    t = spark.range(60).select("id", (F.col("id") / 10).alias("x"), F.sin(F.col("id") / 10).alias("y"))
    got = advanced.gaussian_process(t, t, ["x"], "y", "id").join(t, "id").collect()
    assert max(abs(r["mean"] - r.y) for r in got) < 0.1 and all(r["std"] > 0 for r in got)


def test_residuals_and_tensors(spark):
    t = spark.range(100).select("id", F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"))
    assert one(advanced.residual_correlation(t, "id", ["a", "b"])).correlation == pytest.approx(-100 / 120)
    m = spark.createDataFrame([([[1.0, 2.0], [2.0, 1.0]], [[1.0, 2.0], [0.0, 1.0]])], "t array<array<double>>, p array<array<double>>")
    r = one(advanced.tensor_metrics(m, "t", "p"))
    assert r.frobenius == pytest.approx(2) and r.asymmetry == pytest.approx(math.sqrt(8) / math.sqrt(6))
    p = spark.createDataFrame([(-2.0, 1.0, 0.5)], "k double, g double, e double")
    assert tuple(one(advanced.physics_penalty(p, "k", "g", "e"))) == pytest.approx((0.2, 0.05))
    e = spark.range(10).select("id", F.lit("g").alias("g"), (F.col("id") > 4).alias("ok"))
    assert one(advanced.recent_reliability(e, "id", "g", "ok", window=5)).rate == pytest.approx(6 / 7)


def test_selection(spark):
    assert selection.spread_ordinals(10, 4) == [0, 3, 6, 9] and selection.spread_ordinals(2, 5) == [0, 1]
    s = one(spark.createDataFrame([(["a", "b", "c"],)], "v array<string>").select(selection.subsets(F.col("v")).alias("s"))).s
    assert sorted(map(tuple, s)) == sorted([("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")]) and [len(x) for x in s] == sorted(len(x) for x in s)
    o = spark.createDataFrame([("A->B; C->D", 1.0), ("A->B", 3.0), ("bad", 1.0)], "mutations string, reward double")
    first = selection.update_substitutions(None, o)
    again = {(r.old, r.new): (r.n, r.reward) for r in selection.update_substitutions(first, o, decay=0.5).collect()}
    assert again == {("A", "B"): (3.0, 6.0), ("C", "D"): (1.5, 1.5)}
    assert selection.action_logits(first).count() == 2


def test_paths(spark):
    e = spark.createDataFrame([("m", "s", "a", 0.1, 0.2), ("m", "a", "t", 0.1, 0.2), ("m", "s", "t", 0.5, 2.0), ("m", "a", "s", 0.0, 0.0)], "entity string, src string, dst string, delta_g double, activation double")
    ends = lambda n: spark.createDataFrame([("m", n)], "entity string, node string")
    found = pathways.paths(e, ends("s"), ends("t"))
    assert sorted(tuple(r.path) for r in found.collect()) == [("s", "a", "t"), ("s", "t")]
    best = one(pathways.synthesis_score(pathways.best_path(found)))
    assert best.path == ["s", "a", "t"] and 0 < best.synthesis_score < 1
