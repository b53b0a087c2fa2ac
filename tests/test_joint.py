"""Joint drift, fuzzy search and schedules against plain Python."""

import math
from difflib import SequenceMatcher, get_close_matches

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrolith.operators import acquisition, joint, search


def energy(x, y):
    gap = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).sum()
    n, m = len(x), len(y)
    return max(0, 2 * gap(x, y) / (n * m) - gap(x, x) / (n * (n - 1)) - gap(y, y) / (m * (m - 1)))


def standard(x, y):
    z = np.vstack([x, y])
    middle = np.median(z, axis=0)
    mad = 1.4826 * np.median(np.abs(z - middle), axis=0)
    scale = np.where(mad > 1e-8, mad, z.std(axis=0))
    return (x - middle) / scale, (y - middle) / scale


def sides(spark, x, y):
    kind = ", ".join(["id int", *(f"a{i} double" for i in range(x.shape[1]))])
    return [spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], kind) for v in (x, y)]


@pytest.mark.parametrize("in_range", [1_000_000, 70])
def test_one_property_is_exact(spark, monkeypatch, in_range):
    monkeypatch.setattr(joint, "RANGE_ROWS", in_range)
    monkeypatch.setattr(joint, "STEP", 16)
    rng = np.random.default_rng(0)
    x, y = np.round(rng.normal(size=(150, 1)), 1), np.round(rng.normal(size=(90, 1)) + 0.4, 1)
    (r,) = joint.joint_drift(*sides(spark, x, y), ["a0"], "id", permutations=39).collect()
    assert (r.n_old, r.n_new, r.n_features) == (150, 90, 1)
    assert r.energy_distance == pytest.approx(energy(*standard(x, y)), abs=1e-9)
    # the permutations, from the same labels
    u, side = joint.features(*sides(spark, x, y), ["a0"], "id")[0].select("u", "side", "x0").toPandas().pipe(lambda t: (t[["u", "x0"]], t.side))
    labels = joint._labels(side.to_numpy(), u.u.to_numpy(), joint.multipliers(39), 150 / 240)
    z = u.x0.to_numpy()[:, None]
    each = [energy(z[labels[:, b]], z[~labels[:, b]]) for b in range(40)]
    assert each[0] == pytest.approx(r.energy_distance, abs=1e-9)
    assert r.pvalue == (1 + sum(e >= each[0] - 1e-12 for e in each[1:])) / 40


def test_several_properties(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 3)), rng.normal(size=(200, 3)) * [1, 1, 2] + [0, 1, 0]
    (r,) = joint.joint_drift(*sides(spark, x, y), ["a0", "a1", "a2"], "id", count=128, permutations=39).collect()
    assert r.energy_distance == pytest.approx(energy(*standard(x, y)), rel=0.1) and r.pvalue == 1 / 40 and r.alert
    (r,) = joint.joint_drift(*sides(spark, x, rng.normal(size=(180, 3))), ["a0", "a1", "a2"], "id", permutations=39).collect()
    assert r.energy_distance < 0.1 and not r.alert


def test_missing_values_are_a_shift(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(120, 2)), rng.normal(size=(120, 2))
    y[::2, 1] = np.nan
    (r,) = joint.joint_drift(*sides(spark, x, y), ["a0", "a1"], "id", permutations=39).collect()
    assert r.n_features == 3 and r.pvalue == 1 / 40


def test_skipped(spark):
    a, b = sides(spark, np.ones((40, 2)), np.ones((40, 2)))
    for args, why in (((a, b, ["a0"], "id"), "no feature varies"), ((a, b, [], "id"), "no properties"), ((a.limit(0), b, ["a0"], "id"), "few rows"), ((a.limit(0), b.limit(0), ["a0"], "id"), "few rows"), ((a.withColumn("a0", F.lit(None).cast("double")), b.withColumn("a0", F.lit(float("nan"))), ["a0"], "id"), "no feature varies")):
        (r,) = joint.joint_drift(*args).collect()
        assert (r.reason, r.alert, r.energy_distance) == (why, False, None)


NAMES = ["Fe2O3", "Fe3O4", "FeO", "Fe2O3", "Al2O3", "Fe2(SO4)3", "SiO2", "", "FeFeO3O2", "O3Fe2", "Fe2O3.nH2O", "é́Fe2O", None, "abcabba", "cbabac", "Fe"]


@pytest.mark.parametrize("query", ["Fe2O3", "cbabacab", "O", "aXbXc", "SiO2Fe"])
def test_ratio_is_that_of_matching_blocks(spark, query):
    df = spark.createDataFrame([(n,) for n in NAMES], "formula string")
    got = {r.formula: r.ratio for r in search.matching(df.where("formula is not null"), query, "formula").collect()}
    assert got == {n: pytest.approx(SequenceMatcher(None, n, query).ratio()) for n in set(NAMES) if n is not None}


@pytest.mark.parametrize(("query", "cutoff", "k"), [("Fe2O3", 0.6, 5), ("Fe2O3", 0.6, 1), ("Fe2O3", 0.0, 30), ("Si", 0.3, 3), ("zzz", 0.6, 5), ("  FeO ", 0.5, 4)])
def test_fuzzy(spark, query, cutoff, k):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "id int, formula string").withColumn("n", F.lit(0))
    known = [n for n in NAMES if n is not None]
    want = set(get_close_matches(query.strip(), known, n=k, cutoff=cutoff))
    assert {r.formula for r in search.fuzzy(df, query, cutoff=cutoff, k=k).collect()} == want
    assert sorted(r.id for r in search.fuzzy_search(df, query, cutoff=cutoff, k=k).collect()) == [i for i, n in enumerate(NAMES) if n in want]
    assert search.fuzzy(df, " ").count() == 0 and search.fuzzy(df.limit(0), query).count() == 0


def test_kappa_schedules():
    k = acquisition.kappa
    assert k(7) == 2.0 and k(1, "anneal") == 2.0 and k(11, "anneal") == pytest.approx(1 + math.exp(-0.8)) and k(3, "anneal", base=0.5) == 1.0
    assert k(5, "gp_ucb", dims=4) == pytest.approx(math.sqrt(2 * math.log(5**4 * math.pi**2 / 0.3))) and k(0, "gp_ucb", delta=0.999999, floor=9.0) == 9.0
    with pytest.raises(ValueError):
        k(1, "other")


def test_names_are_matched_once_each(spark):
    df = spark.range(100).selectExpr("concat('Fe', id % 3) as formula")
    plan = search.fuzzy(df, "Fe2", cutoff=0.5, k=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" not in plan  # nothing can be pushed below the table of names
