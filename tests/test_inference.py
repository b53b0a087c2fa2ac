"""Split search, generalized least squares and topology inference against plain numpy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrolith.operators import gls, split_search, splits, topology
from ferrolith.operators.fusion import beta_quantile


def collected(df):
    return {r.group: r.split for r in df.select("group", "split").distinct().collect()}


def drift(rows):
    """The mean over splits of how far their mean target is from that of all."""
    ys = [y for _, y in rows]
    by = {}
    for s, y in rows:
        by.setdefault(s, []).append(y)
    return sum(abs(sum(v) / len(v) - sum(ys) / len(ys)) for v in by.values()) / len(by)


def test_split_balances_labels(spark):
    formulas = [f for f in ("Li2O", "Na2O", "K2O", "Fe2O3", "Co2O3", "Ni2O3") for _ in range(2)]
    df = spark.createDataFrame([(f"S{i}", f, 10.0 if i < 6 else 0.0) for i, f in enumerate(formulas)], "id string, formula string, y double")
    got = {}
    for weight in (0.0, 2.0):
        rows = splits.compositional_split(df, "id", target="y", label_weight=weight, leakage_weight=0.0, ratios=(0.34, 0.33, 0.33), restarts=16).join(df, "id").collect()
        assert len(rows) == 12 and all(len({r.split for r in rows if r.group == g}) == 1 for g in {r.group for r in rows})
        got[weight] = drift([(r.split, r.y) for r in rows])
    assert got[2.0] <= got[0.0] and got[2.0] < 2


def test_split_keeps_similar_groups_together(spark):
    rows = [("S0", "Li2O", [1.0, 0.0]), ("S1", "Na2O", [0.98, 0.02]), ("S2", "Fe2O3", [0.0, 1.0]), ("S3", "Co2O3", [0.02, 0.98])]
    df = spark.createDataFrame(rows, "id string, formula string, v array<double>")

    def across(weight):
        at = {r.id: r.split for r in splits.compositional_split(df, "id", features="v", leakage_weight=weight, ratios=(0.5, 0.25, 0.25), seed=7).collect()}
        return sum(np.dot(a[2], b[2]) for a, b in itertools.combinations(rows, 2) if at[a[0]] != at[b[0]])

    assert across(2.0) <= across(0.0) and across(2.0) < 2


@pytest.mark.parametrize("kind", [None, "sets", "vectors", "spacegroups"])
def test_split_cost(spark, kind):
    """The stated cost of what is returned, from the definition; no restart ends above what it dealt."""
    rng = np.random.default_rng(2)
    groups = [f"g{i}" for i in range(30)]
    trait = {"sets": lambda i: [f"e{i % 3}", f"e{i % 7}"], "vectors": lambda i: [float(i % 5), 1.0, float(i % 3)], "spacegroups": lambda i: [float(i * 8 + 1)]}.get(kind, lambda i: None)
    rows = [(k, groups[i], float(rng.integers(0, 9)) if k % 5 else None, trait(i)) for k, i in enumerate(rng.integers(0, 30, 400))]
    df = spark.createDataFrame(rows, f"k int, group string, y double, trait array<{'string' if kind == 'sets' else 'double'}>")
    by, _ = split_search.units(df, "group", F.col("y"), F.col("trait"), kind, 4096)
    tried = split_search.search(by, (0.6, 0.2, 0.2), label_weight=0.3, kind=kind, leakage_weight=0.4).collect()
    assert len({r.restart for r in tried}) == 8 and all(r.cost <= r.dealt + 1e-9 for r in tried)
    first = min((round(r.cost, 9), r.restart) for r in tried)
    at = {r.unit[2:]: split_search.NAMES.index(r.split) for r in tried if r.restart == first[1]}
    assert at == {g: split_search.NAMES.index(s) for g, s in collected(splits.group_split(df, "k", "group", target=F.col("y"), trait=F.col("trait"), kind=kind, label_weight=0.3, leakage_weight=0.4, ratios=(0.6, 0.2, 0.2))).items()}
    want = np.array([0.6, 0.2, 0.2])
    n, g = np.bincount([at[r[1]] for r in rows], minlength=3), np.bincount(list(at.values()), minlength=3)
    ys = np.array([r[2] for r in rows if r[2] is not None])
    cost = (((n - 400 * want) / (400 * want)) ** 2).sum() + 0.15 * (((g - len(at) * want) / (len(at) * want)) ** 2).sum()
    cost += 0.3 * np.mean([((np.mean([r[2] for r in rows if r[2] is not None and at[r[1]] == s]) - ys.mean()) / ys.std()) ** 2 for s in range(3)])
    if kind:
        w = {(0, 1): 0.5, (0, 2): 1.0, (1, 2): 0.5}
        similar = split_search.SIMILAR[kind]([trait(int(u[1:])) for u in at])
        pairs = list(itertools.combinations(range(len(at)), 2))
        place = list(at.values())
        cost += 0.4 * sum(w.get(tuple(sorted((place[a], place[b]))), 0) * similar[a, b] for a, b in pairs) / len(pairs)
    assert cost == pytest.approx(first[0], abs=1e-8)


def test_split_odd(spark):
    df = spark.createDataFrame([(i, None if i < 5 else f"g{i % 3}", float("nan") if i % 2 else 1.0) for i in range(40)] + [(1, "g1", None)], "k int, group string, y double")
    rows = splits.group_split(df, "k", "group", target=F.col("y"), label_weight=1.0).collect()
    assert len(rows) == 41 and {r.split for r in rows} == {"train", "val", "test"} and len({r.split for r in rows if r.group is None}) == 1
    assert splits.group_split(df.limit(0), "k", "group").count() == 0
    assert {r.split for r in splits.group_split(df, "k", "group", ratios=(1, 0, 0)).collect()} == {"train"}
    huge = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), "id")).alias("group"))
    rows = splits.group_split(huge, "id", "group", most_units=64).collect()  # more groups than units: bundles
    share = {s: sum(r.split == s for r in rows) / 3000 for s in split_search.NAMES}
    assert len(rows) == 3000 and len({r.split for r in rows if r.group == "hot"}) == 1
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["val"] - 0.1) < 0.03
    for ratios in ((0, 0, 0), (-1, 1, 1), (float("nan"), 1, 1)):
        with pytest.raises(ValueError):
            splits.group_split(df, "k", "group", ratios=ratios)


CORR = np.array([[1, 0.95, 0.3, 0.1], [0.95, 1, 0.4, 0.2], [0.3, 0.4, 1, 0.5], [0.1, 0.2, 0.5, 1]])


def solved(values, stds, corr, constrained):
    cov, on = np.outer(stds, stds) * corr, list(range(len(stds)))
    while True:
        w = np.linalg.solve(cov[np.ix_(on, on)], np.ones(len(on)))
        w = w / w.sum()
        if not constrained or (w >= -1e-12).all():
            break
        on.pop(int(w.argmin()))
    full = np.zeros(len(stds))
    full[on] = np.clip(w, 0, None) if constrained else w
    full /= full.sum()
    return full, full @ values, math.sqrt(full @ cov @ full), cov


@pytest.mark.parametrize("constrained", [True, False])
def test_gls(spark, constrained):
    rng, names = np.random.default_rng(4), ["a", "b", "c", "d"]
    rel = {"a": 0.5, "b": 0.9, "c": 0.7, "d": 1.0}
    rows, want = [], {}
    for e in range(60):
        there = [i for i in range(4) if rng.random() < 0.7]
        each = [(i, float(rng.normal()), float(rng.uniform(0.05, 1)), float(rng.choice([0, 0.5]))) for i in there]
        rows += [(e, names[i], v, s, d if d else None) for i, v, s, d in each]
        if each:
            stds = np.array([s / math.sqrt(rel[names[i]] * math.exp(-2 * d)) for i, _, s, d in each])
            want[e] = (there, solved(np.array([v for _, v, _, _ in each]), stds, CORR[np.ix_(there, there)], constrained))
    rows += [(0, "zz", 1.0, 1.0, 0.0), (1, "a", float("nan"), 1.0, 0.0), (1, "a", 1.0, 0.0, 0.0), (999, "b", None, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "entity long, source string, value double, std double, drift double")
    got = {r.entity: r for r in gls.fuse(df, rel, CORR, drift_decay=2.0, constrained=constrained).collect()}
    assert set(got) == set(want)
    left_out = 0
    for e, (there, (w, mean, std, cov)) in want.items():
        r = got[e]
        assert (r["mean"], r["std"], r.n_eff) == pytest.approx((mean, std, 1 / (w @ w)), abs=1e-9)
        assert [r.weights[names[i]] for i in there] == pytest.approx(list(w), abs=1e-9) and len(r.weights) == len(there)
        if constrained:  # Karush-Kuhn-Tucker: the gradient is least, and equal, where weights are positive
            slope = cov @ w
            assert slope[w > 1e-9] == pytest.approx(np.full((w > 1e-9).sum(), w @ cov @ w), abs=1e-9) and (slope >= w @ cov @ w - 1e-9).all()
            left_out += (w <= 1e-12).sum()
    assert left_out > 3 or not constrained
    assert gls.fuse(df.limit(0), rel, CORR).count() == 0
    with pytest.raises(ValueError):
        gls.inverses(np.eye(11))


def test_residual_correlation(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=50)
    traces = {"a": x, "b": np.append([9.0, -9.0], x + rng.normal(size=50)), "c": rng.normal(size=2), "d": -x[20:]}
    rows = [(s, i, float(v)) for s, t in traces.items() for i, v in enumerate(t)] + [("a", 99, float("inf"))]
    got = gls.residual_correlation(spark.createDataFrame(rows, "source string, at int, residual double"), list(traces), 0.2)
    tail = lambda s, t: np.corrcoef(traces[s][-(n := min(len(traces[s]), len(traces[t]))) :], traces[t][-n:])[0, 1]
    raw = np.eye(4)
    for i, j in itertools.combinations(range(4), 2):
        if 2 not in (i, j):
            raw[i, j] = raw[j, i] = np.clip(tail("abcd"[i], "abcd"[j]), -0.99, 0.99)
    assert got == pytest.approx(gls.proper_correlation(0.8 * raw + 0.2 * np.eye(4)), abs=1e-9) and got[0, 3] < -0.7


def evidence(spark, n=300):
    rng = np.random.default_rng(8)
    some = lambda x, p: None if rng.random() < p else float(x)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.5)
        kind = {0: "TRIVIAL", 1: rng.choice(["TI", "weyl"])}[y] if i % 3 else None
        rows.append((i, some(rng.normal(y - 0.5, 0.5), 0.3), some(rng.normal(0.3 + 0.4 * y, 0.3), 0.3), some(rng.uniform(), 0.3), some(rng.uniform(), 0.5), kind, float(i % 4) / 20))
    rows += [(n, None, None, None, None, "TI", None), (n + 1, float("nan"), float("inf"), None, -3.0, "UNKNOWN", 0.0)]
    return spark.createDataFrame(rows, "jid int, si_score double, spillage double, ml_probability double, ml_uncertainty double, topo_class string, band_gap double")


def test_topology_like_a_row_at_a_time(spark):
    df = evidence(spark)
    table = topology.channel_columns(df.withColumn("y", topology.truth("topo_class", df)))
    fit = topology.fit_channels(table, "y")
    rows = table.collect()
    ps, cs, y = (np.array([[math.nan if r[f"{w}_{c}"] is None else r[f"{w}_{c}"] for c in topology.CHANNELS] for r in rows]) for w in "pc"), None, np.array([math.nan if r.y is None else r.y for r in rows])
    ps, cs = ps
    assert np.isfinite(ps).any(axis=0).all() and {r.y for r in rows} == {0.0, 1.0, None}
    err = ps - y[:, None]
    for k, c in enumerate(topology.CHANNELS):
        e = np.abs(err[np.isfinite(err[:, k]), k])
        assert fit.counts[c] == pytest.approx((2 + (1 - e).sum(), 2 + e.sum()))
    raw = np.eye(3)
    for i, j in itertools.combinations(range(3), 2):
        ok = np.isfinite(err[:, i]) & np.isfinite(err[:, j])
        raw[i, j] = raw[j, i] = np.corrcoef(err[ok, i], err[ok, j])[0, 1]
    corr = gls.proper_correlation(0.75 * raw + 0.25 * np.eye(3))
    assert fit.correlation == pytest.approx(corr, abs=1e-9)
    got = {r.jid: r for r in topology.infer(table, fit, "y", relabel=True).collect()}
    rel = np.array(list(fit.reliability().values()))
    for i, r in enumerate(rows):
        on = np.flatnonzero(np.isfinite(ps[i]))
        if on.size:
            info = np.array(topology.WEIGHTS)[on] * rel[on] * np.clip(cs[i, on], 0.05, 1)
            sub = corr[np.ix_(on, on)]
            w = np.clip(np.linalg.solve(sub / np.sqrt(np.outer(info, info)), np.ones(on.size)), 0, None)
            q = np.clip(ps[i, on], 1e-9, 1 - 1e-9)
            p = 1 / (1 + math.exp(-(w @ np.log(q / (1 - q))) / w.sum()))
            off = np.abs(sub[np.triu_indices(on.size, 1)])
            n = max(24 * info.sum() / (1 + (off.mean() if off.size else 0) * (on.size - 1)), 1)
        else:
            p, n = (0.5 if math.isnan(y[i]) else y[i]), 12.0
        g = got[r.jid]
        assert (g.topological_probability, g.n_eff) == pytest.approx((p, n), abs=1e-9)
        assert g.topo_class == ("TRIVIAL" if p < 0.55 else "TSM" if (r.band_gap or 0) <= 0.05 else "TI")
        assert 0 <= g.topology_ci_low <= g.topology_ci_high <= 1
        if i % 60 == 0:
            level = math.erf(1.96 / math.sqrt(2))
            assert (g.topology_ci_low, g.topology_ci_high) == pytest.approx(tuple(beta_quantile(1 + p * n, 1 + (1 - p) * n, q) for q in ((1 - level) / 2, (1 + level) / 2)), abs=1e-9)
    assert topology.infer(table.limit(0), fit, "y").count() == 0
    few = topology.fit_channels(table.limit(5), "y")
    assert few.counts == topology.UNFITTED.counts and (few.correlation == np.eye(3)).all()
    assert topology.fit_channels(table.limit(0), "y").counts == topology.UNFITTED.counts


def test_topology_orders_clear_evidence(spark):
    df = spark.createDataFrame([("topo", 1.5, 1.2, 0.9, 0.05), ("trivial", -1.2, 0.02, 0.1, 0.05)], "jid string, si_score double, spillage double, ml_probability double, ml_uncertainty double")
    got = {r.jid: r for r in topology.infer(topology.channel_columns(df), topology.UNFITTED, override={"ml": 0.9, "nothing": 3.0}).collect()}
    t = got["topo"]
    assert t.topological_probability > got["trivial"].topological_probability
    assert 0 <= t.topology_ci_low <= t.topological_probability <= t.topology_ci_high <= 1


def test_cross_fitted_temperature(spark):
    rng = np.random.default_rng(6)
    p = np.clip(rng.beta(0.3, 0.3, 900), 0.001, 0.999)  # overconfident: labels follow a cooler chance
    y = (rng.random(900) < 1 / (1 + np.exp(-np.log(p / (1 - p)) / 3))).astype(float)
    df = spark.createDataFrame([(i, float(a), None if i % 10 == 0 else float(b)) for i, (a, b) in enumerate(zip(p, y, strict=True))], "k int, p double, y double")
    fit = topology.fit_temperature(df, "p", "y", "k")
    assert fit.n == 810 and 2 < fit.whole < 4.5 and all(2 < t < 4.5 for t in fit.of_fold)
    again = topology.fit_temperature(df.repartition(7), "p", "y", "k")
    assert again == fit
    (d,) = topology.diagnose(df, "p", "y", "k", fit).collect()
    assert d.eval_scheme == "cross_fit" and d.folds_used == 3 and d.after_nll < d.before_nll and d.after_ece < d.before_ece and d.before_n == d.after_n == 810
    none = topology.fit_temperature(df.limit(0), "p", "y", "k")
    assert none.whole == 1 and none.of_fold == [None] * 3
    (d,) = topology.diagnose(df.where("k < 8"), "p", "y", "k", topology.fit_temperature(df.where("k < 8"), "p", "y", "k")).collect()
    assert d.eval_scheme == "in_sample" and d.temperature == 1


def test_ood_score(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (None,)], "s double")
    got = [r.o for r in df.select(topology.ood_score(F.col("s")).alias("o")).collect()]
    assert got == pytest.approx([1 / (1 + math.e), 1 / (1 + math.exp(-0.65 / 0.35)), 1 / (1 + math.exp(-0.65 / 0.35))])
