"""Density clusters, components and nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrolith.operators import density, graph, nearest


def brute_clusters(keys, x, eps, least):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    root = {k: k for k, c in zip(keys, core, strict=True) if c}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in zip(*np.nonzero(near & core[:, None] & core[None]), strict=True):
        a, b = sorted((find(keys[i]), find(keys[j])))
        root[b] = a
    out = {}
    for i, k in enumerate(keys):
        touched = [find(keys[j]) for j in np.flatnonzero(near[i] & core)]
        out[k] = ((find(k) if core[i] else min(touched)) if touched else None, bool(core[i]))
    return out


@pytest.mark.parametrize(("d", "tile", "eps"), [(1, 1024, 0.02), (2, 1024, 0.12), (2, 7, 0.12), (3, 20, 0.3), (6, 16, 0.9)])
def test_dbscan(spark, d, tile, eps):
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(size=(60, d)) * 0.2 + c for c in (0, 1.5, -2)] + [rng.uniform(-3, 3, (40, d)), np.full((30, d), 0.25)])
    x = np.round(x, 3)
    keys = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x, strict=True)], "id long, v array<double>")
    got = {r.id: (r.cluster, r.core) for r in density.dbscan(df, "id", "v", eps, 5, tile).collect()}
    want = brute_clusters(keys, x, eps, 5)
    assert got == want
    assert any(c is None for c, _ in want.values()) and len({c for c, _ in want.values()}) > 2 and (d == 6 or any(c is not None and not core for c, core in want.values()))


def test_dbscan_odd(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.5, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [9.0, 9.0]), (6, [9.0, 9.0]), (7, [9.0, 9.0]), (8, [9.5, 9.0]), (9, [10.5, 9.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("p", F.lit(1)).withColumn("cluster", F.lit("x"))
    got = {r.id: (r.cluster, r.core) for r in density.dbscan(df, "id", "v", 0.5, 3).collect()}
    assert got == {1: (None, False), 2: (None, False), 3: (None, False), 4: (None, False), 5: (5, True), 6: (5, True), 7: (5, True), 8: (5, True), 9: (None, False)}
    assert density.dbscan(df.limit(0), "id", "v").count() == 0
    assert density.dbscan(df.where("id in (3, 4)"), "id", "v").collect()[0].cluster is None


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 300)] + [(7, 3), (3, 3), (3, 9), (9, 7), (50, 50)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 301)} | {7: 3, 9: 3}
    assert graph.components(spark.createDataFrame(chain, "a long, b long").limit(0)).count() == 0


def brute_nearest(queries, refs):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    out = {}
    for k, v in queries:
        found = [(-round(float(unit(v) @ unit(r)), 12), o) for o, r in refs if o != k and r is not None] if v is not None else []
        out[k] = (-min(found)[0], min(found)[1]) if found else (None, None)
    return out


@pytest.mark.parametrize(("block", "pivots"), [(2048, None), (40, None), (10, 30), (5, 1)])
def test_nearest(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(nearest, "QUERIES", 25)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(240, 5)) + 3 * rng.integers(-1, 2, (240, 5))
    x[100:130] = x[3]
    x[200] = x[201] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("k", F.lit("k")).withColumn("cell", F.lit(0))
    got = {r.id: (r.nearest, r.neighbour) for r in nearest.nearest(df.where("id % 4 = 0"), df, "id", "v", block, pivots).collect()}
    want = brute_nearest([r for r in rows if r[0] % 4 == 0], rows)
    assert {k: n for k, (_, n) in got.items()} == {k: n for k, (_, n) in want.items()}
    assert all(a == pytest.approx(want[k][0], abs=1e-11) for k, (a, _) in got.items())


def test_nearest_prunes(spark):
    """Far cells aren't met: of two clusters apart, a query is sent to one."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(100, 3)) * 0.01 + c for c in ([1, 0, 0], [0, 1, 0])])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    assert nearest.nearest(df, df, "id", "v", 10, 20).where("abs(id - neighbour) < 100").count() == 200
    assert nearest.nearest(df, df.limit(0), "id", "v").where("nearest is null").count() == 200
    assert nearest.nearest(df.limit(0), df, "id", "v").count() == 0
    assert [r.nearest for r in nearest.nearest(df.limit(1), df.limit(1), "id", "v").collect()] == [None]


def test_tiles_grow_so_that_points_are_sent_few_times(spark, monkeypatch):
    monkeypatch.setattr(density, "TILE", 16)
    x = np.random.default_rng(4).normal(size=(600, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    sent = []
    cut = density.cut
    monkeypatch.setattr(density, "cut", lambda t: sent.append(t.count()) or cut(t) if "side" in t.columns and "pair" in t.columns else cut(t))
    got = {(r.id, r.cluster, r.core) for r in density.dbscan(df, "id", "v", 9.0, 5).collect()}
    want = {(r.id, r.cluster, r.core) for r in density.dbscan(df, "id", "v", 9.0, 5, 16).collect()}
    assert got == want and sent[0] < sent[1] / 4
