"""Tensors and the evidential loss against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrolith.functions.numeric import log_gamma
from ferrolith.operators import metrics, tensors


def ranks(x):
    return np.array([sum(y < v - 1e-6 * max(abs(x)) for y in x) + (sum(abs(y - v) <= 1e-6 * max(abs(x)) for y in x) + 1) / 2 for v in x])


def agreement(t, p):
    a, b = np.linalg.eigvalsh(t), np.linalg.eigvalsh(p)
    if np.allclose(a, a[0]) or np.allclose(b, b[0]):
        return float(np.allclose(b, a))
    return float(np.corrcoef(ranks(a), ranks(b))[0, 1])


def test_tensors(spark):
    rng = np.random.default_rng(0)
    made = [rng.normal(size=(3, 3)) * 10.0 ** rng.integers(-3, 4) for _ in range(40)]
    made = [m + m.T for m in made] + [np.eye(3) * 5, np.diag([1.0, 1, 2]), np.diag([2.0, 1, 1]), np.zeros((3, 3)), np.ones((3, 3))]
    other = [m + 0.3 * rng.normal(size=(3, 3)) for m in made[:40]] + [np.eye(3) * 5, np.diag([1.0, 2, 2]), np.diag([3.0, 2, 1]), np.eye(3), np.ones((3, 3))]
    rows = [(i, t.tolist(), p.tolist()) for i, (t, p) in enumerate(zip(made, other, strict=True))]
    odd = [(100, None, rows[0][1]), (101, [[1.0]], rows[0][1]), (102, [[1.0, float("nan"), 0.0]] * 3, rows[0][1]), (103, [[1.0, None, 0.0]] * 3, rows[0][1]), (104, [None, None, None], rows[0][1])]
    df = spark.createDataFrame(rows + odd, "id int, t array<array<double>>, p array<array<double>>")
    got = {r.id: r for r in tensors.with_agreement(df.withColumn("e", tensors.eigenvalues(F.col("t"))), "t", "p").collect()}
    for i, (t, p) in enumerate(zip(made, other, strict=True)):
        assert got[i].e == pytest.approx(np.linalg.eigvalsh(t), abs=1e-7 * max(1, np.abs(t).max()))
        assert got[i].agreement == pytest.approx(agreement(t, p), abs=1e-9), i
    assert {got[i].agreement for i in range(100, 105)} == {None} and len({round(got[i].agreement, 3) for i in range(45)}) > 2
    (r,) = tensors.tensor_report(df, "t", "p").collect()
    assert r.n == 45 and r.frobenius == pytest.approx(np.mean([np.linalg.norm(t - p) for t, p in zip(made, other, strict=True)]))
    known = [*other, *[made[0]] * 5]
    assert r.asymmetry == pytest.approx(np.mean([np.abs(p - p.T).mean() for p in known]))
    (r,) = tensors.tensor_report(df.limit(0), "t", "p").collect()
    assert (r.n, r.frobenius, r.agreement) == (0, 0, 0)


def test_log_gamma(spark):
    x = [1e-8, 0.1, 0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 171.0, 1e4, 1e9]
    got = [r.g for r in spark.createDataFrame([(v,) for v in x], "x double").select(log_gamma(F.col("x")).alias("g")).collect()]
    assert got == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)
    assert [r.g for r in spark.createDataFrame([(0.0,), (-1.5,), (None,)], "x double").select(log_gamma(F.col("x")).alias("g")).collect()] == [None] * 3


def test_evidential_loss(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(map(float, (rng.normal(), rng.normal(), *rng.uniform(0.1, 5, 3)))) for _ in range(50)]
    bad = [(None, 0.0, 1.0, 1.0, 1.0), (float("inf"), 0.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 1.0, -1.0, 1.0)]
    df = spark.createDataFrame(rows + bad, "y double, gamma double, nu double, alpha double, beta double")
    (r,) = metrics.evidential_loss(df, "y", coeff=0.1).collect()
    nll = [0.5 * math.log(math.pi / v) - a * math.log(2 * b) + (a + 0.5) * math.log(v * (y - g) ** 2 + 2 * b) + math.lgamma(a) - math.lgamma(a + 0.5) for y, g, v, a, b in rows]
    reg = [abs(y - g) * (2 * v + a) for y, g, v, a, b in rows]
    assert (r.n, r.nll, r.regularizer, r.loss) == pytest.approx((50, np.mean(nll), np.mean(reg), np.mean(nll) + 0.1 * np.mean(reg)))
    assert metrics.evidential_loss(df.limit(0), "y").collect()[0].loss == 0
