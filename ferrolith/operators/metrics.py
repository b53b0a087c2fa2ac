"""Evaluation: regression, uncertainty, classification, conformal, folds, bootstrap."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.numeric import finite, log_gamma, normal_cdf, normal_pdf
from ferrolith.operators.ordered import average_ranks, cumulative, cut


def regression(df: DataFrame, target: str, pred: str, empty: float | None = None, by: list[str] | None = None) -> DataFrame:
    """n, mae, rmse, r2, max_error over finite pairs. Without pairs they are ``empty``; a flat target has no r2."""
    t, p = finite(F.col(target).cast("double")), finite(F.col(pred).cast("double"))
    pairs = df.select(*(by or []), t.alias("t"), p.alias("p")).where("t is not null and p is not null")
    e = F.col("t") - F.col("p")
    made = pairs.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("sse"), (F.var_pop("t") * F.count("*")).alias("sst"), F.max(F.abs(e)).alias("max_error"))
    fill = F.lit(empty).cast("double")
    r2 = F.when(F.col("sst") > 1e-12, 1 - F.col("sse") / F.col("sst")).otherwise(fill)
    return made.select(*(by or []), "n", *(F.coalesce(c, fill).alias(c) for c in ("mae", "rmse")), r2.alias("r2"), F.coalesce("max_error", fill).alias("max_error"))


def uncertainty(df: DataFrame, target: str, pred: str, std: str) -> DataFrame:
    """One row: mean std, Gaussian NLL, CRPS, coverage of the 90 and 95 % intervals, interval score, residual moments."""
    s = F.greatest(F.col(std), F.lit(1e-9))
    z = (F.col(target) - F.col(pred)) / s
    z90, z95 = NormalDist().inv_cdf(0.95), NormalDist().inv_cdf(0.975)
    crps = s * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))
    score = 2 * z95 * s + 40 * F.greatest(F.abs(F.col(target) - F.col(pred)) - z95 * s, F.lit(0.0))
    return df.agg(
        F.count("*").alias("n"), F.avg(s).alias("mean_std"), F.avg(0.5 * math.log(2 * math.pi) + F.ln(s) + 0.5 * z * z).alias("nll"), F.avg(crps).alias("crps"),
        F.avg((F.abs(z) <= z90).cast("double")).alias("coverage90"), F.avg((F.abs(z) <= z95).cast("double")).alias("coverage95"), F.avg(score).alias("interval_score"), F.avg(z).alias("z_mean"), F.stddev_pop(z).alias("z_std"),
    )


def classification(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1; empty ratios are 0."""
    p, y = (F.col(score) >= threshold).cast("int"), F.col(label)
    c = df.agg(F.count("*").alias("n"), F.sum(p * y).alias("tp"), F.sum(p * (1 - y)).alias("fp"), F.sum((1 - p) * y).alias("fn"), F.sum((1 - p) * (1 - y)).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = c.withColumns({"accuracy": ratio(F.col("tp") + F.col("tn"), F.col("n")), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the area under the ROC curve by the rank sum, ties shared; 0.5 with one class alone."""
    ranked = average_ranks(df.select(F.col(score).alias("s"), F.col(label).alias("y")), "s")
    t = ranked.agg(F.sum(F.when(F.col("y") == 1, F.col("rank")).otherwise(0.0)).alias("r"), F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("n"))
    return t.select(F.coalesce(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n")), F.lit(0.5)).alias("auc"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the correlation of the average ranks."""
    ranked = average_ranks(average_ranks(df.select(a, b), a, "ra"), b, "rb")
    return ranked.agg(F.corr("ra", "rb").alias("spearman"))


def conformal_quantile(df: DataFrame, target: str, pred: str, coverage: float = 0.9) -> DataFrame:
    """One row: the ceil((n + 1) c)-th smallest absolute residual, the n-th at most."""
    r = df.select(F.abs(F.col(target) - F.col(pred)).alias("r")).where("r is not null").groupBy("r").agg(F.count("*").alias("m"))
    r = cut(r)
    n = r.agg(F.sum("m").alias("n"))
    run = cumulative(r, [], "r", {"last": "m"}).crossJoin(F.broadcast(n))  # one row
    k = F.least(F.greatest(F.ceil((F.col("n") + 1) * coverage), F.lit(1)), F.col("n"))
    return run.where(F.col("last") >= k).agg(F.min("r").alias("quantile"))


def fold_summary(folds: DataFrame, metrics: list[str], weight: str = "n_valid") -> DataFrame:
    """(metric, n, mean, std, weighted_mean) over folds with a finite value."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), finite(F.col(m).cast("double")).alias("value"), F.col(weight).cast("double").alias("w")) for m in metrics))
    long = folds.select(F.explode(rows).alias("x")).select("x.*").where("value is not null")
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.try_divide(F.sum(F.col("value") * F.col("w")), F.sum("w")).alias("weighted_mean"))


def bootstrap_mean(df: DataFrame, value: str, key: str, resamples: int = 400, level: float = 0.95, seed: int = 0) -> DataFrame:
    """One row (low, high): quantiles of the resampled means by Poisson weights.

    A row's weights are drawn from its key's hash inside the task: one pass, and 2 * resamples sums.
    """
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros(resamples), np.zeros(resamples)
        for b in batches:
            for h, v in zip(b.h, b.v, strict=True):
                w = np.random.default_rng((seed, h & (2**63 - 1))).poisson(1.0, resamples)
                n += w
                s += w * v
        yield pd.DataFrame({"i": np.arange(resamples), "n": n, "s": s})

    sums = df.select(F.xxhash64(key).alias("h"), F.col(value).cast("double").alias("v")).where("v is not null").mapInPandas(run, "i long, n double, s double").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return sums.agg(F.percentile("mean", F.lit((1 - level) / 2)).alias("low"), F.percentile("mean", F.lit((1 + level) / 2)).alias("high"))


def losses(df: DataFrame, target: str, pred: str, delta: float = 1.0) -> DataFrame:
    """One row: mean squared, absolute and Huber loss."""
    e = F.abs(F.col(target) - F.col(pred))
    return df.agg(F.avg(e * e).alias("mse"), F.avg(e).alias("l1"), F.avg(F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))).alias("huber"))


def cross_entropy(logit: Column, label: Column) -> Column:
    """The binary loss of a logit, stable for large ones."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def ensemble(members: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population std over members; missing values count 0, infinite ones a million."""
    v = F.col(value).cast("double")
    safe = F.when(v.isNull() | F.isnan(v), 0.0).when(F.abs(v) == math.inf, F.signum(v) * 1e6).otherwise(v)
    return members.withColumn("__v", safe).groupBy(*keys).agg(F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("std"))


def evidential_loss(df: DataFrame, target: str, gamma: str = "gamma", nu: str = "nu", alpha: str = "alpha", beta: str = "beta", coeff: float = 0.01) -> DataFrame:
    """One row: n, nll, regularizer and loss, means over the rows; 0 without any.

    The negative log-likelihood of a normal-inverse-gamma prediction and ``coeff`` times the error weighed
    by its evidence, 2 nu + alpha. Rows with a null, a value that is not finite, or nu, alpha or beta of 0
    or less don't count.
    """
    y, m, v, a, b = (F.col(c).cast("double") for c in (target, gamma, nu, alpha, beta))
    ok = F.lit(True)
    for c in (y, m, v, a, b):
        ok = ok & (F.abs(c) < math.inf)
    for c in (v, a, b):
        ok = ok & (c > 0)
    error = F.abs(y - m)
    nll = 0.5 * F.ln(math.pi / v) - a * F.ln(2 * b) + (a + 0.5) * F.ln(v * error * error + 2 * b) + log_gamma(a) - log_gamma(a + 0.5)
    rows = df.where(ok).select(nll.alias("nll"), (error * (2 * v + a)).alias("reg"))
    mean = lambda x: F.coalesce(F.avg(x), F.lit(0.0))
    return rows.agg(F.count("*").alias("n"), mean("nll").alias("nll"), mean("reg").alias("regularizer"), mean(F.col("nll") + coeff * F.col("reg")).alias("loss"))
