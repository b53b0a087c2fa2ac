"""Two-sample drift: Wasserstein, Kolmogorov-Smirnov, histogram KL, kernel MMD, energy distance, q-values.

Samples are long tables (property, value) of finite values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.operators.ordered import cumulative, cut, with_next


def _pooled(old: DataFrame, new: DataFrame) -> DataFrame:
    """(property, value, old, new, n_old, n_new, f_old, f_new): both empirical distributions on the pooled values."""
    both = old.select("property", "value", F.lit(1).alias("o"), F.lit(0).alias("n")).unionAll(new.select("property", "value", F.lit(0).alias("o"), F.lit(1).alias("n")))
    grid = cut(both.groupBy("property", "value").agg(F.sum("o").alias("old"), F.sum("n").alias("new")))
    totals = grid.groupBy("property").agg(F.sum("old").alias("n_old"), F.sum("new").alias("n_new"))
    run = cumulative(grid, ["property"], "value", {"c_old": "old", "c_new": "new"}).join(F.broadcast(totals), "property")  # a row a property
    return run.where("n_old > 0 and n_new > 0").withColumn("f_old", F.col("c_old") / F.col("n_old")).withColumn("f_new", F.col("c_new") / F.col("n_new"))


def wasserstein(old: DataFrame, new: DataFrame, pooled: DataFrame | None = None) -> DataFrame:
    """(property, wasserstein): the area between the two distribution functions, 0 under 2 values a side.

    ``pooled``: both distributions, where the caller has them.
    """
    run = with_next(_pooled(old, new) if pooled is None else pooled, ["property"], "value", "next")  # |F - G| is constant up to the next pooled value
    area = run.groupBy("property").agg(F.sum(F.abs(F.col("f_old") - F.col("f_new")) * (F.col("next") - F.col("value"))).alias("w"), F.first("n_old").alias("n_old"), F.first("n_new").alias("n_new"))
    return area.select("property", F.when((F.col("n_old") >= 2) & (F.col("n_new") >= 2), F.coalesce("w", F.lit(0.0))).otherwise(0.0).alias("wasserstein"))


def ks_pvalue(stat: Column, n: Column, m: Column) -> Column:
    """The asymptotic two-sample p-value, 100 terms."""
    root = F.sqrt(n * m / (n + m))
    x = (root + 0.12 + F.lit(0.11) / root) * stat
    term = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * x * x)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + term(k))
    return F.when(x > 1e-9, F.least(F.greatest(2 * total, F.lit(0.0)), F.lit(1.0))).otherwise(1.0)


def kolmogorov_smirnov(old: DataFrame, new: DataFrame, pooled: DataFrame | None = None) -> DataFrame:
    """(property, ks_stat, ks_pvalue, n_old, n_new); under 5 values a side (0, 1). ``pooled`` as in ``wasserstein``."""
    both = _pooled(old, new) if pooled is None else pooled
    stat = both.groupBy("property").agg(F.max(F.abs(F.col("f_old") - F.col("f_new"))).alias("ks"), F.first("n_old").alias("n_old"), F.first("n_new").alias("n_new"))
    enough = (F.col("n_old") >= 5) & (F.col("n_new") >= 5)
    pvalue = ks_pvalue(F.col("ks"), F.col("n_old"), F.col("n_new"))
    return stat.select("property", F.when(enough, F.col("ks")).otherwise(0.0).alias("ks_stat"), F.when(enough, pvalue).otherwise(1.0).alias("ks_pvalue"), "n_old", "n_new")


def histogram_kl(old: DataFrame, new: DataFrame, bins: int = 50, eps: float = 1e-8) -> DataFrame:
    """(property, kl): KL(new || old) on shared bins, ``eps`` added to each share; 0 under 10 values a side."""
    both = old.select("property", "value", F.lit(1).alias("o"), F.lit(0).alias("n")).unionAll(new.select("property", "value", F.lit(0).alias("o"), F.lit(1).alias("n")))
    span = both.groupBy("property").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("o").alias("n_old"), F.sum("n").alias("n_new")).where("n_old >= 10 and n_new >= 10 and hi > lo")
    binned = both.join(F.broadcast(span), "property").withColumn("bin", F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)))
    counts = binned.groupBy("property", "bin").agg((F.sum("n") / F.first("n_new") + eps).alias("p"), (F.sum("o") / F.first("n_old") + eps).alias("q"))
    # empty bins add eps * ln(eps / eps) = 0
    kl = counts.groupBy("property").agg(F.greatest(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))), F.lit(0.0)).alias("kl"))
    names = both.select("property").distinct()
    return names.join(kl, "property", "left").select("property", F.coalesce("kl", F.lit(0.0)).alias("kl"))


def q_values(pvalues: DataFrame, p: str = "ks_pvalue") -> DataFrame:
    """Benjamini-Hochberg q-values over the rows of a table of tests (a row a property)."""
    up = Window.orderBy(p, "property")
    down = Window.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = pvalues.withColumn("__rank", F.row_number().over(up)).withColumn("__m", F.count("*").over(Window.partitionBy()))
    return ranked.withColumn("q_value", F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__rank")).over(down))).drop("__rank", "__m")


def _sample(values: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` values a property, drawn as rows: by a hash of the column ``key`` where there is one, else at random.

    Rows of equal values are drawn one by one, so that ties have their share. Spark keeps the first
    ``most`` rows of each partition before it shuffles.
    """
    drawn = F.xxhash64(F.lit(seed), "property", "key") if "key" in values.columns else F.rand(seed)
    w = Window.partitionBy("property").orderBy("__drawn", "value")
    numbered = values.withColumn("__drawn", drawn).withColumn("__at", F.row_number().over(w))
    return numbered.where(F.col("__at") <= most).select("property", "value")


def mmd_squared(x: np.ndarray, y: np.ndarray) -> float:
    """The unbiased squared maximum mean discrepancy, 0 at least, Gaussian kernel, median-heuristic bandwidth."""
    z = np.concatenate((x, y))
    gaps = np.abs(z[:, None] - z[None])
    positive = gaps[gaps > 1e-12]
    width = float(np.median(positive)) if positive.size else 1.0
    k = np.exp(-(gaps**2) / (2 * width**2))
    n, m = len(x), len(y)
    if min(n, m) < 2:
        return 0.0
    return max(0.0, (k[:n, :n].sum() - n) / (n * (n - 1)) + (k[n:, n:].sum() - m) / (m * (m - 1)) - 2 * k[:n, n:].mean())


def mmd(old: DataFrame, new: DataFrame, most: int = 512) -> DataFrame:
    """(property, mmd2) on at most ``most`` values a side."""
    both = _sample(old, most).withColumn("side", F.lit(0)).unionAll(_sample(new, most).withColumn("side", F.lit(1)))

    def run(t: pd.DataFrame) -> pd.DataFrame:  # at most 2 * most rows
        return pd.DataFrame({"property": [t.property.iloc[0]], "mmd2": [mmd_squared(t.value[t.side == 0].to_numpy(), t.value[t.side == 1].to_numpy())]})

    return both.groupBy("property").applyInPandas(run, "property string, mmd2 double")


def drift(old: DataFrame, new: DataFrame, alpha: float = 0.05, effect: float = 0.1, mmd_effect: float = 0.01) -> DataFrame:
    """Each property's tests, and ``alert``: q-value, scaled distance and MMD all say so. Needs 10 values a side."""
    pooled = cut(_pooled(old, new))
    ks = kolmogorov_smirnov(old, new, pooled).where("n_old >= 10 and n_new >= 10")
    iqr = old.groupBy("property").agg((F.percentile("value", F.lit(0.75)) - F.percentile("value", F.lit(0.25))).alias("iqr"))
    met = q_values(ks).join(wasserstein(old, new, pooled), "property").join(mmd(old, new), "property").join(iqr, "property")
    met = met.withColumn("scaled_wasserstein", F.col("wasserstein") / F.when(F.col("iqr") > 1e-12, F.col("iqr")).otherwise(1.0)).drop("iqr")
    return met.withColumn("alert", (F.col("q_value") <= alpha) & (F.col("scaled_wasserstein") >= effect) & (F.col("mmd2") >= mmd_effect))
