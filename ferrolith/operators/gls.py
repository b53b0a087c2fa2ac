"""Generalized least squares over correlated sources, as columns.

With standard deviations s and a correlation matrix R, least-variance weights are the row sums of the
inverse covariance: w_i = u_i sum_j inv(R)_ij u_j, u = 1 / s. Which sources a row has (its mask) decides
the block of R, so that the inverses of all blocks are constants of the plan: 2^k of them for k sources,
and k is at most MOST_SOURCES, as sources are methods and not rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.numeric import total
from ferrolith.operators.ordered import cumulative, cut

MOST_SOURCES = 10


def proper_correlation(matrix: np.ndarray) -> np.ndarray:
    """The matrix made symmetric and positive by a floor of 1e-10 under its eigenvalues, with a diagonal of 1 and no entry over 0.99."""
    m = np.asarray(matrix, float)
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    m = (vectors * np.maximum(values, 1e-10)) @ vectors.T
    d = np.sqrt(np.maximum(np.diag(m), 1e-12))
    m = np.clip(m / np.outer(d, d), -0.99, 0.99)
    np.fill_diagonal(m, 1)
    return (m + m.T) / 2


def equal_correlation(sources: int, rho: float) -> np.ndarray:
    rho = float(np.clip(rho, -0.99, 0.99)) if np.isfinite(rho) else 0.0
    return proper_correlation(np.where(np.eye(sources) > 0, 1.0, rho))


def inverses(correlation: np.ndarray) -> list[float]:
    """For each mask the inverse of its block, zeros elsewhere: all in one list, mask by mask, row by row."""
    k = len(correlation)
    if k > MOST_SOURCES:
        raise ValueError(f"{k} sources; the inverses of all subsets are kept for {MOST_SOURCES} at most")
    out = np.zeros((1 << k, k, k))
    for mask in range(1, 1 << k):
        on = [i for i in range(k) if mask >> i & 1]
        out[(mask, *np.ix_(on, on))] = np.linalg.inv(proper_correlation(correlation[np.ix_(on, on)]))
    return out.ravel().tolist()


def mean_correlations(correlation: np.ndarray) -> list[float]:
    """For each mask the mean absolute correlation of its pairs, 0 for fewer than two."""
    k, out = len(correlation), []
    for mask in range(1 << k):
        on = [i for i in range(k) if mask >> i & 1]
        block = np.abs(proper_correlation(correlation[np.ix_(on, on)]))[np.triu_indices(len(on), 1)] if on else np.zeros(0)
        out.append(float(block.mean()) if block.size else 0.0)
    return out


def mask_of(there: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(t, 1 << i).otherwise(0) for i, t in enumerate(there)))


def raw_weights(u: Column, mask: Column, inverse: list[float], k: int) -> Column:
    """The weights before scaling: an array of ``k``, zeros outside of the mask. ``u``: an array without nulls."""
    at, places = F.lit(inverse), F.lit(list(range(k)))
    return F.transform(places, lambda i: F.get(u, i) * F.aggregate(places, F.lit(0.0), lambda a, j: a + F.get(at, mask * k * k + i * k + j) * F.get(u, j)))


def nonnegative(df: DataFrame, u: str, mask: str, correlation: np.ndarray) -> DataFrame:
    """``df`` with ``__w``: least-variance weights of sum 1, none below 0, by an active set.

    While a weight of the sources at hand is negative, the source of the most negative one (the first of
    equal ones) leaves; so at most k - 1 leave, each by a step in the same plan.
    """
    k, inverse = len(correlation), inverses(correlation)
    out = df.withColumn("__m", F.col(mask))
    for step in range(k):
        out = out.withColumn("__r", raw_weights(F.col(u), F.col("__m"), inverse, k)).withColumn("__w", F.transform("__r", lambda w: F.try_divide(w, total(F.col("__r")))))
        if step < k - 1:
            lowest = F.array_min("__w")
            out = out.withColumn("__m", F.when(lowest < -1e-12, F.col("__m") - F.pow(F.lit(2), F.array_position("__w", lowest) - 1).cast("int")).otherwise(F.col("__m")))
    clipped = F.transform("__w", lambda w: F.greatest(w, F.lit(0.0)))
    return out.withColumn("__w", clipped).withColumn("__w", F.transform("__w", lambda w: F.try_divide(w, total(F.col("__w"))))).drop("__m", "__r")


def residual_correlation(residuals: DataFrame, sources: list[str], shrinkage: float = 0.2) -> np.ndarray:
    """The correlation matrix of (source, at, residual), shrunk to the identity.

    Two sources are compared over their common tail: the last residual with the last and so on, by ``at``
    (distinct within a source), as far as the shorter one goes; fewer than 3 count as uncorrelated. One
    pivot by the place from the end and one row of sums; what isn't finite is left out.
    """
    known = residuals.where(F.abs("residual") < float("inf")).select("source", "at", F.col("residual").cast("double").alias("residual")).withColumn("one", F.lit(1))
    placed = cut(cumulative(known, ["source"], "at", {"place": "one"}))
    ends = placed.groupBy("source").agg(F.max("place").alias("n"))
    wide = placed.join(F.broadcast(ends), "source").groupBy((F.col("n") - F.col("place")).alias("back")).pivot("source", sources).agg(F.first("residual"))  # a row for each source
    pairs = [(i, j) for i in range(len(sources)) for j in range(i)]
    raw = np.eye(len(sources))
    if pairs:
        sums = wide.agg(*(f(F.col(f"`{sources[i]}`"), F.col(f"`{sources[j]}`")).alias(f"{name}{i}_{j}") for i, j in pairs for name, f in (("n", F.regr_count), ("xy", F.regr_sxy), ("xx", F.regr_sxx), ("yy", F.regr_syy)))).first()
        for i, j in pairs:
            raw[i, j] = raw[j, i] = _correlation(*(sums[f"{name}{i}_{j}"] for name in ("n", "xy", "xx", "yy")), least=3)
    lam = min(max(shrinkage, 0.0), 1.0)
    return proper_correlation((1 - lam) * raw + lam * np.eye(len(sources)))


def _correlation(n: int, xy: float | None, xx: float | None, yy: float | None, least: int) -> float:
    spread = np.sqrt((xx or 0) * (yy or 0))
    return float(np.clip((xy or 0) / spread, -0.99, 0.99)) if n >= least and spread > 1e-12 else 0.0


def fuse(estimates: DataFrame, reliability: dict[str, float], correlation: np.ndarray, tau: float = 1.0, drift_decay: float = 1.0, min_std: float = 1e-6, constrained: bool = True) -> DataFrame:
    """(entity, mean, std, n_eff, weights) of (entity, source, value, std, drift): one row for each entity.

    ``reliability`` has the mean of each source, in the order of ``correlation``. A variance is
    max(std, min_std)^2 / max(reliability^tau exp(-drift_decay drift), 1e-6). What isn't finite, has no
    positive std or another source is left out, and an entity without any estimate has no row; of several
    estimates of one source the one of least std counts, then of least value. Missing drift is 0. One
    pivot by entity; a source's rows are never gathered.
    """
    sources, k = list(reliability), len(reliability)
    e = estimates.where((F.abs("value") < float("inf")) & (F.col("std") > 0) & (F.col("std") < float("inf")) & F.col("source").isin(sources))
    drift = F.greatest(F.coalesce(F.when(F.abs("drift") < float("inf"), F.col("drift")), F.lit(0.0)), F.lit(0.0))
    rel = F.try_element_at(F.create_map(*(F.lit(x) for s in sources for x in (s, max(reliability[s], 1e-6) ** tau))), F.col("source"))
    factor = F.greatest(rel * F.exp(-max(drift_decay, 0.0) * drift), F.lit(1e-6))
    e = e.select("entity", "source", F.struct("std", "value", (F.greatest(F.col("std"), F.lit(min_std)) / F.sqrt(factor)).alias("s")).alias("e"))
    wide = e.groupBy("entity").pivot("source", sources).agg(F.min("e"))
    each = [F.col(f"`{s}`") for s in sources]
    wide = wide.select("entity", mask_of([c.isNotNull() for c in each]).alias("__mask"), F.array(*(F.coalesce(c["value"], F.lit(0.0)) for c in each)).alias("__v"), F.array(*(F.when(c.isNotNull(), 1 / c["s"]).otherwise(0.0) for c in each)).alias("__u"))
    if constrained:
        wide = nonnegative(wide, "__u", "__mask", correlation)
    else:
        wide = wide.withColumn("__w", raw_weights(F.col("__u"), F.col("__mask"), inverses(correlation), k)).withColumn("__w", F.transform("__w", lambda w: w / total(F.col("__w"))))
    there = lambda i: F.get("__u", i) > 0
    places, r = F.lit(list(range(k))), F.lit(proper_correlation(correlation).ravel().tolist())
    scaled = F.transform(places, lambda i: F.when(there(i), F.get("__w", i) / F.get("__u", i)).otherwise(0.0))
    wide = wide.withColumn("__x", scaled)
    variance = total(F.transform(places, lambda i: F.get("__x", i) * F.aggregate(places, F.lit(0.0), lambda a, j: a + F.get(r, i * k + j) * F.get("__x", j))))
    weights = F.map_filter(F.map_from_arrays(F.lit(sources), F.col("__w")), lambda s, w: F.array_contains(F.filter(F.transform(places, lambda i: F.when(there(i), F.get(F.lit(sources), i))), lambda x: x.isNotNull()), s))
    ones = total(F.col("__w"))
    return wide.select("entity", total(F.zip_with("__w", "__v", lambda w, v: w * v)).alias("mean"), F.sqrt(F.greatest(variance, F.lit(1e-18))).alias("std"), (ones * ones / total(F.transform("__w", lambda w: w * w))).alias("n_eff"), weights.alias("weights"))
