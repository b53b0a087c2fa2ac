"""Topology inference: channel reliability, correlation-aware pooling, calibration, intervals, relabelling.

Fits are small: ``fit_channels`` is one row of sums, ``fit_temperature`` one table of sums by fold and
temperature. What is inferred with them is columns of each row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.numeric import clip, finite, sigmoid, total
from ferrolith.operators import gls
from ferrolith.operators.fusion import temperatures

CHANNELS = ("si", "spillage", "ml")
#: Classes that count as topological.
POSITIVE = ("TI", "TSM", "TCI", "WEYL", "DIRAC", "LINENODE", "MAGNETIC_TI")
WEIGHTS = (0.45, 0.35, 0.20)


def truth(column: str, df: DataFrame) -> Column:
    """The label as 0 to 1: numbers clipped, a topological class 1, TRIVIAL 0, anything else null."""
    c = F.col(column)
    if df.schema[column].dataType.simpleString() == "string":
        return F.when(F.upper(c).isin(*POSITIVE), 1.0).when(F.upper(c) == "TRIVIAL", 0.0)
    number = finite(c.cast("double"))
    return F.when(number.isNotNull(), clip(number, 0, 1))  # clip() makes a value of a null


def channel_columns(df: DataFrame, si_center: float = 0.0, si_temperature: float = 0.35, spillage_threshold: float = 0.5, spillage_temperature: float = 0.10, ml_uncertainty_scale: float = 1.5) -> DataFrame:
    """``df`` with p_ and c_ (chance and confidence, null where it says nothing) of each channel."""
    number = lambda c: finite(F.col(c).cast("double")) if c in df.columns else F.lit(None).cast("double")
    si, sp, ml, wide = number("si_score"), number("spillage"), number("ml_probability"), number("ml_uncertainty")
    unsure = F.greatest(F.coalesce(wide, F.lit(0.5)), F.lit(0.0))
    ps = {"si": sigmoid((si - si_center) / max(si_temperature, 1e-8)), "spillage": sigmoid((sp - spillage_threshold) / max(spillage_temperature, 1e-8)), "ml": clip(ml, 0, 1)}
    cs = {"si": F.lit(1.0), "spillage": F.lit(1.0), "ml": clip(1 / (1 + max(ml_uncertainty_scale, 1e-8) * unsure), 0.05, 1)}
    known = {"si": si, "spillage": sp, "ml": ml}  # greatest() would make a value of a null
    return df.withColumns({f"p_{c}": F.when(known[c].isNotNull(), ps[c]) for c in CHANNELS} | {f"c_{c}": F.when(known[c].isNotNull(), cs[c]) for c in CHANNELS})


class Channels(NamedTuple):
    """Beta counts by channel, and the correlation of the channels' errors."""

    counts: dict[str, tuple[float, float]]
    correlation: np.ndarray

    def reliability(self) -> dict[str, float]:
        return {c: a / (a + b) for c, (a, b) in self.counts.items()}


UNFITTED = Channels(dict.fromkeys(CHANNELS, (2.0, 2.0)), np.eye(len(CHANNELS)))


def fit_channels(df: DataFrame, label: str, before: Channels = UNFITTED, min_samples: int = 8, shrinkage: float = 0.25) -> Channels:
    """Reliability and correlation from (p_ columns, ``label`` 0 to 1 or null): one aggregate, one row.

    An error |p - label| adds to beta and the rest to alpha; channels with fewer than ``min_samples``
    labelled rows stay as they were and are uncorrelated, as are pairs with fewer. Correlations of errors
    are shrunk to the identity.
    """
    error = {c: F.col(f"p_{c}") - F.col(label) for c in CHANNELS}
    pairs = [(i, j) for j in range(len(CHANNELS)) for i in range(j)]
    sums = [f(e).alias(f"{n}_{c}") for c, e in error.items() for n, f in (("n", F.count), ("e", lambda e: F.sum(F.abs(e))))]
    sums += [f(error[CHANNELS[i]], error[CHANNELS[j]]).alias(f"{n}{i}{j}") for i, j in pairs for n, f in (("n", F.regr_count), ("xy", F.regr_sxy), ("xx", F.regr_sxx), ("yy", F.regr_syy))]
    got = df.agg(*sums).first()
    enough = [got[f"n_{c}"] >= min_samples for c in CHANNELS]
    counts = {c: ((a + got[f"n_{c}"] - got[f"e_{c}"], b + got[f"e_{c}"]) if ok else (a, b)) for ok, (c, (a, b)) in zip(enough, before.counts.items(), strict=True)}
    raw = np.eye(len(CHANNELS))
    for i, j in pairs:
        spread = math.sqrt((got[f"xx{i}{j}"] or 0) * (got[f"yy{i}{j}"] or 0))
        if enough[i] and enough[j] and got[f"n{i}{j}"] >= min_samples and spread > 1e-12:
            raw[i, j] = raw[j, i] = got[f"xy{i}{j}"] / spread
    lam = min(max(shrinkage, 0.0), 1.0)
    return Channels(counts, gls.proper_correlation((1 - lam) * raw + lam * np.eye(len(CHANNELS))))


def pooled(df: DataFrame, channels: Channels, label: str | None = None, base_weights: tuple = WEIGHTS, strength: float = 24.0, penalty: float = 1.0, correlated: bool = True, nonnegative: bool = True, override: dict[str, float] | None = None) -> DataFrame:
    """``df`` with ``probability`` and ``n_eff``: log-odds pooled by generalized least squares over the channels that are there.

    A channel's precision is its base weight times its reliability times its confidence. Negative weights
    become 0. A row without channels has its label's chance, or a half, and half the ``strength``.
    """
    base = np.clip(base_weights, 0, None)
    base = base / base.sum() if base.sum() > 0 else np.array(WEIGHTS)
    rel = channels.reliability() | {c: min(max(float(r), 1e-6), 1.0) for c, r in (override or {}).items() if c in CHANNELS}
    corr = channels.correlation if correlated else np.eye(len(CHANNELS))
    k, places = len(CHANNELS), F.lit(list(range(len(CHANNELS))))
    there = [F.col(f"p_{c}").isNotNull() for c in CHANNELS]
    info = [F.when(t, F.greatest(float(base[i]) * max(rel[c], 1e-6) * clip(F.col(f"c_{c}"), 0.05, 1), F.lit(1e-6))).otherwise(0.0) for i, (c, t) in enumerate(zip(CHANNELS, there, strict=True))]
    logits = [F.when(t, F.ln(clip(F.col(f"p_{c}"), 1e-9, 1 - 1e-9)) - F.ln(1 - clip(F.col(f"p_{c}"), 1e-9, 1 - 1e-9))).otherwise(0.0) for c, t in zip(CHANNELS, there, strict=True)]
    out = df.withColumns({"__mask": gls.mask_of(there), "__i": F.array(*info), "__l": F.array(*logits)})
    out = out.withColumn("__w", gls.raw_weights(F.transform("__i", F.sqrt), F.col("__mask"), gls.inverses(corr), k))
    if nonnegative:
        out = out.withColumn("__w", F.transform("__w", lambda w: F.greatest(w, F.lit(0.0))))
        even = F.transform(places, lambda i: F.when(F.get("__i", i) > 0, 1.0).otherwise(0.0))
        out = out.withColumn("__w", F.when(total(F.col("__w")) > 0, F.col("__w")).otherwise(even))
    m = F.bit_count(F.col("__mask"))
    mean = total(F.zip_with("__w", "__l", lambda w, x: w * x)) / total(F.col("__w"))
    spare = clip(F.coalesce(F.col(label), F.lit(0.5)), 0, 1) if label else F.lit(0.5)
    some = F.col("__mask") > 0
    inflation = 1 + penalty * F.get(F.lit(gls.mean_correlations(corr)), F.col("__mask")) * (m - 1)
    p = F.when(some, sigmoid(mean)).otherwise(spare)
    n = F.when(some, F.greatest(strength * total(F.col("__i")) / F.greatest(inflation, F.lit(1e-6)), F.lit(1.0))).otherwise(max(0.5 * strength, 1.0))
    return out.withColumns({"probability": p, "n_eff": n}).drop("__mask", "__i", "__l", "__w")


def fold_of(key: str, folds: int, seed: int = 0) -> Column:
    """Which fold a row is in: a hash of its key, so that reruns and other layouts agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") % folds


def _nll_sums(batches: Iterator[pd.DataFrame], grid: np.ndarray, folds: int) -> Iterator[pd.DataFrame]:
    sums, n = np.zeros((folds, len(grid))), np.zeros(folds, int)
    for b in batches:
        z = np.log(b.p.to_numpy()) - np.log(1 - b.p.to_numpy())
        y = b.y.to_numpy()
        for i, t in enumerate(grid):
            q = np.clip(1 / (1 + np.exp(-np.clip(z / t, -50, 50))), 1e-9, 1 - 1e-9)
            sums[:, i] += np.bincount(b.fold, -(y * np.log(q) + (1 - y) * np.log(1 - q)), folds)
        n += np.bincount(b.fold, minlength=folds)
    yield pd.DataFrame({"fold": np.repeat(np.arange(folds), len(grid)), "t": np.tile(np.arange(len(grid)), folds), "nll": sums.ravel(), "n": np.repeat(n, len(grid))})


class Temperature(NamedTuple):
    whole: float  # fitted on all labelled rows
    of_fold: list[float | None]  # on all but the fold's own; None for an empty fold, or where too few are left
    n: int


def fit_temperature(df: DataFrame, p: str, label: str, key: str, folds: int = 3, seed: int = 0, min_samples: int = 12, low: float = 0.25, high: float = 8.0, steps: int = 161) -> Temperature:
    """The temperatures of least negative log-likelihood, of all labelled rows and of all but each fold: one pass.

    A task sends a sum for each fold and temperature, so that the fit without a fold is the sum without
    its sums. Equal ones: the lowest. Fewer labels than ``min_samples``: 1 and no folds.
    """
    grid = np.array(temperatures(steps, low, high))
    rows = df.where(F.col(label).isNotNull()).select(clip(F.col(p), 1e-9, 1 - 1e-9).alias("p"), F.col(label).cast("double").alias("y"), fold_of(key, folds, seed).cast("int").alias("fold"))
    sums = rows.mapInPandas(lambda it: _nll_sums(it, grid, folds), "fold int, t int, nll double, n long").groupBy("fold", "t").agg(F.sum("nll").alias("nll"), F.sum("n").alias("n")).collect()
    nll, n = np.zeros((folds, len(grid))), np.zeros(folds, int)
    for r in sums:
        nll[r.fold, r.t], n[r.fold] = r.nll, r.n
    if n.sum() < min_samples:
        return Temperature(1.0, [None] * folds, int(n.sum()))

    def least(values: np.ndarray, count: int) -> float:
        found, at = math.inf, 1.0
        for t, v in zip(grid, values / max(count, 1), strict=True):
            if v + 1e-12 < found:
                found, at = v, float(t)
        return at

    own = [least(nll.sum(axis=0) - nll[f], n.sum() - n[f]) if n[f] and n.sum() - n[f] >= max(2, min_samples) else None for f in range(folds)]
    return Temperature(least(nll.sum(axis=0), n.sum()), own, int(n.sum()))


def scaled(p: Column, temperature: Column) -> Column:
    q = clip(p, 1e-9, 1 - 1e-9)
    return clip(sigmoid((F.ln(q) - F.ln(1 - q)) / F.greatest(temperature, F.lit(1e-9))), 1e-9, 1 - 1e-9)


def calibration_sums(ps: dict[str, Column], y: Column, bins: int = 10) -> list[Column]:
    """Aggregates <name>_ece, _brier, _nll of each chance in ``ps`` against ``y``; rows where either is null don't count."""
    out = []
    for name, p in ps.items():
        q = clip(F.when(y.isNotNull() & p.isNotNull(), p), 1e-9, 1 - 1e-9)
        q = F.when(y.isNotNull() & p.isNotNull(), q)
        at = F.least(F.floor(q * bins), F.lit(bins - 1))
        gaps = [F.abs(F.coalesce(F.sum(F.when(at == b, q - y)), F.lit(0.0))) for b in range(bins)]
        n = F.count(q)
        out += [n.alias(f"{name}_n"), F.try_divide(reduce(lambda a, b: a + b, gaps), n).alias(f"{name}_ece"), F.avg((q - y) * (q - y)).alias(f"{name}_brier"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias(f"{name}_nll")]
    return out


def diagnose(df: DataFrame, p: str, label: str, key: str, fitted: Temperature, seed: int = 0, bins: int = 10) -> DataFrame:
    """One row: the metrics before, after (each fold by the temperature of the others, or all by the whole one) and the temperatures."""
    own = [t for t in fitted.of_fold if t is not None]
    cross = bool(own) and fitted.n >= 4
    of = F.get(F.lit([float("nan") if t is None else t for t in fitted.of_fold]), fold_of(key, len(fitted.of_fold), seed).cast("int"))
    after = F.when(~F.isnan(of), scaled(F.col(p), of)) if cross else scaled(F.col(p), F.lit(fitted.whole))
    said = {"eval_scheme": F.lit("cross_fit" if cross else "in_sample"), "temperature": F.lit(fitted.whole), "temperature_cv_mean": F.lit(float(np.mean(own)) if own else fitted.whole), "temperature_cv_std": F.lit(float(np.std(own)) if own else 0.0), "folds_used": F.lit(len(own))}
    return df.agg(*calibration_sums({"before": F.col(p), "after": after}, F.col(label).cast("double"), bins)).withColumns(said)


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y) for x, y in zip(a, b, strict=True)])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, log_beta: np.ndarray) -> np.ndarray:
    """The regularized incomplete beta function of whole arrays, by its continued fraction."""
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (x > 0) & (x < 1)
    x = np.where(inside, x, 0.5)
    lead = np.exp(a * np.log(x) + b * np.log1p(-x) - log_beta) / a
    c, d = np.ones_like(x), 1 / (1 - (a + b) * x / (a + 1))
    value = d.copy()
    for m in range(1, 300):
        even, odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for k in (even, odd):
            d, c = 1 / (1 + k * d), 1 + k / c
            value *= c * d
        if np.abs(c * d - 1).max(initial=0) < 1e-13:
            break
    out = np.where(inside, lead * value, 0.0)
    return np.where(swap, 1 - out, out)


def beta_quantiles(a: np.ndarray, b: np.ndarray, q: float, steps: int = 60) -> np.ndarray:
    """By bisection of whole arrays."""
    low, high, log_beta = np.zeros_like(a), np.ones_like(a), _log_beta(a, b)
    for _ in range(steps):
        middle = (low + high) / 2
        below = incomplete_beta(a, b, middle, log_beta) < q
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def interval(alpha: Column, beta: Column, z: float = 1.96, level: float | None = None, exact: bool = True) -> tuple[Column, Column]:
    """(low, high) of a Beta posterior: exact quantiles in Arrow batches, or the normal approximation."""
    level = min(max(math.erf(z / math.sqrt(2)) if level is None else level, 1e-6), 1 - 1e-6)
    if not exact:
        s = alpha + beta
        half = z * F.sqrt(F.greatest(alpha * beta / F.greatest(s * s * (s + 1), F.lit(1e-12)), F.lit(1e-18)))
        return clip(alpha / s - half, 0, 1), clip(alpha / s + half, 0, 1)

    @F.pandas_udf("low double, high double")
    def both(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        a, b = a.to_numpy(float), b.to_numpy(float)
        return pd.DataFrame({"low": beta_quantiles(a, b, (1 - level) / 2), "high": beta_quantiles(a, b, (1 + level) / 2)})

    made = both(alpha, beta)
    return made["low"], made["high"]


def relabelled(p: Column, gap: Column, threshold: float = 0.55, semimetal_gap: float = 0.05) -> Column:
    """TSM or TI by the gap (missing: 0) from the threshold on, else TRIVIAL."""
    return F.when(p >= threshold, F.when(F.coalesce(finite(gap), F.lit(0.0)) <= semimetal_gap, "TSM").otherwise("TI")).otherwise("TRIVIAL")


def infer(df: DataFrame, channels: Channels, label: str | None = None, temperature: float | None = None, prior: tuple[float, float] = (1.0, 1.0), exact: bool = True, z: float = 1.96, level: float | None = None, relabel: bool = False, gap: str = "band_gap", **how) -> DataFrame:
    """``df`` (with channel columns) with topological_probability, topology_ci_low and _high, n_eff, and topo_class if asked to relabel.

    ``temperature`` scales the pooled log-odds. Rows without evidence are told by their label or the prior
    alone. An empty table stays empty.
    """
    out = pooled(df, channels, label, **how)
    if temperature is not None:
        out = out.withColumn("probability", scaled(F.col("probability"), F.lit(float(temperature))))
    alpha, beta = prior[0] + F.col("probability") * F.col("n_eff"), prior[1] + (1 - F.col("probability")) * F.col("n_eff")
    low, high = interval(alpha, beta, z, level, exact)
    out = out.withColumns({"topology_ci_low": low, "topology_ci_high": high}).withColumnRenamed("probability", "topological_probability")
    return out.withColumn("topo_class", relabelled(F.col("topological_probability"), F.col(gap))) if relabel else out


def ood_score(similarity: Column, scale: float = 0.35) -> Column:
    """How far from the nearest reference (its cosine; missing: 0): a sigmoid around a distance of ``scale``."""
    far = clip(1 - F.coalesce(similarity, F.lit(0.0)), 0, 1)
    return clip(sigmoid((far - max(scale, 1e-6)) / max(scale, 1e-6)), 0, 1)
