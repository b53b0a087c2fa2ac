"""Fusing noisy evidence: gap methods, class chances, source reliability, calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.functions import chem
from ferrolith.functions.numeric import clip, let, normal_cdf, sigmoid, total

CLASSES = ("metal", "semimetal", "semiconductor", "insulator")
CUTS = (0.01, 0.5, 3.0)


def precision_fusion(values: list[Column], sigmas: list[Column], correlation: float = 0.25) -> tuple[Column, Column, Column]:
    """(mean, sigma, count) of measurements with equal correlation, missing ones left out.

    With u = 1 / sigma, m the count and c = rho / (1 - rho + m rho), generalized least squares has
    the closed form S1 = (sum u^2 - c (sum u)^2) / (1 - rho), Sy likewise, mean Sy / S1, sigma S1^-1/2.
    """
    there = [(v.isNotNull() & s.isNotNull(), v, s) for v, s in zip(values, sigmas, strict=True)]
    add = lambda make: reduce(lambda a, b: a + b, (F.when(ok, make(v, 1 / s)).otherwise(0.0) for ok, v, s in there))
    m = add(lambda v, u: F.lit(1.0))
    c = correlation / (1 - correlation + m * correlation)
    u1, u2, uy, uuy = add(lambda v, u: u), add(lambda v, u: u * u), add(lambda v, u: u * v), add(lambda v, u: u * u * v)
    s1, sy = (u2 - c * u1 * u1) / (1 - correlation), (uuy - c * u1 * uy) / (1 - correlation)
    known = m > 0
    return F.when(known, F.try_divide(sy, s1)), F.when(known, F.sqrt(F.try_divide(F.lit(1.0), s1))), m


def disagreement(values: list[Column], mean: Column) -> Column:
    """The population spread of the present values around the fused mean."""
    m = reduce(lambda a, b: a + b, (v.isNotNull().cast("double") for v in values))
    square = reduce(lambda a, b: a + b, (F.coalesce(F.pow(v - mean, F.lit(2)), F.lit(0.0)) for v in values))
    return F.when(m > 0, F.sqrt(F.try_divide(square, m)))


def gap_columns(df: DataFrame, sigmas: tuple = (0.12, 0.20, 0.35), slope: float = 0.35, correlation: float = 0.25) -> DataFrame:
    """bandgap_best, bandgap_fused, bandgap_fused_std and bandgap_method_count from three gap columns and a formula.

    All that is fused is one struct whose inputs are named once, so that filters on what follows stay small.
    """
    names = ("hse_gap", "mbj_bandgap", "optb88vdw_bandgap")
    best = F.coalesce(*map(F.col, names))
    scale = 1 + slope * chem.complexity(chem.parse_formula(F.col("formula")))

    def fused(r: Column) -> Column:
        values = [r[n] for n in names]
        mean, sigma, m = precision_fusion(values, [F.lit(s) * r["k"] for s in sigmas], correlation)
        wide = lambda f: F.sqrt(f["sigma"] * f["sigma"] + F.pow(disagreement(values, f["mean"]), F.lit(2)))
        return let(F.struct(mean.alias("mean"), sigma.alias("sigma"), m.alias("m")), lambda f: F.struct(f["mean"].alias("mean"), wide(f).alias("std"), f["m"].alias("m")))

    out = df.withColumns({"bandgap_best": F.when(best >= 0, best), "__fused": let(F.struct(*names, scale.alias("k")), fused)})
    return out.withColumns({"bandgap_fused": F.col("__fused.mean"), "bandgap_fused_std": F.col("__fused.std"), "bandgap_method_count": F.col("__fused.m")}).drop("__fused")


def class_columns(df: DataFrame, temperature: float = 1.0, default_sigma: float = 0.35) -> DataFrame:
    """Chances of the four conductivity classes, their entropy over ln 4, the confidence and the class.

    Each step names the one before it once, so that a filter on the class, which the optimizer moves below
    these columns, stays of bounded size.
    """
    mu = F.coalesce("bandgap_fused", "bandgap_best")
    sigma = F.greatest(F.coalesce(F.col("bandgap_fused_std"), F.lit(default_sigma)) * temperature, F.lit(1e-8))
    at = lambda f, i: F.get(f, F.lit(i))
    below = lambda v: F.array(*(normal_cdf((c - v["m"]) / v["s"]) for c in CUTS))
    between = lambda f: F.array(clip(at(f, 0), 0, 1), clip(at(f, 1) - at(f, 0), 0, 1), clip(at(f, 2) - at(f, 1), 0, 1), clip(1 - at(f, 2), 0, 1))
    shares = lambda p: F.transform(p, lambda x: F.try_divide(x, total(p)))
    chances = let(F.struct(mu.alias("m"), sigma.alias("s")), lambda v: let(below(v), lambda f: let(between(f), shares)))
    out = df.withColumns({"__k": mu.isNotNull(), "__p": chances})
    known, ps = F.col("__k"), F.col("__p")
    entropy = total(F.transform(ps, lambda p: F.when(p > 0, -p * F.ln(F.greatest(p, F.lit(1e-12)))).otherwise(0.0))) / math.log(4)
    label = let(ps, lambda p: F.get(F.array(*map(F.lit, CLASSES)), F.array_position(p, F.array_max(p)).cast("int") - 1))  # the first of equal chances wins
    made = {f"p_{c}": F.when(known, at(ps, i)) for i, c in enumerate(CLASSES)}
    made |= {"conductivity_confidence": F.when(known, F.array_max(ps)), "conductivity_entropy": F.when(known, entropy), "conductivity_class": F.when(known, label).otherwise("unknown")}
    return out.withColumns(made).drop("__k", "__p")


def evidence_channels(df: DataFrame) -> DataFrame:
    """(key columns, channel, p, confidence) of the symmetry, spillage and model channels that are present."""
    rows = F.array(
        F.struct(F.lit("si").alias("channel"), sigmoid(F.col("si_score")).alias("p"), F.lit(0.8).alias("confidence")),
        F.struct(F.lit("spillage").alias("channel"), sigmoid((F.col("spillage") - 0.5) / 0.1).alias("p"), F.lit(0.9).alias("confidence")),
        F.struct(F.lit("ml").alias("channel"), F.col("ml_probability").alias("p"), clip(1 - F.coalesce("ml_uncertainty", F.lit(0.25)), 0.05, 1).alias("confidence")),
    )
    return df.select("jid", F.explode(rows).alias("e")).select("jid", "e.*").where("p is not null")


def pool_logits(channels: DataFrame, reliability: dict[str, tuple[float, float]], correlation: float = 0.3) -> DataFrame:
    """(jid, probability, n_eff): reliability-weighted log-odds, with an effective number of channels.

    ``reliability`` has Beta counts (alpha, beta) by channel.
    """
    r = F.create_map(*(F.lit(x) for k, (a, b) in reliability.items() for x in (k, a / (a + b))))
    weighted = channels.withColumn("w", F.col("confidence") * F.coalesce(F.try_element_at(r, F.col("channel")), F.lit(0.5))).withColumn("l", F.ln(clip(F.col("p"), 1e-6, 1 - 1e-6) / (1 - clip(F.col("p"), 1e-6, 1 - 1e-6))))
    pooled = weighted.groupBy("jid").agg(F.sum(F.col("w") * F.col("l")).alias("wl"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("ww"))
    n_eff = F.col("w") * F.col("w") / F.col("ww") / (1 + correlation * (F.col("w") * F.col("w") / F.col("ww") - 1))
    return pooled.select("jid", sigmoid(F.col("wl") / F.col("w")).alias("probability"), n_eff.alias("n_eff"))


def update_reliability(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Beta counts (channel, alpha, beta) after (channel, p, label): error |p - label| adds to beta, the rest to alpha."""
    e = F.abs(F.col("p") - F.col("label"))
    new = outcomes.groupBy("channel").agg(F.sum(1 - e).alias("da"), F.sum(e).alias("db"))
    return state.join(new, "channel", "full").select("channel", (F.coalesce("alpha", F.lit(1.0)) + F.coalesce("da", F.lit(0.0))).alias("alpha"), (F.coalesce("beta", F.lit(1.0)) + F.coalesce("db", F.lit(0.0))).alias("beta"))


def source_scores(sources: DataFrame, decay: float = 1.0) -> DataFrame:
    """Coverage (full 1, partial 0.6, none 0.2) * alpha / (alpha + beta) * exp(-decay * drift), ranked."""
    coverage = F.when(F.col("coverage") == "full", 1.0).when(F.col("coverage") == "partial", 0.6).otherwise(0.2)
    scored = sources.withColumn("score", coverage * F.col("alpha") / (F.col("alpha") + F.col("beta")) * F.exp(-decay * F.col("drift_distance")))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "source_key")))


def gls_fusion(estimates: DataFrame, correlation: float = 0.3) -> DataFrame:
    """(entity, mean, std, n_eff) of (entity, value, std, reliability), by equal-correlation least squares.

    Sums over an entity's sources are enough, so no group is gathered.
    """
    s = F.greatest(F.col("std"), F.lit(1e-8)) / F.sqrt(clip(F.col("reliability"), 1e-6, 1))
    u = estimates.withColumn("u", 1 / s)
    t = u.groupBy("entity").agg(F.count("*").alias("m"), F.sum("u").alias("u1"), F.sum(F.col("u") * F.col("u")).alias("u2"), F.sum(F.col("u") * F.col("value")).alias("uy"), F.sum(F.col("u") * F.col("u") * F.col("value")).alias("uuy"))
    c = correlation / (1 - correlation + F.col("m") * correlation)
    s1, sy = (F.col("u2") - c * F.col("u1") * F.col("u1")) / (1 - correlation), (F.col("uuy") - c * F.col("u1") * F.col("uy")) / (1 - correlation)
    return t.select("entity", (sy / s1).alias("mean"), F.sqrt(1 / s1).alias("std"), (F.col("u1") * F.col("u1") / F.col("u2")).alias("n_eff"))


def calibration(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """One row: n, ece (equal bins, the last closed), brier, nll."""
    q = clip(F.col(p), 1e-12, 1 - 1e-12)
    row = df.select(F.col(p).alias("p"), F.col(label).cast("double").alias("y"), F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin"), (-F.col(label) * F.ln(q) - (1 - F.col(label)) * F.ln(1 - q)).alias("nll"))
    binned = row.groupBy("bin").agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("b"), F.sum("nll").alias("nll"))
    n = F.sum("n")
    return binned.agg(n.alias("n"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / n).alias("ece"), (F.sum("b") / n).alias("brier"), (F.sum("nll") / n).alias("nll"))


def temperatures(n: int = 161, low: float = 0.25, high: float = 8.0) -> list[float]:
    return np.geomspace(low, high, n).tolist()


def fit_temperature(df: DataFrame, p: str, label: str, grid: list[float] | None = None) -> DataFrame:
    """One row (temperature, nll): the grid's best in mean negative log-likelihood, the lowest of equals."""
    grid = grid or temperatures()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # sums for all temperatures, a few rows a task
        t, total, n = np.array(grid), np.zeros(len(grid)), 0
        for b in batches:
            q = np.clip(b.p.to_numpy(float), 1e-6, 1 - 1e-6)
            z = np.log(q / (1 - q))[:, None] / t
            total += np.logaddexp(0, np.where(b.y.to_numpy()[:, None] == 1, -z, z)).sum(axis=0)
            n += len(b)
        yield pd.DataFrame({"temperature": t, "total": total, "n": n})

    sums = df.select(F.col(p).alias("p"), F.col(label).alias("y")).mapInPandas(run, "temperature double, total double, n long").groupBy("temperature").agg((F.sum("total") / F.sum("n")).alias("nll"))
    return sums.agg(F.min(F.struct("nll", "temperature")).alias("best")).select("best.temperature", "best.nll")


def conformal_scale(df: DataFrame, y: str, mean: str, std: str, level: float = 0.9, group: str | None = None, least: int = 16) -> DataFrame:
    """The quantile of |y - mean| / std, overall or by group; small groups get the overall one."""
    t = df.withColumn("t", F.abs(F.col(y) - F.col(mean)) / F.greatest(F.col(std), F.lit(1e-8)))
    whole = t.agg(F.percentile("t", F.lit(level)).alias("overall"))
    if group is None:
        return whole.select(F.col("overall").alias("scale"))
    by = t.groupBy(group).agg(F.count("*").alias("n"), F.percentile("t", F.lit(level)).alias("own"))
    return by.crossJoin(F.broadcast(whole)).select(group, "n", F.when(F.col("n") >= least, F.col("own")).otherwise(F.col("overall")).alias("scale"))  # one row


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    lead = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    d = c = 1.0
    d = 1 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for k in (even, odd):
            d, c = 1 / (1 + k * d), 1 + k / c
            value *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return lead * value


def beta_quantile(a: float, b: float, q: float, steps: int = 80) -> float:
    """By bisection."""
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if _incomplete_beta(a, b, middle) < q else (low, middle)
    return (low + high) / 2


def beta_interval(alpha: Column, beta: Column, level: float = 0.95, exact: bool = False) -> tuple[Column, Column]:
    """(low, high) of a Beta posterior: normal approximation in columns, or exact by an Arrow function."""
    if not exact:
        from statistics import NormalDist

        mean = alpha / (alpha + beta)
        half = NormalDist().inv_cdf((1 + level) / 2) * F.sqrt(mean * (1 - mean) / (alpha + beta + 1))
        return clip(mean - half, 0, 1), clip(mean + half, 0, 1)

    @F.pandas_udf("double")
    def at(a: pd.Series, b: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([beta_quantile(*row) for row in zip(a, b, q, strict=True)], dtype=float)

    return at(alpha, beta, F.lit((1 - level) / 2)), at(alpha, beta, F.lit((1 + level) / 2))
