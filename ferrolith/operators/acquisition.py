"""Acquisition functions and selection utilities as columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.numeric import clip, log_normal_cdf, normal_cdf, normal_pdf

#: Names that mean the same function.
ALIASES = {
    "ei": "ei", "expected_improvement": "ei", "log_ei": "log_ei", "logei": "log_ei", "pi": "pi", "probability_of_improvement": "pi", "log_pi": "log_pi", "logpi": "log_pi",
    "ucb": "ucb", "upper_confidence_bound": "ucb", "lcb": "lcb", "lower_confidence_bound": "lcb", "mean": "mean", "exploit": "mean", "uncertainty": "uncertainty", "std": "uncertainty",
    "thompson": "thompson", "thompson_sampling": "thompson", "nei": "nei", "noisy_ei": "nei",
}


def _z(mean: Column, std: Column, best: Column | float, maximize: bool, jitter: float, floor: float) -> tuple[Column, Column]:
    s = F.greatest(std, F.lit(floor))
    delta = (mean - best if maximize else best - mean) - jitter
    return delta / s, s


def expected_improvement(mean: Column, std: Column, best: Column | float, maximize: bool = True, jitter: float = 0.0, floor: float = 1e-9) -> Column:
    z, s = _z(mean, std, best, maximize, jitter, floor)
    return F.greatest(s * (z * normal_cdf(z) + normal_pdf(z)), F.lit(0.0))


def log_expected_improvement(mean: Column, std: Column, best: Column | float, maximize: bool = True, jitter: float = 0.0, floor: float = 1e-9) -> Column:
    """Below z = -5 by the tail phi(z) / z^2, so that it stays finite."""
    z, s = _z(mean, std, best, maximize, jitter, floor)
    tail = -0.5 * z * z - 0.5 * math.log(2 * math.pi) - 2 * F.ln(F.greatest(-z, F.lit(1.0)))
    near = F.ln(F.greatest(z * normal_cdf(z) + normal_pdf(z), F.lit(1e-300)))
    return F.ln(s) + F.when(z < -5, tail).otherwise(near)


def probability_of_improvement(mean: Column, std: Column, best: Column | float, maximize: bool = True, jitter: float = 0.0, floor: float = 1e-9) -> Column:
    return normal_cdf(_z(mean, std, best, maximize, jitter, floor)[0])


def log_probability_of_improvement(mean: Column, std: Column, best: Column | float, maximize: bool = True, jitter: float = 0.0, floor: float = 1e-9) -> Column:
    return log_normal_cdf(_z(mean, std, best, maximize, jitter, floor)[0])


def noisy_expected_improvement(mean: Column, std: Column, observed_mean: Column, observed_std: Column, maximize: bool = True, samples: int = 512, seed: int = 0) -> Column:
    """EI against a random incumbent: antithetic draws of the observed values, the best of each draw."""
    draws = np.random.default_rng(seed).standard_normal((samples // 2, 4096))

    @F.pandas_udf("double")
    def run(m: pd.Series, s: pd.Series, om: pd.Series, os: pd.Series) -> pd.Series:
        out = []
        for a, b, c, d in zip(m, s, om, os, strict=True):
            c, d = np.asarray(c, float), np.asarray(d, float)
            noise = draws[:, : len(c)] if len(c) <= draws.shape[1] else np.random.default_rng(seed).standard_normal((samples // 2, len(c)))
            seen = np.concatenate((c + noise * d, c - noise * d))
            best = seen.max(axis=1) if maximize else seen.min(axis=1)
            sigma = max(b, 1e-9)
            z = ((a - best) if maximize else (best - a)) / sigma
            phi = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
            cdf = 0.5 * (1 + np.array([math.erf(x / math.sqrt(2)) for x in z]))
            out.append(max(float((sigma * (z * cdf + phi)).mean()), 0.0))
        return pd.Series(out, dtype=float)

    return run(mean, std, observed_mean, observed_std)


def acquire(name: str, mean: Column, std: Column, best: Column | float = 0.0, maximize: bool = True, kappa: float = 2.0, seed: int = 0) -> Column:
    """By any of ALIASES."""
    kind = ALIASES[name.strip().lower().replace("-", "_")]
    sign = 1 if maximize else -1
    if kind in ("ei", "log_ei", "pi", "log_pi"):
        make = {"ei": expected_improvement, "log_ei": log_expected_improvement, "pi": probability_of_improvement, "log_pi": log_probability_of_improvement}[kind]
        return make(mean, std, best, maximize)
    if kind == "nei":
        raise ValueError("noisy_expected_improvement needs the observed values")
    return {"ucb": sign * mean + kappa * std, "lcb": sign * mean - kappa * std, "mean": sign * mean, "uncertainty": std, "thompson": sign * mean + std * F.randn(seed)}[kind]


def kappa(iteration: int, mode: str = "fixed", base: float = 2.0, floor: float = 1.0, decay: float = 0.08, dims: int = 1, delta: float = 0.1) -> float:
    """The weight of the spread at an iteration from 1 on: fixed, decaying to ``floor``, or growing as the regret bound of a Gaussian process asks."""
    t = max(1, iteration)
    if mode == "fixed":
        return max(base, 0.0)
    if mode == "anneal":
        return floor + (max(base, floor) - floor) * math.exp(-max(decay, 0.0) * (t - 1))
    if mode == "gp_ucb":
        bound = 2 * ((max(dims, 1) / 2 + 2) * math.log(t) + math.log(math.pi**2 / (3 * min(max(delta, 1e-12), 1 - 1e-12))))
        return max(floor, math.sqrt(max(bound, 1e-12)))
    raise ValueError(f"no schedule named {mode!r}")


def composite(topology: Column, stability: Column, heuristic: Column, novelty: Column, ood: Column | None = None) -> Column:
    """The weighted score .4 / .3 / .15 / .15, less up to 15 % for rows out of distribution."""
    score = 0.4 * topology + 0.3 * stability + 0.15 * heuristic + 0.15 * novelty
    return score * (1 - 0.15 * clip(ood, 0, 1)) if ood is not None else score


def risk_gate(ood: Column, conformal: Column, most_ood: float = 0.5, most_conformal: float = 0.5, both: bool = False) -> Column:
    """Whether a row is too risky: by either measure, or by both."""
    a, b = ood >= most_ood, conformal >= most_conformal
    return a & b if both else a | b


def policy_utility(df: DataFrame, mode: str = "hybrid", novelty_boost: float = 0.25, eps: float = 1e-3, ood_weight: float = 0.3, conformal_weight: float = 0.2, **gate) -> DataFrame:
    """``df`` with risk_score, reject_reason, utility and gain_per_cost.

    From stability, novelty, cost, feasibility, ood and conformal (shares): the base is stability with a
    boost for novelty, per cost, times feasibility; the risk's penalty is taken off. Rows that the gate
    hits are ruled out (hard), halved first (hybrid) or only penalized (soft).
    """
    base = F.greatest(F.col("stability"), F.lit(0.0)) * (1 + novelty_boost * F.col("novelty")) / (F.col("cost") + eps) * F.greatest(F.col("feasibility"), F.lit(1e-6))
    penalty = ood_weight * clip(F.col("ood"), 0, 1) + conformal_weight * clip(F.col("conformal"), 0, 1)
    hit = risk_gate(clip(F.col("ood"), 0, 1), clip(F.col("conformal"), 0, 1), **gate) & F.lit(mode != "soft")
    hard = F.lit(-1e9) if mode == "hard" else base * 0.5 - penalty
    out = df.withColumns({"risk_score": clip(penalty, 0, 1), "reject_reason": F.when(hit, "risk_gate").otherwise(""), "utility": F.when(hit, hard).otherwise(base - penalty)})
    return out.withColumn("gain_per_cost", F.col("utility") / F.greatest(F.col("cost"), F.lit(eps)))
