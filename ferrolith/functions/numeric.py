"""Numeric column functions. NULL is the missing value; NaN and infinities become NULL at the edges."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) < math.inf), x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def sigmoid(x: Column, bound: float = 50.0) -> Column:
    return 1 / (1 + F.exp(-clip(x, -bound, bound)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def normal_pdf(z: Column) -> Column:
    return F.exp(-0.5 * z * z) * (1 / math.sqrt(2 * math.pi))


def normal_cdf(z: Column) -> Column:
    """Phi by the rational approximation of erf with a maximal error of 1.5e-7; missing stays missing."""
    # fixed values: Abramowitz and Stegun 7.1.26
    a1, a2, a3, a4, a5, p = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + p * x)
    tail = t * (a1 + t * (a2 + t * (a3 + t * (a4 + t * a5)))) * F.exp(-x * x)
    return F.when(z >= 0, 1 - 0.5 * tail).otherwise(0.5 * tail)


def log_normal_cdf(z: Column, switch: float = -6.0) -> Column:
    """ln Phi; below ``switch`` by the first terms of Mills' ratio."""
    low = F.least(z, F.lit(switch))
    return F.when(z < switch, -0.5 * low * low - F.ln(-low) - 0.5 * math.log(2 * math.pi) + F.ln(1 - 1 / (low * low))).otherwise(F.ln(normal_cdf(z)))


def log_gamma(x: Column) -> Column:
    """ln Gamma of positive numbers by Lanczos' sum, to about 1e-14 of its size; null for others."""
    # fixed values: Lanczos' coefficients for g = 7 and nine terms
    g = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
    small = x < 0.5
    y = F.when(small, 1 - x).otherwise(x) - 1  # below a half by reflection
    series = g[0] + sum((c / (y + (i + 1)) for i, c in enumerate(g[1:])), F.lit(0.0))
    t = y + 7.5
    value = 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.ln(t) - t + F.ln(series)
    return F.when(x > 0, F.when(small, math.log(math.pi) - F.ln(F.sin(math.pi * x)) - value).otherwise(value))


def gaussian_basis(x: Column, low: float = 0.0, high: float = 5.0, n: int = 20) -> Column:
    """exp(-((x - c) / w)^2) at ``n`` even centers."""
    width = (high - low) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.exp(-F.pow((x - (low + k * width)) / width, F.lit(2))))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, make) -> Column:
    """``make`` of a value that is named once, so that nested use doesn't multiply the expression."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def renormalize(xs: Column) -> Column:
    """Non-negative parts over their sum; all zero becomes uniform."""
    positive = F.transform(xs, lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))
    return let(F.struct(positive.alias("v"), total(positive).alias("s")), lambda p: F.transform(p["v"], lambda x: F.when(p["s"] > 0, x / p["s"]).otherwise(F.lit(1.0) / F.size(p["v"]))))


def escort(xs: Column, power: float) -> Column:
    return renormalize(F.transform(renormalize(xs), lambda x: F.pow(x, F.lit(float(power)))))


def softmax(xs: Column, temperature: float = 1.0) -> Column:
    raised = let(xs, lambda v: F.transform(v, lambda x: F.exp((x - F.array_max(v)) / temperature)))
    return let(raised, lambda r: F.transform(r, lambda x: x / total(r)))


def clr_softmax(xs: Column, temperature: float = 1.0, eps: float = 1e-8) -> Column:
    """Softmax of the centered log-ratios; on a full basis the isometric form is the same."""
    logs = F.transform(renormalize(xs), lambda x: F.ln(F.greatest(x, F.lit(eps))))
    return softmax(logs, temperature)  # softmax takes off any shift, the centering too


def l2_normalize(xs: Column) -> Column:
    norm = F.sqrt(total(F.transform(xs, lambda x: (x * x).cast("double"))))
    return let(F.struct(xs.alias("v"), norm.alias("n")), lambda p: F.transform(p["v"], lambda x: F.when(p["n"] > 1e-12, x / p["n"]).otherwise(F.lit(0.0))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x * y).cast("double")))


def entropic_risk(x: Column, gamma: float) -> Column:
    """Aggregate: the log-mean-exp of ``gamma * x`` over gamma, shifted by the maximum."""
    return F.max(x) + F.ln(F.avg(F.exp(gamma * x)) / F.exp(gamma * F.max(x))) / gamma
