"""Predicted against true 3x3 tensors, in columns: Frobenius error, asymmetry, order of eigenvalues."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.numeric import total

AXES = range(3)


def entries(tensor: Column) -> list[list[Column]]:
    return [[F.get(F.get(tensor, F.lit(i)), F.lit(j)).cast("double") for j in AXES] for i in AXES]


def sound(tensor: Column) -> Column:
    """Three rows of three finite numbers."""
    flat = F.flatten(tensor)
    return tensor.isNotNull() & (F.size(tensor) == 3) & F.forall(tensor, lambda r: r.isNotNull() & (F.size(r) == 3)) & F.forall(flat, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < math.inf))


def eigenvalues(tensor: Column) -> Column:
    """The eigenvalues of a symmetric tensor, ascending, by the trigonometric solution; its lower triangle counts."""
    e = entries(tensor)
    a, b, c, d, f, g = e[0][0], e[1][1], e[2][2], e[1][0], e[2][0], e[2][1]
    q = (a + b + c) / 3
    p = F.sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + f * f + g * g)) / 6)
    x, y, z = a - q, b - q, c - q
    det = x * (y * z - g * g) - d * (d * z - g * f) + f * (d * g - y * f)
    r = F.least(F.greatest(F.try_divide(det, 2 * p * p * p), F.lit(-1.0)), F.lit(1.0))
    phi = F.acos(r) / 3
    most, least = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return F.when(p > 0, F.array(least, 3 * q - most - least, most)).otherwise(F.array(q, q, q))


def _ranks(xs: Column) -> Column:
    """Mean ranks; values within 1e-6 of the largest size are equal, as the solution tells no closer ones apart."""
    width = 1e-6 * F.greatest(F.array_max(F.transform(xs, F.abs)), F.lit(1e-300))
    below = lambda x: total(F.transform(xs, lambda y: F.when(y < x - width, 1.0).when(y <= x + width, 0.5).otherwise(0.0)))
    return F.transform(xs, lambda x: below(x) + 0.5)


def _close(xs: Column, ys: Column) -> Column:
    return F.forall(F.zip_with(xs, ys, lambda x, y: F.abs(x - y) <= 1e-8 + 1e-5 * F.abs(y)), lambda ok: ok)


def with_agreement(df: DataFrame, target: str, pred: str, name: str = "agreement") -> DataFrame:
    """``df`` with Spearman's correlation of the eigenvalues of both; null where one is no sound tensor.

    If all eigenvalues of one are the same it is 1 for equal eigenvalues, else 0.
    """
    ok = sound(F.col(target)) & sound(F.col(pred))
    out = df.withColumns({"__t": F.when(ok, eigenvalues(F.col(target))), "__p": F.when(ok, eigenvalues(F.col(pred)))})
    level = lambda c: _close(F.col(c), F.transform(c, lambda x: F.get(F.col(c), F.lit(0))))
    out = out.withColumns({"__rt": F.transform(_ranks(F.col("__t")), lambda r: r - 2), "__rp": F.transform(_ranks(F.col("__p")), lambda r: r - 2)})
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    spearman = F.try_divide(dot("__rt", "__rp"), F.sqrt(dot("__rt", "__rt") * dot("__rp", "__rp")))
    value = F.when(level("__t") | level("__p"), F.when(_close(F.col("__p"), F.col("__t")), 1.0).otherwise(0.0)).otherwise(F.least(F.greatest(spearman, F.lit(-1.0)), F.lit(1.0)))
    return out.withColumn(name, F.when(ok, value)).drop("__t", "__p", "__rt", "__rp")


def tensor_report(df: DataFrame, target: str, pred: str) -> DataFrame:
    """One row: n, and means of the Frobenius error, of |C - C^T| of the prediction's entries, and of the agreement; 0 without sound rows."""
    scored = with_agreement(df, target, pred, "__a")
    t, p = entries(F.col(target)), entries(F.col(pred))
    ok = F.col("__a").isNotNull()
    gap = F.sqrt(sum(((t[i][j] - p[i][j]) * (t[i][j] - p[i][j]) for i in AXES for j in AXES), F.lit(0.0)))
    skew = sum((F.abs(p[i][j] - p[j][i]) for i in AXES for j in AXES), F.lit(0.0)) / 9
    mean = lambda x: F.coalesce(F.avg(x), F.lit(0.0))
    return scored.agg(F.count("__a").alias("n"), mean(F.when(ok, gap)).alias("frobenius"), mean(F.when(sound(F.col(pred)), skew)).alias("asymmetry"), mean("__a").alias("agreement"))
