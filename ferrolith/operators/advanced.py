"""Operators on bounded inputs that need linear algebra or enumeration: they run in numpy, inside tasks or on small tables."""

from __future__ import annotations

import math
import re
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.functions import chem
from ferrolith.functions.numeric import clip, escort, total

#: Common oxidation states.
OXIDATION = {"H": [1, -1], "Li": [1], "Na": [1], "K": [1], "Mg": [2], "Ca": [2], "Al": [3], "C": [4, -4], "Si": [4, -4], "N": [-3, 5], "P": [5, -3], "O": [-2], "S": [-2, 4, 6], "F": [-1], "Cl": [-1], "Br": [-1], "I": [-1], "Ti": [4, 3], "Mn": [2, 4], "Fe": [3, 2], "Co": [2, 3], "Ni": [2], "Cu": [2, 1], "Zn": [2], "Sn": [4, 2], "Bi": [3], "Te": [-2, 4]}


def simplex_projection(xs: Column) -> Column:
    """The nearest point with non-negative parts that sum to 1."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for r in rows:
            x = np.asarray(r, float)
            s = np.sort(x)[::-1]
            c = (np.cumsum(s) - 1) / np.arange(1, len(s) + 1)
            out.append(np.maximum(x - c[np.flatnonzero(s > c)[-1]], 0).tolist())
        return pd.Series(out)

    return run(xs)


def nearest_correlation(matrix: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    """Symmetric, eigenvalues at least ``floor``, unit diagonal: for a matrix of a few channels."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    made = (vectors * np.maximum(values, floor)) @ vectors.T
    scale = np.sqrt(np.diag(made))
    return made / np.outer(scale, scale)


def escort_power(df: DataFrame, vector: str, target: float = 0.75, low: float = 0.2, high: float = 2.0, n: int = 25) -> DataFrame:
    """One row (power, entropy): the grid's power whose mean normalized entropy is nearest to the target, the least of equals."""
    grid = np.linspace(low, high, n).tolist()
    entropy = lambda p: -total(F.transform(escort(F.col(vector), p), lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0))) / F.ln(F.size(vector).cast("double"))
    sums = df.where(F.size(vector) > 1).agg(*(F.avg(entropy(p)).alias(f"e{i}") for i, p in enumerate(grid))).first()  # a number for each power
    best = min(range(n), key=lambda i: (abs((sums[i] or 0.0) - target), i))
    return df.sparkSession.createDataFrame([(grid[best], sums[best])], "power double, entropy double")


def ks_permutation(old: np.ndarray, new: np.ndarray, permutations: int = 256, seed: int = 0) -> tuple[float, float]:
    """(statistic, add-one p-value) of two bounded samples, for small or heavily tied ones."""
    def stat(a: np.ndarray, b: np.ndarray) -> float:
        grid = np.unique(np.concatenate((a, b)))
        return float(np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)).max())

    z, rng, seen = np.concatenate((old, new)), np.random.default_rng(seed), stat(old, new)
    over = sum(stat((p := rng.permutation(z))[: len(old)], p[len(old) :]) >= seen - 1e-12 for _ in range(permutations))
    return seen, (1 + over) / (1 + permutations)


def residual_correlation(residuals: DataFrame, order: str, channels: list[str], tail: int = 500, shrink: float = 20.0) -> DataFrame:
    """(a, b, n, correlation) of channel pairs over the latest ``tail`` rows where both are known, shrunk to 0 for few rows."""
    recent = residuals.orderBy(F.desc(order)).limit(tail)
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i + 1 :]]
    sums = recent.agg(*(x for a, b in pairs for x in (F.corr(a, b).alias(f"c_{a}_{b}"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n_{a}_{b}"))))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n_{a}_{b}").alias("n"), (F.coalesce(f"c_{a}_{b}", F.lit(0.0)) * F.col(f"n_{a}_{b}") / (F.col(f"n_{a}_{b}") + shrink)).alias("correlation")) for a, b in pairs))
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def exploration_ranking(df: DataFrame, key: str, width: float = 0.35, ood: float = 0.5, least: float = 0.0, k: int = 50) -> DataFrame:
    """The k best by probability + width * interval - ood * distance."""
    score = F.col("probability") + width * (F.col("ci_high") - F.col("ci_low")) - ood * F.coalesce("ood", F.lit(0.0))
    return df.where(F.col("probability") >= least).withColumn("exploration", score).orderBy(F.desc("exploration"), key).limit(k)


def near_copies_of_known(df: DataFrame, known: DataFrame, key: str, energy: str, tolerance: float = 1e-3) -> DataFrame:
    """(key, known_key): rows of the same composition as a known one, with an energy within the tolerance.

    An equi-join on the composition, so that only rows of one block meet.
    """
    sign = chem.signature(chem.fractions(chem.parse_formula(F.col("formula"))))
    a = df.select(key, sign.alias("block"), F.col(energy).alias("e"))
    b = known.select(F.col(key).alias("known_key"), sign.alias("block"), F.col(energy).alias("known_e"))
    return a.join(b, "block").where((F.abs(F.col("e") - F.col("known_e")) <= tolerance) & (F.col(key) != F.col("known_key"))).select(key, "known_key")


def hypervolume_gains(df: DataFrame, front: np.ndarray, objectives: list[str], ref: list[float], top: list[float], probes: int = 2048, seed: int = 0) -> Column:
    """What each row adds to the hypervolume of a bounded front, by probes shared by all rows."""
    points = np.random.default_rng(seed).uniform(ref, top, (probes, len(objectives)))
    front = np.asarray(front, float).reshape(-1, len(objectives))
    open_points = points[~(front[:, None] >= points[None]).all(axis=2).any(axis=0)] if len(front) else points
    unit = float(np.prod(np.subtract(top, ref))) / probes

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        return pd.Series([(row >= open_points).all(axis=1).sum() * unit for row in x], dtype=float)

    return run(*(F.col(o).cast("double") for o in objectives))


def charge_balance(formula: Column, most: int = 256) -> Column:
    """exp(-least absolute charge per atom) over the products of common oxidation states; 0.5 for unknown elements."""

    @F.pandas_udf("double")
    def run(formulas: pd.Series) -> pd.Series:
        out = []
        for text in formulas:
            n: dict[str, float] = {}
            for e, c in re.findall(r"([A-Z][a-z]?)([0-9]*\.?[0-9]*)", text or ""):
                n[e] = n.get(e, 0.0) + float(c or 1)
            if not n or any(e not in OXIDATION for e in n):
                out.append(0.5)
                continue
            states = list(product(*(OXIDATION[e] for e in n)))[:most]
            out.append(math.exp(-min(abs(sum(s * c for s, c in zip(z, n.values(), strict=True))) for z in states) / sum(n.values())))
        return pd.Series(out, dtype=float)

    return run(formula)


def gaussian_process(train: DataFrame, df: DataFrame, features: list[str], target: str, key: str, most: int = 1000, length: float = 1.0, noise: float = 1e-2) -> DataFrame:
    """(key, mean, std) of a Matern-5/2 process, features standardized by the training rows, of which at most ``most`` are used (by hash)."""
    t = train.orderBy(F.md5(F.col(key).cast("string")), key).limit(most).select(*(F.col(f).cast("double").alias(f) for f in features), F.col(target).cast("double").alias("__y")).toPandas().dropna()
    x, y = t[features].to_numpy(float), t["__y"].to_numpy()
    shift, scale, middle = x.mean(axis=0), np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1), y.mean()

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = np.sqrt(5) * np.sqrt(np.maximum(((a[:, None] - b[None]) ** 2).sum(axis=2), 0)) / length
        return (1 + d + d * d / 3) * np.exp(-d)

    x = (x - shift) / scale
    spread = max(float(y.std()), 1e-9)
    lower = np.linalg.cholesky(kernel(x, x) + noise * np.eye(len(x)))
    alpha = np.linalg.solve(lower.T, np.linalg.solve(lower, (y - middle) / spread))

    @F.pandas_udf("mean double, std double")
    def run(*columns: pd.Series) -> pd.DataFrame:
        q = (np.column_stack([c.to_numpy(float) for c in columns]) - shift) / scale
        k = kernel(q, x)
        v = np.linalg.solve(lower, k.T)
        return pd.DataFrame({"mean": middle + spread * (k @ alpha), "std": spread * np.sqrt(np.maximum(1 + noise - (v * v).sum(axis=0), 1e-12))})

    return df.select(key, run(*(F.col(f).cast("double") for f in features)).alias("gp")).select(key, "gp.mean", "gp.std")


def adaptive_weights(df: DataFrame, weights: dict[str, float], power: float = 0.5) -> DataFrame:
    """``df`` with ``ranking``: parts weighted by w * std ** power, weights over their sum."""
    std = df.agg(*(F.stddev_pop(c).alias(c) for c in weights)).first()
    raw = {c: w * max(std[c] or 0.0, 1e-9) ** power for c, w in weights.items()}
    return df.withColumn("ranking", sum(F.col(c) * (w / sum(raw.values())) for c, w in raw.items()))


def tensor_metrics(df: DataFrame, target: str, pred: str) -> DataFrame:
    """One row: mean Frobenius error and mean symmetry violation of predicted square arrays."""
    square = lambda m: total(F.transform(F.flatten(m), lambda x: x * x))
    gap = F.zip_with(F.flatten(target), F.flatten(pred), lambda a, b: (a - b) * (a - b))
    n = F.size(pred)
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(pred, lambda row: F.get(row, i)))
    skew = F.zip_with(F.flatten(pred), F.flatten(turned), lambda a, b: (a - b) * (a - b))
    return df.agg(F.avg(F.sqrt(total(gap))).alias("frobenius"), F.avg(F.sqrt(total(skew)) / F.greatest(F.sqrt(square(F.col(pred))), F.lit(1e-12))).alias("asymmetry"))


def physics_penalty(df: DataFrame, bulk: str, shear: str, dielectric: str, weight: float = 0.1) -> DataFrame:
    """One row: mean hinge penalties for negative moduli and a dielectric constant under 1."""
    hinge = lambda x: F.greatest(x, F.lit(0.0))
    return df.agg((weight * (F.avg(hinge(-F.col(bulk))) + F.avg(hinge(-F.col(shear))))).alias("positivity"), (weight * F.avg(hinge(1 - F.col(dielectric)))).alias("dielectric"))


def recent_reliability(df: DataFrame, order: str, group: str, success: str, window: int = 128) -> DataFrame:
    """(group, rate): the share of successes among each group's latest ``window`` rows, smoothed by one of each."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= window).groupBy(group).agg(((1 + F.sum(F.col(success).cast("int"))) / (2 + F.count("*"))).alias("rate"))


def calibrate(p: Column, temperature: float) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return 1 / (1 + F.exp(-F.ln(q / (1 - q)) / temperature))
