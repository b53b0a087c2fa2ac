"""Derived physical columns, and alloy mixing by sums over phases."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions import chem
from ferrolith.functions.numeric import clip

#: CODATA, SI units.
AMU, HBAR, BOLTZMANN = 1.66053906660e-27, 1.054571817e-34, 1.380649e-23


def elastic_columns(df: DataFrame, mass_fallback: float = 30.0) -> DataFrame:
    """Young's modulus, Pugh ratio, ductility, hardness, Debye and melting temperature, conductivity index.

    From bulk_modulus_kv, shear_modulus_gv (GPa), density (g/cm3), poisson and formula; p_metal, where
    there is one, mixes the two melting laws. What can't be had is NULL; a missing ratio isn't ductile.
    """
    k, g, rho = F.col("bulk_modulus_kv"), F.col("shear_modulus_gv"), F.col("density")
    solid = (k > 0) & (g > 0)
    pugh = F.when(g > 0, k / g)
    parsed = chem.parse_formula(F.col("formula"))
    hardness = F.when(solid, F.greatest(2 * F.pow(F.pow(g / k, F.lit(2)) * g, F.lit(0.585)) - 3, F.lit(0.0)))
    out = df.withColumns({"youngs_modulus": F.when(solid, F.try_divide(9 * k * g, 3 * k + g)), "pugh_ratio": pugh, "is_ductile": F.coalesce(pugh > 1.75, F.lit(False)), "hardness_chen": hardness, "avg_atomic_mass_amu_est": chem.average_mass(parsed, mass_fallback), "n_atoms_formula_est": chem.n_atoms(parsed)})
    ok = (g > 0) & (rho > 0) & (k + 4 * g / 3 > 0)
    slow, fast = F.sqrt(g * 1e9 / (rho * 1000)), F.sqrt((k + 4 * g / 3) * 1e9 / (rho * 1000))
    speed = F.pow((2 / F.pow(slow, F.lit(3)) + 1 / F.pow(fast, F.lit(3))) / 3, F.lit(-1 / 3))
    density = rho * 1000 / (F.col("avg_atomic_mass_amu_est") * AMU)
    theta = F.when(ok, HBAR / BOLTZMANN * F.pow(6 * math.pi**2 * density, F.lit(1 / 3)) * speed)
    out = out.withColumn("__theta", theta).withColumn("debye_temperature", F.round("__theta", 1))
    t, p = F.col("__theta"), F.col("p_metal") if "p_metal" in df.columns else F.lit(0.0)
    melt_metal, melt_other = 607 + 9.3 * t, 400 + 7 * t
    gamma = clip(1.5 * (1 + F.col("poisson")) / F.greatest(2 - 3 * F.col("poisson"), F.lit(1e-8)), 0.5, 4)
    return out.withColumns({
        "melting_point_est": p * melt_metal + (1 - p) * melt_other,
        "melting_point_est_std": F.sqrt(F.greatest(p * (1 - p) * F.pow(melt_metal - melt_other, F.lit(2)), F.lit(0.0))),
        "slack_kappa_index": F.pow(t, F.lit(3)) / (gamma * gamma * F.col("avg_atomic_mass_amu_est")),
    }).drop("__theta")


def axis_mean(df: DataFrame, prefix: str) -> Column:
    """The mean of the present of three axes."""
    axes = [F.col(f"{prefix}{d}") for d in "xyz"]
    n = sum(a.isNotNull().cast("int") for a in axes)
    return F.when(n > 0, F.try_divide(sum(F.coalesce(a, F.lit(0.0)) for a in axes), n))


def voigt(c: Column) -> tuple[Column, Column]:
    """(bulk, shear) Voigt averages of a 6x6 stiffness array."""
    at = lambda i, j: F.get(F.get(c, F.lit(i)), F.lit(j))
    same, cross, shear = at(0, 0) + at(1, 1) + at(2, 2), at(0, 1) + at(0, 2) + at(1, 2), at(3, 3) + at(4, 4) + at(5, 5)
    return (same + 2 * cross) / 9, (same - cross + 3 * shear) / 15


def reuss(c: Column) -> Column:
    """struct(bulk, shear) Reuss averages, from the pseudo-inverse."""

    @F.pandas_udf("bulk double, shear double")
    def run(cs: pd.Series) -> pd.DataFrame:
        out = []
        for m in cs:
            s = np.linalg.pinv(np.array([list(r) for r in m], float))
            same, cross, shear = np.trace(s[:3, :3]), s[0, 1] + s[0, 2] + s[1, 2], np.trace(s[3:, 3:])
            out.append((1 / (same + 2 * cross), 15 / (4 * same - 4 * cross + 3 * shear)))
        return pd.DataFrame(out, columns=["bulk", "shear"])

    return run(c)


def normalize_phases(df: DataFrame, keys: list[str], fraction: str = "fraction") -> DataFrame:
    """Positive phase fractions over their sum."""
    kept = df.where(F.col(fraction) > 0)
    return kept.join(kept.groupBy(*keys).agg(F.sum(fraction).alias("__all")), keys).withColumn(fraction, F.col(fraction) / F.col("__all")).drop("__all")


def mix_alloys(phases: DataFrame) -> DataFrame:
    """One row an alloy from (alloy, phase, weight_fraction, density, bulk, shear, conductivity, melting).

    Volume shares from weights and densities; Voigt, Reuss and mean moduli, parallel and series
    conductivity with their geometric mean, harmonic melting point, and mixing entropy (nats).
    """
    p = phases.where("weight_fraction > 0 and density > 0").withColumn("v", F.col("weight_fraction") / F.col("density"))
    p = p.join(p.groupBy("alloy").agg(F.sum("v").alias("__v"), F.sum("weight_fraction").alias("__w")), "alloy")
    p = p.withColumn("v", F.col("v") / F.col("__v")).withColumn("w", F.col("weight_fraction") / F.col("__w"))
    s = lambda c: F.sum(F.col("v") * F.col(c))
    h = lambda c: 1 / F.sum(F.col("v") / F.col(c))
    made = p.groupBy("alloy").agg(
        F.count("*").alias("n_phases"), F.sum("v").alias("volume_sum"), s("density").alias("density"),
        s("bulk").alias("bulk_voigt"), h("bulk").alias("bulk_reuss"), s("shear").alias("shear_voigt"), h("shear").alias("shear_reuss"),
        s("conductivity").alias("conductivity_upper"), h("conductivity").alias("conductivity_lower"), F.exp(F.sum(F.col("v") * F.ln("conductivity"))).alias("conductivity_geometric"),
        (1 / F.sum(F.col("w") / F.col("melting"))).alias("melting"), (-F.sum(F.col("v") * F.ln("v"))).alias("mixing_entropy"),
    )
    return made.withColumn("bulk_vrh", (F.col("bulk_voigt") + F.col("bulk_reuss")) / 2).withColumn("shear_vrh", (F.col("shear_voigt") + F.col("shear_reuss")) / 2)


def crossings(curve: DataFrame, keys: list[str], x: str, y: str, level: float) -> DataFrame:
    """The first x, by linear interpolation, at which each curve passes ``level``."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(x)
    step = curve.withColumn("__y", F.lead(y).over(w)).withColumn("__x", F.lead(x).over(w)).where(((F.col(y) - level) * (F.col("__y") - level) <= 0) & (F.col(y) != F.col("__y")))
    return step.groupBy(*keys).agg(F.min(F.col(x) + (level - F.col(y)) * (F.col("__x") - F.col(x)) / (F.col("__y") - F.col(y))).alias("crossing"))
