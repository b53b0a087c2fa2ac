"""Composition strings as columns: parsing, fractions, descriptors, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrolith.functions.numeric import total

#: Element symbols in order of atomic number, and standard atomic masses.
SYMBOLS = "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr".split()
MASSES = [
    1.008, 4.0026, 6.94, 9.0122, 10.81, 12.011, 14.007, 15.999, 18.998, 20.180, 22.990, 24.305, 26.982, 28.085, 30.974, 32.06, 35.45, 39.948, 39.098, 40.078,
    44.956, 47.867, 50.942, 51.996, 54.938, 55.845, 58.933, 58.693, 63.546, 65.38, 69.723, 72.630, 74.922, 78.971, 79.904, 83.798, 85.468, 87.62, 88.906, 91.224,
    92.906, 95.95, 98.0, 101.07, 102.91, 106.42, 107.87, 112.41, 114.82, 118.71, 121.76, 127.60, 126.90, 131.29, 132.91, 137.33, 138.91, 140.12, 140.91, 144.24,
    145.0, 150.36, 151.96, 157.25, 158.93, 162.50, 164.93, 167.26, 168.93, 173.05, 174.97, 178.49, 180.95, 183.84, 186.21, 190.23, 192.22, 195.08, 196.97, 200.59,
    204.38, 207.2, 208.98, 209.0, 210.0, 222.0, 223.0, 226.0, 227.0, 232.04, 231.04, 238.03, 237.0, 244.0, 243.0, 247.0, 247.0, 251.0, 252.0, 257.0, 258.0, 259.0, 262.0,
]
NUMBERS = {s: i + 1 for i, s in enumerate(SYMBOLS)}


def _lookup(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def parse_formula(formula: Column) -> Column:
    """map(element, count): counts default to 1, repeats add up; NULL without an element.

    Elements come in order of first appearance; parentheses have no meaning.
    """
    names = F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?)([0-9]*\.?[0-9]*)"), F.lit(1))
    counts = F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?)([0-9]*\.?[0-9]*)"), F.lit(2))
    pairs = F.zip_with(names, counts, lambda e, c: F.struct(e.alias("e"), F.coalesce(c.try_cast("double"), F.lit(1.0)).alias("n")))
    made = F.map_from_entries(F.transform(F.array_distinct(names), lambda e: F.struct(e, F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.when(p["e"] == e, p["n"]).otherwise(0.0)))))
    return F.when(F.size(names) > 0, made)


def elements(formula: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(formula, F.lit("[A-Z][a-z]?"), F.lit(0))))


def chemical_system(formula: Column) -> Column:
    return F.array_join(elements(formula), "-")


def fractions(parsed: Column) -> Column:
    """map(element, share) of a parsed formula."""
    return F.transform_values(parsed, lambda _, n: n / total(F.map_values(parsed)))


def fraction_vector(parsed: Column, basis: list[str]) -> Column:
    """The shares in the order of ``basis``; 0 for absent elements."""
    return F.transform(F.array(*map(F.lit, basis)), lambda e: F.coalesce(F.try_element_at(parsed, e), F.lit(0.0)) / total(F.map_values(parsed)))


def complexity(parsed: Column) -> Column:
    """The entropy of the shares over ln(number of elements), 0 for a single element or no formula."""
    shares = F.map_values(fractions(parsed))
    entropy = -total(F.transform(shares, lambda p: p * F.ln(p)))
    return F.coalesce(F.when(F.size(shares) > 1, F.least(F.lit(1.0), entropy / F.ln(F.size(shares).cast("double")))), F.lit(0.0))


def _weighted(parsed: Column, values: dict) -> Column:
    table = _lookup(values)
    return F.aggregate(F.map_entries(parsed), F.lit(0.0), lambda a, e: a + e["value"] * F.try_element_at(table, e["key"]))


def molar_mass(parsed: Column) -> Column:
    """NULL if any element is unknown."""
    return _weighted(parsed, dict(zip(SYMBOLS, MASSES, strict=True)))


def average_mass(parsed: Column, fallback: float = 30.0) -> Column:
    return F.coalesce(molar_mass(parsed) / total(F.map_values(parsed)), F.lit(fallback))


def n_atoms(parsed: Column) -> Column:
    return F.coalesce(total(F.map_values(parsed)), F.lit(1.0))


def z_moments(parsed: Column) -> Column:
    """struct(mean, std, least, most) of the atomic numbers, weighted by share."""
    numbers = {k: float(v) for k, v in NUMBERS.items()}
    n = total(F.map_values(parsed))
    mean = _weighted(parsed, numbers) / n
    square = _weighted(parsed, {k: v * v for k, v in numbers.items()}) / n
    each = F.transform(F.map_keys(parsed), lambda e: F.try_element_at(_lookup(NUMBERS), e))
    return F.struct(mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), F.array_min(each).alias("least"), F.array_max(each).alias("most"))


def has_heavy(parsed: Column, least: int = 50) -> Column:
    return F.exists(F.map_keys(parsed), lambda e: F.coalesce(F.try_element_at(_lookup(NUMBERS), e) >= least, F.lit(False)))


def signature(parsed: Column, digits: int = 6) -> Column:
    """Sorted element:count pairs, equal for equal compositions."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(parsed)), lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"], digits).cast("string"))), "|")


def formula_of(parsed: Column) -> Column:
    """A formula with sorted elements: counts of 1 are left out, whole counts have no decimals, others three at most."""
    def said(n: Column) -> Column:
        return F.when(F.abs(n - 1) < 1e-9, F.lit("")).when(F.abs(n - F.round(n)) < 1e-9, F.round(n).cast("bigint").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(F.format_number(n, 3), "0+$", ""), r"\.$", ""))

    return F.array_join(F.transform(F.array_sort(F.map_entries(parsed)), lambda e: F.concat(e["key"], said(e["value"]))), "")


def space_group(value: Column) -> Column:
    """1 to 230, else NULL."""
    n = F.trim(value.cast("string")).try_cast("int")
    return F.when(n.between(1, 230), n)


def crystal_system(number: Column) -> Column:
    """0 (triclinic) to 6 (cubic) by the space group number."""
    out = F.when(number <= 2, 0)
    for k, last in enumerate((15, 74, 142, 167, 194, 230), start=1):
        out = out.when(number <= last, k)
    return out


def key(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[-_\s]", ""))


def present(value: Column) -> Column:
    """A trimmed string, NULL for the usual words for a missing value."""
    text = F.trim(value.cast("string"))
    return F.when(~F.lower(text).isin("", "na", "nan", "none", "null", "<na>"), text)
