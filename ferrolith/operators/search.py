"""Property search: criteria, filter expressions, element and stability filters."""

from __future__ import annotations

import math
import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.functions import chem
from ferrolith.functions.numeric import clip, normal_cdf, sigmoid
from ferrolith.operators.ordered import cut


def criterion(column: str, wanted) -> Column:
    """A pair is an inclusive range with open ends (None), a list or set means IN, else equality."""
    c = F.col(column)
    if isinstance(wanted, tuple) and len(wanted) == 2:
        low, high = wanted
        if any(isinstance(x, float) and not math.isfinite(x) for x in wanted) or (low is not None and high is not None and low > high):
            raise ValueError(f"no range for {column}: {wanted}")
        tests = [c >= low] * (low is not None) + [c <= high] * (high is not None)
        return reduce(operator.and_, tests, c.isNotNull())
    if isinstance(wanted, list | set | frozenset):
        return c.isin(*sorted(wanted))
    return c == wanted


def search(df: DataFrame, criteria: dict, sort_by: str | None = None, ascending: bool = True, limit: int = 50, tie: str = "jid") -> DataFrame:
    """Rows that meet all criteria of known columns, sorted, at most ``limit`` (a limit below 1 counts as 50)."""
    out = df.where(reduce(operator.and_, (criterion(c, w) for c, w in criteria.items() if c in df.columns), F.lit(True)))
    if sort_by in df.columns:
        out = out.orderBy(F.col(sort_by).asc_nulls_last() if ascending else F.col(sort_by).desc_nulls_last(), tie)
    return out.limit(limit if isinstance(limit, int) and limit > 0 else 50)


PRESETS = {"semiconductor": (0.5, 3.0), "insulator": (3.0, None)}


def build_criteria(preset: str | None = None, ehull_max: float | None = 0.1, ductile: bool = False, gap: str = "bandgap_best", **ranges) -> dict:
    """Criteria from a preset class, a stability bound, a flag and ranges; bounds of one column are intersected.

    The preset ``metal`` asks for that conductivity class, the others for a range of the gap.
    """
    out = {"conductivity_class": "metal"} if preset == "metal" else {gap: PRESETS[preset]} if preset else {}
    if ehull_max is not None:
        out["ehull"] = (None, ehull_max)
    for name, bounds in ranges.items():
        out[name] = intersect(out[name], bounds) if name in out else bounds
    return out | ({"is_ductile": True} if ductile else {})


def intersect(a: tuple, b: tuple) -> tuple:
    low = max((x for x in (a[0], b[0]) if x is not None), default=None)
    high = min((x for x in (a[1], b[1]) if x is not None), default=None)
    return low, high


def parse_filter(text: str) -> tuple[str, tuple]:
    """'column <= number' and the like; strict signs are taken as inclusive."""
    m = re.fullmatch(r"\s*([\w-]+)\s*(<=|>=|<|>)\s*([-+]?[\d.]+(?:[eE][-+]?\d+)?)\s*", text)
    if not m:
        raise ValueError(f"no filter: {text!r}")
    return m[1], (None, float(m[3])) if m[2][0] == "<" else (float(m[3]), None)


def check_columns(df: DataFrame, columns: list[str]) -> None:
    if unknown := [c for c in columns if c not in df.columns]:
        raise ValueError(f"unknown columns: {unknown}")


def filled_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of ``columns`` with any value."""
    there = [c for c in columns if c in df.columns]
    counts = df.agg(*(F.count(c).alias(c) for c in there)).first()
    return [c for c in there if counts[c]]


def with_elements(df: DataFrame, required: list[str], formula: str = "formula") -> DataFrame:
    """Rows whose formula has every required element."""
    return df.where(F.size(F.array_except(F.array(*map(F.lit, required)), chem.elements(F.col(formula)))) == 0)


def within_elements(df: DataFrame, allowed: list[str], formula: str = "formula") -> DataFrame:
    """Rows whose formula has no other element."""
    return df.where(F.size(F.array_except(chem.elements(F.col(formula)), F.array(*map(F.lit, allowed)))) == 0)


def heavy(df: DataFrame, least: int = 50, formula: str = "formula") -> DataFrame:
    return df.where(F.coalesce(chem.has_heavy(chem.parse_formula(F.col(formula)), least), F.lit(False)))


def stability_probability(ehull: Column, bound: float = 0.1, noise: float | Column = 0.03) -> Column:
    """The chance that the true energy above the hull is within the bound."""
    return normal_cdf((bound - ehull) / noise)


def adaptive_noise(df: DataFrame, energy: str, noise: float = 0.03, slope: float = 0.35) -> Column:
    """noise * (1 + slope * |robust z of the energy|), at most 1."""
    median = df.agg(F.median(energy)).first()[0]
    mad = df.agg(F.median(F.abs(F.col(energy) - F.lit(median)))).first()[0]
    z = F.abs(F.col(energy) - median) / (1.4826 * mad) if mad and mad >= 1e-12 else F.lit(0.0)
    return clip(noise * (1 + slope * F.coalesce(z, F.lit(0.0))), 1e-8, 1.0)


def stable(df: DataFrame, bound: float = 0.1, probability: float | None = None, noise: float = 0.03, tie: str = "jid", gap: tuple | None = None, gap_column: str = "bandgap_best") -> DataFrame:
    """Hard: ehull within the bound. With ``probability``: its chance is at least that, best first, equal ones by ``tie``.

    ``gap``: an inclusive range of ``gap_column``, with open ends as None.
    """
    if gap is not None:
        df = df.where(criterion(gap_column, gap))
    if probability is None:
        return df.where(F.col("ehull") <= bound)
    return df.withColumn("stability_probability", stability_probability(F.col("ehull"), bound, noise)).where(F.col("stability_probability") >= probability).orderBy(F.desc("stability_probability"), tie)


def topology_probability(spillage: Column, stability: Column, gap: Column, threshold: float = 0.5, temperature: float = 0.1, gap_center: float = 0.3, gap_scale: float = 0.2, weights: tuple = (0.70, 0.20, 0.10), calibration: float | None = None) -> Column:
    """The weighted geometric mean of three chances: spillage, stability and a low gap."""
    parts = (
        F.coalesce(sigmoid((spillage - threshold) / temperature), F.lit(0.0)),
        F.coalesce(stability, F.lit(0.5)),
        F.coalesce(sigmoid((gap_center - gap) / gap_scale), F.lit(0.5)),
    )
    p = F.exp(sum(w / sum(weights) * F.ln(clip(x, 1e-9, 1.0)) for w, x in zip(weights, parts, strict=True)))
    if calibration:
        q = clip(p, 1e-6, 1 - 1e-6)
        p = sigmoid(F.ln(q / (1 - q)) / calibration)
    return p


def topological(df: DataFrame, threshold: float = 0.5, gap_column: str = "optb88vdw_bandgap", most_gap: float = 0.3) -> DataFrame:
    """Spillage over the threshold; in a table without that column, a gap of ``most_gap`` at most stands for it."""
    if "spillage" not in df.columns:
        return df.where(F.col(gap_column) <= most_gap)
    return df.where(F.col("spillage") > threshold)


def matching(names: DataFrame, query: str, column: str) -> DataFrame:
    """``names`` with ``ratio``: 2 M / T of the name and ``query``, T letters together and M in matching blocks.

    The longest common block, the first one in the name and then in the query, splits both; what lies
    before it and behind it is matched likewise. One table of common runs for each name, then a block for
    each step, all in array functions; no letter counts as junk. Two empty texts have 1.
    """
    letters = F.lit(list(query)) if query else F.array().cast("array<string>")
    out = names.withColumns({"__q": letters, "__n": F.char_length(column)})
    out = out.withColumn("__a", F.when(F.col("__n") > 0, F.transform(F.sequence(F.lit(1), F.greatest("__n", F.lit(1))), lambda i: F.substring(F.col(column), i, F.lit(1)))).otherwise(F.array().cast("array<string>")))
    row = "transform(__q, (c, j) -> if(c = x, coalesce(get(get(acc, 0), j + 1), 0) + 1, 0))"
    out = out.withColumn("__r", F.expr(f"aggregate(reverse(__a), cast(array() as array<array<int>>), (acc, x) -> concat(array({row}), acc))"))
    kind = "struct<k:int,todo:array<struct<al:int,ah:int,bl:int,bh:int>>>"
    best = "array_max(flatten(transform(sequence(v.al, v.ah - 1), i -> transform(sequence(v.bl, v.bh - 1), j -> struct(least(get(get(__r, i), j), v.ah - i, v.bh - j) as k, -i as i, -j as j)))))"
    parts = "filter(array(struct(v.al as al, -b.i as ah, v.bl as bl, -b.j as bh), struct(b.k - b.i as al, v.ah as ah, b.k - b.j as bl, v.bh as bh)), p -> p.al < p.ah and p.bl < p.bh)"
    step = f"element_at(transform(array(get(s.todo, 0)), v -> element_at(transform(array({best}), b -> named_struct('k', s.k + b.k, 'todo', if(b.k > 0, concat({parts}, slice(s.todo, 2, size(s.todo))), slice(s.todo, 2, size(s.todo))))), 1)), 1)"
    start = f"cast(named_struct('k', 0, 'todo', if(__n > 0 and size(__q) > 0, array(named_struct('al', 0, 'ah', __n, 'bl', 0, 'bh', size(__q))), array())) as {kind})"
    blocks = F.expr(f"aggregate(sequence(0, 2 * least(__n, size(__q))), {start}, (s, t) -> cast(if(size(s.todo) = 0, s, {step}) as {kind}), s -> s.k)")
    whole = F.col("__n") + F.size("__q")
    return out.withColumn("ratio", F.when(whole > 0, 2.0 * blocks / whole).otherwise(1.0)).drop("__q", "__n", "__a", "__r")


def fuzzy(df: DataFrame, query: str, column: str = "formula", cutoff: float = 0.6, k: int = 5) -> DataFrame:
    """(name, ratio, n) of the names among the ``k`` rows most like ``query``: those of the highest ratio of ``cutoff`` or more.

    Each row counts, so that a name of ``k`` rows or more leaves no place for lesser ones; equal ratios go
    by the later name. Names are told apart first, and only those are matched whose length and common
    letters allow the ratio at all. Both steps are cut, as Spark would push what only needs the name down to
    every row, before names are told apart. Blank queries and null names match nothing.
    """
    query = query.strip()
    names = df.select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    if not query:
        return names.select(column, F.lit(0.0).alias("ratio"), "n").limit(0)
    size, m = F.char_length(column), len(query)
    common = sum((F.least(size - F.char_length(F.replace(F.col(column), F.lit(c), F.lit(""))), F.lit(query.count(c))) for c in sorted(set(query))), F.lit(0))
    near = cut(names).where((2.0 * F.least(size, F.lit(m)) >= cutoff * (size + m)) & (2.0 * common >= cutoff * (size + m)))
    best = cut(matching(near, query, column)).where(F.col("ratio") >= cutoff).orderBy(F.desc("ratio"), F.desc(column)).limit(k)
    before = Window.orderBy(F.desc("ratio"), F.desc(column)).rowsBetween(Window.unboundedPreceding, -1)  # over k names at most
    return best.withColumn("__b", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("__b") < k).select(column, "ratio", "n")


def fuzzy_search(df: DataFrame, query: str, column: str = "formula", cutoff: float = 0.6, k: int = 5) -> DataFrame:
    """All rows of the names that ``fuzzy`` finds."""
    found = fuzzy(df, query, column, cutoff, k).select(F.col(column).alias("__name"))
    return df.join(F.broadcast(found), F.col(column) == F.col("__name"), "left_semi")  # k names
