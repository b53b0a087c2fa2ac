"""Splits by whole groups as a search: balance of sizes, groups and labels against similarity across splits.

The cost of dealing groups to train, val and test is a sum of stated terms:

- sizes: the squared errors of the splits' rows against ratio * rows, each over its target (1 at least);
- groups: the same of the number of groups, times ``groups_weight``;
- labels: the mean over splits of ((mean label of the split - mean of all) / spread of all)^2, 1 for a
  split without labels, times ``label_weight``;
- leakage: the similarity of all pairs of groups in different splits, weighted by which two splits
  (``pair_weights``: train-val, train-test, val-test), over the number of pairs, times ``leakage_weight``.

Statistics of groups are one aggregate over the rows. Each restart is a task that sees only these: it deals
groups largest first, equal sizes in the order of a hash of restart and name, each to the split of least
cost (the first of equal ones), then moves single groups while that lowers the cost, and at last gives an
empty split the group that costs least. The similarity of each group to each split is kept and changed by
one row of the matrix with a move, so that a trial costs the same however many groups there are. The
restart of least cost wins, the first of equal ones.

A task sees ``most_units`` units at most: beyond that the groups that each hold over 1 / most_units of the
rows stay units, about half as many bundles take the rest by a hash of their names, and a bundle is placed
as one; it is as similar as its largest group. No number of groups is refused.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.operators.ordered import cut

NAMES = ("train", "val", "test")
EPS = 1e-12
MOST_UNITS = 4096
#: Rows (a name and a split) that the join back may broadcast.
MOST_BROADCAST = 200_000


def jaccard_rows(sets: list) -> np.ndarray:
    """The Jaccard similarity of all pairs of sets of names; two empty sets have 0."""
    names = {x: i for i, x in enumerate(sorted({x for s in sets for x in s}))}
    has = np.zeros((len(sets), max(len(names), 1)))
    for i, s in enumerate(sets):
        has[i, [names[x] for x in s]] = 1
    both, size = has @ has.T, has.sum(axis=1)
    union = size[:, None] + size[None, :] - both
    return np.where(union > 0, both / np.maximum(union, 1), 0)


def cosine_rows(vectors: list) -> np.ndarray:
    """The cosine, 0 at least, of all pairs of vectors; a missing or zero vector is similar to none."""
    d = max((len(v) for v in vectors if v is not None), default=1)
    m = np.array([v if v is not None and len(v) == d else np.zeros(d) for v in vectors], float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    m = m / np.where(norm > EPS, norm, 1)
    return np.clip(m @ m.T, 0, 1)


def spacegroup_rows(numbers: list) -> np.ndarray:
    """0.6 for the same crystal system plus 0.4 (1 - distance / 230); what has no number is similar to none."""
    n = np.array([np.nan if x is None or not len(x) else x[0] for x in numbers], float)
    system = np.searchsorted([2, 15, 74, 142, 167, 194], np.nan_to_num(n))
    same = system[:, None] == system[None, :]
    out = 0.6 * same + 0.4 * np.maximum(0, 1 - np.abs(n[:, None] - n[None, :]) / 230)
    return np.nan_to_num(out)


class Search:
    """One restart over the statistics of units: n, labels (sum, count), similarity."""

    def __init__(self, n: np.ndarray, groups: np.ndarray, label_sum: np.ndarray, label_count: np.ndarray, spread: tuple[float, float] | None, similar: np.ndarray | None, ratios: tuple, weights: tuple, pair_weights: tuple) -> None:
        share = np.array(ratios, float) / sum(ratios)
        self.use = np.flatnonzero(share > 0)
        self.want, self.want_groups = share * n.sum(), share * groups.sum()
        self.n, self.groups, self.ls, self.lc = n.astype(float), groups.astype(float), label_sum, label_count
        self.size_weight, self.groups_weight, self.label_weight, self.leakage_weight = weights
        self.spread, self.similar = spread if self.label_weight > 0 else None, None
        if similar is not None and self.leakage_weight > 0:
            self.similar = similar.copy()
            np.fill_diagonal(self.similar, 0)
            a, b, c = pair_weights
            self.across = np.array([[0, a, b], [a, 0, c], [b, c, 0]])
            self.near = np.zeros((len(n), 3))  # similarity to what each split holds
        self.state, self.at, self.leak = np.zeros((4, 3)), np.full(len(n), -1), 0.0
        self.pairs = max(len(n) * (len(n) - 1) / 2, 1)

    def cost(self, state: np.ndarray, leak: float) -> float:
        size, number, ls, lc = state
        out = self.size_weight * ((((size - self.want) / np.maximum(self.want, 1)) ** 2).sum()) + self.groups_weight * ((((number - self.want_groups) / np.maximum(self.want_groups, 1)) ** 2).sum())
        if self.spread:
            mean, scale = self.spread
            err = sum(1.0 if lc[s] <= 0 else ((ls[s] / lc[s] - mean) / scale) ** 2 for s in self.use)
            out += self.label_weight * err / len(self.use)
        return out + (self.leakage_weight * leak / self.pairs if self.similar is not None else 0)

    def trial(self, u: int, to: int) -> tuple[np.ndarray, float]:
        """The state and the leakage if unit ``u`` were in split ``to``."""
        own, state, leak = np.array([self.n[u], self.groups[u], self.ls[u], self.lc[u]]), self.state.copy(), self.leak
        state[:, to] += own
        if self.at[u] >= 0:
            state[:, self.at[u]] -= own
        if self.similar is not None:
            before = self.across[self.at[u]] @ self.near[u] if self.at[u] >= 0 else 0.0
            leak += self.across[to] @ self.near[u] - before
        return state, leak

    def move(self, u: int, to: int) -> None:
        self.state, self.leak = self.trial(u, to)
        if self.similar is not None:
            self.near[:, to] += self.similar[u]
            if self.at[u] >= 0:
                self.near[:, self.at[u]] -= self.similar[u]
        self.at[u] = to

    def best(self, u: int, least: float, choices: np.ndarray) -> int:
        """The choice whose cost is below ``least`` and least, the first of equal ones; -1 if none is below."""
        found = -1
        for s in choices:
            c = self.cost(*self.trial(u, s))
            if c + EPS < least:
                least, found = c, int(s)
        return found

    def run(self, order: np.ndarray, passes: int) -> tuple[float, float]:
        """The cost after dealing and after moves."""
        for u in order:
            self.move(u, self.best(u, np.inf, self.use))
        dealt = self.cost(self.state, self.leak)
        for _ in range(passes):
            moved = False
            for u in order:
                if self.groups[self.at == self.at[u]].sum() <= self.groups[u] and len(order) >= len(self.use):
                    continue  # it would leave its split empty
                to = self.best(u, self.cost(self.state, self.leak), self.use[self.use != self.at[u]])
                if to >= 0:
                    self.move(u, to)
                    moved = True
            if not moved:
                break
        for s in self.use:
            spare = [u for u in order if (self.at == self.at[u]).sum() > 1]
            if not (self.at == s).any() and spare:
                self.move(min(spare, key=lambda u: (self.cost(*self.trial(u, s)), self.n[u])), s)
        return dealt, self.cost(self.state, self.leak)


SIMILAR: dict[str, Callable[[list], np.ndarray]] = {"sets": jaccard_rows, "vectors": cosine_rows, "spacegroups": spacegroup_rows}


def units(df: DataFrame, group: str, target: Column | None, trait: Column | None, kind: str | None, most_units: int) -> tuple[DataFrame, DataFrame]:
    """(unit, n, groups, label_sum, label_count, label_squares, trait) and (group, unit); unit: its name, or a bundle's number.

    ``trait``: of a group an array, the same in all rows for sets and space groups (the least is taken), a
    mean for vectors. Labels that are null or not finite don't count.
    """
    y = F.lit(None).cast("double") if target is None else target.cast("double")
    y = F.when(F.abs(y) < float("inf"), y)
    rows = df.select(F.col(group).cast("string").alias("group"), y.alias("y"), (F.lit(None).cast("array<double>") if trait is None else trait).alias("trait"))
    sums = [F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("label_sum"), F.count("y").cast("double").alias("label_count"), F.coalesce(F.sum(F.col("y") * F.col("y")), F.lit(0.0)).alias("label_squares")]
    if kind == "vectors":  # a mean, place by place, without gathering a group's vectors
        places = rows.where("trait is not null").select(F.col("group").alias("__g"), F.posexplode("trait").alias("i", "x")).groupBy("__g", "i").agg(F.avg("x").alias("x"))
        means = places.groupBy("__g").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("trait"))
        stats = rows.groupBy("group").agg(*sums)
        stats = cut(stats.join(means, F.col("group").eqNullSafe(F.col("__g")), "left").drop("__g"))
    else:
        stats = cut(rows.groupBy("group").agg(*sums, F.min("trait").alias("trait")))
    number, total = stats.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    named = F.concat(F.lit("g:"), F.coalesce("group", F.lit("\0")))
    if number > most_units:
        named = F.when(F.col("n") * most_units >= 2 * total, named).otherwise(F.concat(F.lit("b:"), F.pmod(F.xxhash64("group"), F.lit(most_units // 2)).cast("string")))
    stats = stats.withColumn("unit", named)
    by = stats.groupBy("unit").agg(*(F.sum(c).alias(c) for c in ("n", "label_sum", "label_count", "label_squares")), F.count("*").alias("groups"), F.max_by("trait", F.struct("n", "group")).alias("trait"))
    return by, stats.select("group", "unit")


def search(by: DataFrame, ratios: tuple = (0.8, 0.1, 0.1), seed: int = 42, size_weight: float = 1.0, groups_weight: float = 0.15, label_weight: float = 0.0, kind: str | None = None, leakage_weight: float = 0.0, pair_weights: tuple = (0.5, 1.0, 0.5), restarts: int = 8, passes: int = 64) -> DataFrame:
    """(restart, dealt, cost, unit, split) of every restart over ``units``: its cost when dealt and at last.

    Restarts run side by side, each on a copy of the units' statistics.
    """
    if any(not r >= 0 for r in ratios) or not 0 < sum(ratios) < float("inf"):
        raise ValueError("ratios must be non-negative with a positive sum")
    spark = by.sparkSession

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit", ignore_index=True)
        pdf = pdf.iloc[np.lexsort([pdf.unit, pdf.h, -pdf.n])].reset_index(drop=True)
        s, c, q = pdf.label_sum.sum(), pdf.label_count.sum(), pdf.label_squares.sum()
        spread = (s / c, max(np.sqrt(max(q / c - (s / c) ** 2, 1e-12)), 1e-6)) if c > 0 else None
        similar = SIMILAR[kind](list(pdf.trait)) if kind and leakage_weight > 0 else None
        one = Search(pdf.n.to_numpy(), pdf.groups.to_numpy(), pdf.label_sum.to_numpy(), pdf.label_count.to_numpy(), spread, similar, ratios, (size_weight, groups_weight, label_weight, leakage_weight), pair_weights)
        dealt, cost = one.run(np.arange(len(pdf)), passes)
        return pd.DataFrame({"restart": pdf.restart, "dealt": dealt, "cost": cost, "unit": pdf.unit, "split": [NAMES[i] for i in one.at]})

    tries = spark.range(restarts).select(F.col("id").cast("int").alias("restart"))
    each = by.crossJoin(F.broadcast(tries)).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "restart", F.expr("substring(unit, 3)"))))  # a few restarts
    return each.groupBy("restart").applyInPandas(run, "restart int, dealt double, cost double, unit string, split string")


def best(tried: DataFrame) -> DataFrame:
    """(unit, split, cost) of the restart of least cost; costs within 1e-9 are equal, the first of them wins."""
    first = tried.groupBy("restart").agg(F.min("cost").alias("cost"))
    first = first.agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "restart")).alias("b")).select("b.restart")
    return tried.join(F.broadcast(first), "restart").select("unit", "split", "cost")  # one row


def assign(df: DataFrame, key: str, group: str, target: Column | None = None, trait: Column | None = None, kind: str | None = None, most_units: int = MOST_UNITS, **how) -> DataFrame:
    """(key, group, split): every row of ``df`` with the split of its group; see ``search`` for what decides.

    A null group is a group. An empty table gives none. Repeated keys are rows like others.
    """
    by, named = units(df, group, target, trait, kind, most_units)
    dealt = cut(named.join(best(search(by, kind=kind, **how)), "unit").select(F.col("group").alias("__g"), "split"))
    dealt = F.broadcast(dealt) if dealt.count() <= MOST_BROADCAST else dealt
    return df.select(key, group).join(dealt, F.col(group).cast("string").eqNullSafe(F.col("__g"))).drop("__g")
