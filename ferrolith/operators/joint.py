"""Joint drift of several properties: the energy distance of whole tables with a permutation test.

The energy distance of vectors is a constant times the mean, over directions, of the energy distance of
their projections, and that of numbers is an integral over sorted values of what lies below on either
side. So rows are projected on fixed random directions and range-sorted once; running counts give the
statistic and, in the same pass, that of every permutation, whose labels come from a hash of the row. No
pair of rows is made and no side is drawn from: all rows count. What the driver adds up is a row of sums for
each range of a direction.

Labels of a permutation are drawn independently with the old side's share, by multiplicative hashing of 32
bits of a row's MD5, so that reruns and other layouts agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.numeric import finite
from ferrolith.operators.ordered import cut

DIRECTIONS, PERMUTATIONS = 32, 199
#: Rows of one direction that a range holds, and rows whose labels are counted at a time.
RANGE_ROWS, STEP = 1_000_000, 4096


def directions(count: int, d: int, seed: int = 0) -> np.ndarray:
    """Unit vectors, evenly spread; for one dimension just one."""
    v = np.random.default_rng(seed).normal(size=(count if d > 1 else 1, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def multipliers(count: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed + 1).integers(0, 1 << 31, count) * 2 + 1


def spread(d: int) -> float:
    """How many times the length of a vector is its mean projection."""
    return math.sqrt(math.pi) * math.exp(math.lgamma((d + 1) / 2) - math.lgamma(d / 2))


def features(old: DataFrame, new: DataFrame, properties: list[str], key: str) -> tuple[DataFrame, list[str]]:
    """(side, u, one column for each feature) and the features: medians for what is missing, what was missing as 0 or 1, both standardized.

    Center and scale are the median and 1.4826 MAD of both sides together, or the standard deviation if the
    MAD is 0; features of one value are left out, as are properties that are missing everywhere.
    """
    side = lambda df, s: df.select(F.lit(s).alias("side"), F.conv(F.substring(F.md5(F.concat(F.lit(f"{s}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long").alias("u"), *(finite(F.col(p).cast("double")).alias(f"x{i}") for i, p in enumerate(properties)))
    both = cut(side(old, 0).unionAll(side(new, 1)))
    names = [f"x{i}" for i in range(len(properties))]
    middle = both.agg(*(F.median(n).alias(n) for n in names)).first()
    names = [n for n in names if middle[n] is not None]
    filled = both.select("side", "u", *(F.coalesce(n, F.lit(middle[n])).alias(n) for n in names), *(F.col(n).isNull().cast("double").alias(f"{n}_missing") for n in names))
    names += [f"{n}_missing" for n in names]
    if not names:
        return filled, []
    said = filled.agg(*(F.var_pop(n).alias(f"v_{n}") for n in names), *(F.median(n).alias(f"m_{n}") for n in names)).first()
    names = [n for n in names if (said[f"v_{n}"] or 0) > 1e-12]
    if not names:
        return filled, []
    mads = filled.agg(*(F.median(F.abs(F.col(n) - said[f"m_{n}"])).alias(n) for n in names)).first()
    scale = {n: 1.4826 * mads[n] if 1.4826 * mads[n] > 1e-8 else math.sqrt(said[f"v_{n}"]) if math.sqrt(said[f"v_{n}"]) > 1e-8 else 1.0 for n in names}
    return filled.select("side", "u", *(((F.col(n) - said[f"m_{n}"]) / scale[n]).alias(n) for n in names)), names


def _labels(side: np.ndarray, u: np.ndarray, by: np.ndarray, share: float) -> np.ndarray:
    """Which rows count as old: as they are, and in each permutation."""
    drawn = (u.astype(np.uint64)[:, None] * by.astype(np.uint64)[None] & np.uint64(0xFFFFFFFF)) < np.uint64(int(share * 2**32))
    return np.concatenate([(side == 0)[:, None], drawn], axis=1)


def energies(sorted_rows: DataFrame, by: np.ndarray, n_old: int, n_new: int) -> np.ndarray:
    """The one-dimensional energy distances (direction, permutation; permutation 0 is as it is) of rows (k, z, side, u) sorted in ranges."""
    share = n_old / (n_old + n_new)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches cut where the direction changes, with their place in the task."""
        for b in batches:
            k = b.k.to_numpy()
            edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)] if len(k) else [0]
            for low, high in zip(edges, edges[1:], strict=False):
                for s in range(low, high, STEP):
                    yield b.iloc[s : min(s + STEP, high)]

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, found = TaskContext.get().partitionId(), {}
        for b in runs(batches):
            n, old, first = found.get(b.k.iloc[0], (0, 0, b.z.iloc[0]))
            found[b.k.iloc[0]] = (n + len(b), old + _labels(b.side.to_numpy(), b.u.to_numpy(), by, share).sum(axis=0), first)
        yield pd.DataFrame([(k, part, n, list(map(int, old)), first) for k, (n, old, first) in found.items()], columns=["k", "part", "n", "old", "first"])

    parts = sorted(map(tuple, sorted_rows.mapInPandas(totals, "k int, part int, n long, old array<long>, first double").collect()))
    count = max((p[0] for p in parts), default=-1) + 1
    olds = np.sum([p[3] for p in parts if p[0] == 0], axis=0) if parts else np.zeros(len(by) + 1)
    before, at, seen = {}, np.zeros(len(by) + 1, int), 0
    for i, (k, part, n, old, _) in enumerate(parts):
        if not i or parts[i - 1][0] != k:
            at, seen = np.zeros(len(by) + 1, int), 0
        before[k, part] = (at, seen, parts[i + 1][4] if i + 1 < len(parts) and parts[i + 1][0] == k else None)
        at, seen = at + np.array(old), seen + n
    shared = sorted_rows.sparkSession.sparkContext.broadcast((before, olds, n_old + n_new))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, (before, olds, n) = TaskContext.get().partitionId(), shared.value
        now, out, waiting = {}, {}, None

        def add(k: int, z: np.ndarray, after: float | None, labels: np.ndarray) -> None:
            at, seen, _ = now.get(k) or before[k, part]
            c = at + np.cumsum(labels, axis=0)
            place = seen + np.arange(1, len(z) + 1)
            gap = np.append(np.diff(z), 0 if after is None else after - z[-1])[:, None]
            f, g = c / np.maximum(olds, 1), (place[:, None] - c) / np.maximum(n - olds, 1)
            add = np.stack([(gap * (f * (1 - g) + g * (1 - f))).sum(0), (gap * 2 * f * (1 - f)).sum(0), (gap * 2 * g * (1 - g)).sum(0)])
            out[k] = out.get(k, 0) + add
            now[k] = (c[-1], int(place[-1]), None)

        for b in runs(batches):  # a run waits for the next one, whose first value ends its last gap
            k, z = int(b.k.iloc[0]), b.z.to_numpy()
            if waiting:
                add(waiting[0], waiting[1], z[0] if waiting[0] == k else before[waiting[0], part][2], waiting[2])
            waiting = (k, z, _labels(b.side.to_numpy(), b.u.to_numpy(), by, share))
        if waiting:
            add(waiting[0], waiting[1], before[waiting[0], part][2], waiting[2])
        yield pd.DataFrame([(k, v.ravel().tolist()) for k, v in out.items()], columns=["k", "s"])

    got = np.zeros((count, 3, len(by) + 1))
    for k, s in sorted_rows.mapInPandas(sums, "k int, s array<double>").collect():
        got[k] += np.array(s).reshape(3, -1)
    m = n_old + n_new - olds
    bias = lambda c: np.where(c > 1, c / np.maximum(c - 1, 1), 0)
    return np.where((olds > 1) & (m > 1), 2 * got[:, 0] - got[:, 1] * bias(olds) - got[:, 2] * bias(m), 0)


def joint_drift(old: DataFrame, new: DataFrame, properties: list[str], key: str, count: int = DIRECTIONS, permutations: int = PERMUTATIONS, alpha: float = 0.05, effect: float = 0.2, min_samples: int = 16, seed: int = 0) -> DataFrame:
    """One row: n_old, n_new, n_features, energy_distance, pvalue, alert, reason (why it was skipped, else null).

    alert: a p-value of ``alpha`` or less and an energy distance of ``effect`` or more. Fewer rows on a side
    than ``min_samples``, or no feature that varies, leave all but the counts null and no alert.
    """
    spark = old.sparkSession
    rows, names = features(old, new, properties, key) if properties else (None, [])
    n = {s: c for s, c in rows.groupBy("side").count().collect()} if rows is not None else {}
    n_old, n_new = n.get(0, 0), n.get(1, 0)
    kind = "n_old long, n_new long, n_features int, energy_distance double, pvalue double, alert boolean, reason string"
    why = "no properties" if not properties else "few rows" if min(n_old, n_new) < max(4, min_samples) else None if names else "no feature varies"
    if why:
        return spark.createDataFrame([(n_old, n_new, len(names), None, None, False, why)], kind)
    to = directions(count, len(names), seed)
    shot = F.array(*(sum((F.col(f) * float(w) for f, w in zip(names, v, strict=True)), F.lit(0.0)) for v in to))
    order = ["k", "z", "u", "side"]
    long = rows.select("side", "u", F.posexplode(shot).alias("k", "z"))
    ranged = long.repartitionByRange(max(len(to), -(-(n_old + n_new) * len(to) // RANGE_ROWS)), *order).sortWithinPartitions(*order)
    each = energies(cut(ranged.select(*order)), multipliers(permutations, seed), n_old, n_new)
    d = np.maximum(spread(len(names)) * each.mean(axis=0), 0)
    p = (1 + int((d[1:] >= d[0] - 1e-12).sum())) / (permutations + 1)
    return spark.createDataFrame([(n_old, n_new, len(names), float(d[0]), p, bool(p <= alpha and d[0] >= effect), None)], kind)
