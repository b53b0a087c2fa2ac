"""Multi-objective ranking (larger is better): fronts, crowding, hypervolume, diverse selection.

A front is found in two steps: each task keeps its own rows' front, then what is left of all tasks
is compared. Only that second, far smaller set meets in one place, where it is compared in blocks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.operators.ordered import cut

BLOCK = 512
#: Rows that are ranked together in a task: of one task's own, and of all tasks in a round (one front at least).
MOST_LOCAL, MOST_MERGED = 200_000, 500_000


def dominated(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which of ``points`` are nowhere better and somewhere worse than one of ``by``; in blocks."""
    out = np.zeros(len(points), bool)
    for i in range(0, len(points), BLOCK):
        p = points[i : i + BLOCK]
        for j in range(0, len(by), BLOCK):
            q = by[j : j + BLOCK]
            out[i : i + BLOCK] |= ((q[None] >= p[:, None]).all(axis=2) & (q[None] > p[:, None]).any(axis=2)).any(axis=1)
    return out


def front_mask(points: np.ndarray) -> np.ndarray:
    """The rows that none dominates; rows are tried best sum first, against the front so far."""
    order = np.argsort(-points.sum(axis=1), kind="stable")
    kept: list[np.ndarray] = []
    mask = np.zeros(len(points), bool)
    for i in range(0, len(order), BLOCK):
        some = order[i : i + BLOCK]
        p = points[some]
        alive = ~dominated(p, np.concatenate([*kept, p]))
        mask[some[alive]] = True
        kept.append(p[alive])
    return mask


def pareto_front(df: DataFrame, objectives: list[str]) -> DataFrame:
    """The rows that no other dominates; rows with a missing objective are left out."""
    finite = df.where(" and ".join(f"{o} is not null and not isnan(cast({o} as double))" for o in objectives))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for b in batches:
            kept = b if kept is None else pd.concat((kept, b))
            kept = kept[front_mask(kept[objectives].to_numpy(float))]
        if kept is not None:
            yield kept

    return finite.mapInPandas(local, df.schema).repartition(1).mapInPandas(local, df.schema)  # a shuffle: coalesce would run the first step in one task too


def _layers(x: np.ndarray, most: int | None = None) -> np.ndarray:
    """The front of each row among these rows; with ``most``, that for all from there on.

    Up to three objectives: rows come best first by the first one, so that a row is in the first front
    where none of the rows so far is as good in the other two. A front keeps its staircase of these, and
    as who is dominated in one front is so in all before it, both are found by bisection.
    """
    most = len(x) if most is None else most
    if x.shape[1] > 3:
        rank, left = np.full(len(x), most), np.arange(len(x))
        for level in range(most):
            if not len(left):
                break
            best = front_mask(x[left])
            rank[left[best]] = level
            left = left[~best]
        return rank
    x = np.hstack([x, np.zeros((len(x), 3 - x.shape[1]))])
    rank, order = np.zeros(len(x), int), np.lexsort((-x[:, 2], -x[:, 1], -x[:, 0]))
    stairs: list[tuple[list[float], list[float]]] = []
    last, level = None, 0
    for i, p in zip(order.tolist(), x[order].tolist(), strict=True):
        if p != last:  # equal rows share a front
            last, (_, b, c) = p, p
            level, high = 0, len(stairs)
            while level < high:
                mid = (level + high) // 2
                bs, cs = stairs[mid]
                at = bisect_left(bs, b)
                if at < len(bs) and cs[at] >= c:
                    level = mid + 1
                else:
                    high = mid
            if level < most:
                if level == len(stairs):
                    stairs.append(([], []))
                bs, cs = stairs[level]
                high = low = bisect_right(bs, b)
                while low and cs[low - 1] <= c:
                    low -= 1
                bs[low:high], cs[low:high] = [b], [c]
        rank[i] = level
    return rank


def fronts(df: DataFrame, objectives: list[str], key: str, most_merged: int = MOST_MERGED) -> DataFrame:
    """(key, front): 0 for the first front, and so on; rows with a missing or infinite objective come last.

    A row's front among some of the rows is never later than among all. So tasks rank their own rows, and a
    round takes as many of these local fronts as hold ``most_merged`` rows, one at least, ranks these rows
    together, and has as many fronts of all rows; they are taken out before the next round. Rounds grow with
    the rows over ``most_merged``, not with the fronts.
    """
    numbers = df.select(F.col(key), *(F.col(o).cast("double").alias(f"__o{i}") for i, o in enumerate(objectives))).withColumn("__row", F.monotonically_increasing_id())
    table = cut(numbers)
    names = [f"__o{i}" for i in range(len(objectives))]
    good = F.lit(True)
    for n in names:
        good = good & F.coalesce(F.abs(n) < float("inf"), F.lit(False))
    left, bad = table.where(good), table.where(~good)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some, n = [], 0
        for b in batches:
            some, n = [*some, b], n + len(b)
            if n >= MOST_LOCAL:
                yield ranked(pd.concat(some))
                some, n = [], 0
        if n:
            yield ranked(pd.concat(some))

    def ranked(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(__local=_layers(rows[names].to_numpy(float)))

    kind = df.schema[key].dataType.simpleString()
    found, level = [], 0
    while True:
        own = cut(left.mapInPandas(local, f"`{key}` {kind}, {', '.join(f'{n} double' for n in names)}, __row long, __local long"))
        take, rows = 0, 0
        for r in own.groupBy("__local").agg(F.count("*").alias("n")).orderBy("__local").collect():  # a row for each local front
            if take and rows + r.n > most_merged:
                break
            take, rows = take + 1, rows + r.n
        if not take:
            break

        def merged(batches: Iterator[pd.DataFrame], take: int = take) -> Iterator[pd.DataFrame]:
            if some := list(batches):
                rows = pd.concat(some)
                rank = _layers(rows[names].to_numpy(float), take)
                yield pd.DataFrame({key: rows[key], "front": rank.astype(np.int32), "__row": rows["__row"]})[rank < take]

        some = cut(own.where(F.col("__local") < take).repartition(1).mapInPandas(merged, f"`{key}` {kind}, front int, __row long"))
        found.append(some.select(key, (F.col("front") + level).cast("int").alias("front")))
        level += some.agg(F.max("front")).first()[0] + 1
        left = cut(left.join(some.select("__row"), "__row", "left_anti").select(*left.columns))
    out = bad.select(key, F.lit(level).cast("int").alias("front"))
    for f in found:
        out = out.unionAll(f)
    return out


def crowding(df: DataFrame, objectives: list[str], front: str, tie: str) -> DataFrame:
    """``df`` with ``crowding``: the sum over objectives of the gap between neighbours in the front; NULL at its ends."""
    out = df
    for o in objectives:
        w = Window.partitionBy(front).orderBy(o, tie)
        whole = Window.partitionBy(front)
        span = F.max(o).over(whole) - F.min(o).over(whole)
        out = out.withColumn(f"__c_{o}", F.when(F.lag(o).over(w).isNull() | F.lead(o).over(w).isNull(), None).when(span > 0, (F.lead(o).over(w) - F.lag(o).over(w)) / span).otherwise(0.0))
    return out.withColumn("crowding", sum(F.col(f"__c_{o}") for o in objectives)).drop(*(f"__c_{o}" for o in objectives))


def hypervolume_2d(df: DataFrame, x: str, y: str, ref: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """One row: the area between the front and ``ref``. A strip at each x as high as the best y from there on."""
    inside = df.where((F.col(x) > ref[0]) & (F.col(y) > ref[1])).groupBy(x).agg(F.max(y).alias("y"))
    front = pareto_front(inside, [x, "y"])  # the staircase alone is sorted in one place
    w = Window.orderBy(x)
    strip = front.withColumn("area", (F.col(x) - F.coalesce(F.lag(x).over(w), F.lit(ref[0]))) * (F.max("y").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)) - ref[1]))
    return strip.agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("hypervolume"))


def hypervolume(df: DataFrame, objectives: list[str], ref: list[float], top: list[float], probes: int = 4096, seed: int = 0) -> float:
    """By probes of the box from ``ref`` to ``top``: the covered share of ``probes`` seeded points, times the box."""
    points = np.random.default_rng(seed).uniform(ref, top, (probes, len(objectives)))

    def covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hit = np.zeros(probes, bool)
        for b in batches:
            x = b.to_numpy(float)
            for i in range(0, len(x), BLOCK):
                hit |= (x[i : i + BLOCK, None] >= points[None]).all(axis=2).any(axis=0)
        yield pd.DataFrame({"probe": np.flatnonzero(hit)})

    n = df.select(*objectives).dropna().mapInPandas(covered, "probe long").distinct().count()
    return n / probes * float(np.prod(np.subtract(top, ref)))


def rank_score(df: DataFrame) -> DataFrame:
    """``df`` (front, crowding) with ``rank_score``: 1 / (1 + front) * (.75 + .25 * crowding share), over its maximum."""
    top = df.agg(F.max("crowding").alias("__top"))
    share = F.coalesce(F.least(F.try_divide(F.col("crowding"), F.col("__top")), F.lit(1.0)), F.lit(1.0))
    raw = df.crossJoin(F.broadcast(top)).withColumn("__raw", (0.75 + 0.25 * share) / (1 + F.col("front")))  # one row
    best = raw.agg(F.max("__raw").alias("__best"))
    return raw.crossJoin(F.broadcast(best)).withColumn("rank_score", F.col("__raw") / F.col("__best")).drop("__top", "__raw", "__best")  # one row


def select_diverse(df: DataFrame, score: str, key: str, vector: str, k: int, weight: float = 0.5) -> DataFrame:
    """k rows, each the best of all by score less ``weight`` times the highest cosine to those chosen; ties to the higher score, then the smaller key.

    k rounds, in each of which every task offers its best row.
    """
    table = df.select(F.col(key).alias("key"), F.col(score).cast("double").alias("score"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    chosen: list = []
    points: list = []

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = []
        for t in batches:
            t = t[~t.key.isin(chosen)]
            if len(t):
                x = np.array(t.v.tolist(), float).reshape(len(t), -1)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                near = np.maximum((x @ np.array(points).T).max(axis=1), 0.0) if points else 0.0
                t = t.assign(value=t.score - weight * near, v=list(x))
                kept.append(t.sort_values(["value", "score", "key"], ascending=[False, False, True]).head(1))
        if kept:
            yield pd.concat(kept)[["key", "score", "v", "value"]]

    kind = df.schema[key].dataType.simpleString()
    for _ in range(k):
        offered = table.mapInPandas(best, f"key {kind}, score double, v array<double>, value double")
        got = offered.orderBy(F.desc("value"), F.desc("score"), "key").limit(1).collect()
        if not got:
            break
        chosen.append(got[0].key)
        points.append(list(got[0].v))
    return df.sparkSession.createDataFrame([(int(c), i) for i, c in enumerate(chosen)], f"{key} long, pick int")


def k_center(df: DataFrame, key: str, vector: str, k: int, first: int | None = None, kept_rounds: int = 8) -> DataFrame:
    """Greedy k-center: k rounds, each a distributed maximum of the distance to the chosen, ties to the smaller key.

    A row keeps its distance to the nearest centre; centres since the last ``kept_rounds`` are in the
    plan, older ones in that distance, so that neither the plan nor a round's work grows with k.
    """
    start = df.agg(F.min(key)).first()[0] if first is None else first
    chosen, points = [start], [df.where(F.col(key) == start).select(vector).first()[0]]
    state = df.select(F.col(key).alias("key"), F.transform(vector, lambda v: v.cast("double")).alias("v"), F.lit(float("inf")).alias("near"))

    def nearest(centres: list) -> Column:
        gaps = [F.aggregate(F.zip_with("v", F.array(*(F.lit(float(c)) for c in p)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d) for p in centres]
        return F.least(F.col("near"), *gaps)

    for _ in range(k - 1):
        if len(points) == kept_rounds:
            state, points = cut(state.withColumn("near", nearest(points))), []
        offered = state.where(~F.col("key").isin(chosen)).select(F.struct(nearest(points).alias("d") if points else F.col("near").alias("d"), (-F.col("key")).alias("k")).alias("s"), "v")
        best = offered.agg(F.max_by("v", "s").alias("v"), F.max("s").alias("s")).first()
        if best.s is None:
            break
        chosen.append(-best.s.k)
        points.append(list(best.v))
    return df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(chosen)], f"{key} long, pick int")
