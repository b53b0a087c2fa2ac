"""Exact nearest neighbours by cosine: pivots, bounds from the triangle inequality, blocks dealt by pivot.

On unit vectors the largest cosine is the least distance. References belong to the nearest of some pivots,
which are references themselves; a cell has a radius. A query is no farther from its neighbour than from
the nearest pivot, so it only meets cells that can come that near: those whose pivot is within that bound
plus their radius. Cells are dealt in blocks of ``block`` references, and cells that many queries meet in
copies for shares of these, so that no group is larger than the two bounds. References are read twice (for
pivots and cells), queries once; equal vectors are one reference.

A vector of zeros has the cosine 0 to all. A query doesn't meet the reference of its own key. Null vectors
are no references, and queries with one, or without any reference, have null. Of equal cosines the least
key is the neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.operators.ordered import cut

BLOCK = 2048
MOST_PIVOTS = 4096
QUERIES = 20_000


def _units(vectors: pd.Series, query: bool) -> np.ndarray:
    """Unit vectors with two more places: a zero vector is one of them, another for queries than for references."""
    m = np.array(vectors.tolist(), float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    zero = norm[:, 0] <= 1e-12
    out = np.concatenate([m / np.where(norm > 1e-12, norm, 1), np.zeros((len(m), 2))], axis=1)
    out[zero] = 0
    out[zero, -1 - query] = 1
    return out


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * a @ b.T, 0))


def _distinct(references: DataFrame, key: str, vector: str) -> DataFrame:
    """(v, lo, second): each vector with its two least keys."""
    rows = references.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    found = cut(rows.groupBy("v").agg(F.min("k").alias("lo"), F.max("k").alias("hi")))
    again = rows.join(found.where("hi > lo").select("v", "lo"), "v").where("k > lo").groupBy("v").agg(F.min("k").alias("second"))
    return found.join(again, "v", "left").select("v", "lo", "second")


def nearest(queries: DataFrame, references: DataFrame, key: str, vector: str, block: int = BLOCK, pivots: int | None = None) -> DataFrame:
    """(key, nearest, neighbour) of each query: the highest cosine, and which reference has it."""
    spark, kind = queries.sparkSession, queries.schema[key].dataType.simpleString()
    refs = cut(_distinct(references, key, vector))
    n = refs.count()
    count = pivots or min(MOST_PIVOTS, -(-n // block))
    chosen = refs.orderBy(F.xxhash64("lo"), "lo").limit(count).toPandas()
    own = queries.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    if not n:
        return own.select(F.col("k").alias(key), F.lit(None).cast("double").alias("nearest"), F.lit(None).cast(kind).alias("neighbour"))
    at = spark.sparkContext.broadcast((_units(chosen.v, False), chosen.lo.to_numpy(), chosen.second.isna().to_numpy()))

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            far = _far(_units(b.v, False), at.value[0])
            cell = far.argmin(axis=1)
            yield b.assign(cell=cell.astype(int), far=far[np.arange(len(b)), cell])

    kept = cut(refs.mapInPandas(celled, f"v array<double>, lo {kind}, second {kind}, cell long, far double"))
    cells = kept.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # a row for each pivot
    radius = np.full(count, -np.inf)
    for r in cells:
        radius[r.cell] = r.radius
    reach = spark.sparkContext.broadcast(radius)

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b.v.notna()]
            units, keys, alone = at.value
            for s in range(0, len(b), 1000):
                part = b.iloc[s : s + 1000]
                far = _far(_units(part.v, True), units)
                other = np.where((part.k.to_numpy()[:, None] == keys[None]) & alone[None], np.inf, far)
                i, c = np.nonzero(far - reach.value[None] <= other.min(axis=1)[:, None] + 1e-7)
                yield pd.DataFrame({"k": part.k.to_numpy()[i], "v": part.v.to_numpy()[i], "cell": c})

    sent = cut(own.mapInPandas(routed, f"k {kind}, v array<double>, cell long"))
    shares = {r.cell: r["count"] for r in sent.groupBy("cell").count().collect()}  # a row for each pivot
    dealt = F.broadcast(spark.createDataFrame([(r.cell, -(-r.n // block), max(1, -(-shares.get(r.cell, 0) // QUERIES))) for r in cells], "cell long, blocks long, shares long"))
    whole = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = kept.join(dealt, "cell").select("cell", F.pmod(F.xxhash64("lo"), "blocks").alias("block"), whole("shares").alias("share"), "v", "lo", "second")
    right = sent.join(dealt, "cell").select("cell", whole("blocks").alias("block"), F.pmod(F.xxhash64("k"), "shares").alias("share"), "v", "k")

    def compared(refs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(refs) or not len(asked):
            return pd.DataFrame({"k": asked.k[:0], "c": [], "o": asked.k[:0]})
        refs = refs.sort_values("lo", ignore_index=True)
        units, out = _units(refs.v, False), []
        for s in range(0, len(asked), 1000):
            part = asked.iloc[s : s + 1000]
            c = np.round(_units(part.v, True) @ units.T, 12)
            mine = part.k.to_numpy()[:, None] == refs.lo.to_numpy()[None]
            c[mine & refs.second.isna().to_numpy()[None]] = -np.inf
            names = np.where(mine, refs.second.to_numpy()[None], refs.lo.to_numpy()[None])
            best = c.max(axis=1)
            names = [min(names[i][c[i] == best[i]]) if np.isfinite(best[i]) else None for i in range(len(part))]
            out.append(pd.DataFrame({"k": part.k.to_numpy(), "c": best, "o": names})[np.isfinite(best)])
        return pd.concat(out)

    by = ["cell", "block", "share"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(compared, f"k {kind}, c double, o {kind}")
    best = met.groupBy("k").agg(F.min(F.struct((-F.col("c")).alias("c"), "o")).alias("b"))
    return own.select("k").join(best, "k", "left").select(F.col("k").alias(key), (-F.col("b.c")).alias("nearest"), F.col("b.o").alias("neighbour"))
