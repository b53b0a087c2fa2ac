"""Density clustering (DBSCAN), exact, over a grid of cells.

Points lie in cells of side eps along the three coordinates of largest spread (all, if there are fewer), so
that whatever is within eps of a point lies in its own or a neighbouring cell; distances are taken in all
coordinates. Cells of many points are dealt into tiles, and pairs of tiles of neighbouring cells are
compared in numpy in blocks, each in a group of its own: work grows with the points within reach of each
other, but no group with the data. Where cells hold most points, tiles grow with them, up to MOST_TILE
points, so that up to TILES times that a point is sent to a bounded number of pairs. Equal vectors are one point with a weight, so copies cost nothing.

A first pass over the pairs of tiles counts what is within eps, which decides core points; a second one
links core points, and what comes out of a pair is a star for each local cluster, not all links. Clusters
are the connected components of these.

A point is a core point if points of weight ``min_samples`` or more, itself included, lie within ``eps``
(eps itself included). A cluster is named by its least core key. A border point, within eps of a core
point, goes to the cluster of the least name among those it touches; any other point is noise: null. Rows
whose vector is null or has a null or a value that is not finite are noise too; empty tables stay empty.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.operators.graph import components
from ferrolith.operators.ordered import cut

TILE = 1024
#: Tiles of all points, unless they would hold over MOST_TILE points.
TILES, MOST_TILE = 12, 16_384
GRID = 3


def _within(a: np.ndarray, b: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows of ``a`` and ``b`` at a distance of ``eps`` at most; told by products, decided by differences."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    slack = 1e-9 * (1 + np.abs(a).max(initial=0) + np.abs(b).max(initial=0)) ** 2 * a.shape[1]
    i, j = np.nonzero(square <= eps * eps + slack)
    keep = np.concatenate([np.zeros(0, bool), *(np.sqrt(((a[i[s : s + 50_000]] - b[j[s : s + 50_000]]) ** 2).sum(1)) <= eps for s in range(0, len(i), 50_000))])
    return i[keep], j[keep]


def _blocks(a: np.ndarray, b: np.ndarray, eps: float):
    """``_within``, in blocks of rows of both."""
    for s in range(0, len(a), TILE):
        for t in range(0, len(b), TILE):
            i, j = _within(a[s : s + TILE], b[t : t + TILE], eps)
            yield i + s, j + t


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The two tiles of a pair; one and the same if it is a tile with itself."""
    left = pdf[pdf.side == 0].reset_index(drop=True)
    right = pdf[pdf.side == 1].reset_index(drop=True)
    return left, right if len(right) else left


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The roots of all, once i and j are linked."""
    pairs = np.unique(np.stack([root[i], root[j]], 1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    if not len(pairs):
        return root
    above = np.arange(len(root))

    def find(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for x, y in pairs.tolist():
        above[find(x)] = find(y)
    while (above[above] != above).any():
        above = above[above]
    return above[root]


def dbscan(df: DataFrame, key: str, vector: str, eps: float = 0.5, min_samples: int = 5, tile: int | None = None) -> DataFrame:
    """(key: long and distinct, cluster, core); see the module for what decides."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    points = cut(rows.where(sound).groupBy("v").agg(F.min("key").alias("p"), F.count("*").alias("w")))
    tile = tile or min(max(TILE, -(-points.count() // TILES)), MOST_TILE)
    spread = points.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("s")).orderBy(F.desc("s"), "i").limit(GRID).collect()
    axes = [r.i for r in spread] or [0]
    cells = [f"c{k}" for k in range(len(axes))]
    placed = points.select("*", *(F.floor(F.get("v", F.lit(i)) / eps).alias(c) for i, c in zip(axes, cells, strict=True)))
    tiles = placed.groupBy(*cells).agg(F.ceil(F.count("*") / tile).alias("tiles"))
    placed = cut(placed.join(tiles, cells).withColumn("t", F.pmod(F.xxhash64("p"), "tiles")))
    tiles = cut(tiles)
    around = F.array(*(F.struct(*(F.lit(o).cast("long").alias(c) for o, c in zip(offset, cells, strict=True))) for offset in product((-1, 0, 1), repeat=len(axes)) if offset >= (0,) * len(axes)))  # half of the neighbours, and itself
    near = tiles.select("*", F.explode(around).alias("o")).select(*cells, "tiles", *((F.col(c) + F.col(f"o.{c}")).alias(f"n_{c}") for c in cells))
    other = tiles.select(*(F.col(c).alias(f"n_{c}") for c in cells), F.col("tiles").alias("n_tiles"))
    pairs = near.join(other, [f"n_{c}" for c in cells])
    pairs = pairs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("t")).select(*cells, *(f"n_{c}" for c in cells), "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tiles") - 1)).alias("n_t"))
    here, there = F.struct(*cells, "t"), F.struct(*(F.col(f"n_{c}").alias(c) for c in cells), F.col("n_t").alias("t"))
    pairs = pairs.select(here.alias("a"), there.alias("b"))
    same = F.col("a") == F.col("b")
    one_cell = F.struct(*(F.col(f"a.{c}") for c in cells)) == F.struct(*(F.col(f"b.{c}") for c in cells))
    pairs = pairs.where(~one_cell | (F.col("a.t") <= F.col("b.t"))).withColumn("pair", F.concat_ws("|", *(F.col(f"{s}.{c}") for s in "ab" for c in (*cells, "t"))))
    sides = F.explode(F.when(same, F.array(F.struct(F.col("a").alias("at"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("at"), F.lit(0).alias("side")), F.struct(F.col("b").alias("at"), F.lit(1).alias("side")))))
    ends = cut(pairs.select("pair", sides.alias("s")).select("pair", "s.side", *(F.col(f"s.at.{c}").alias(c) for c in (*cells, "t"))))

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(pdf)
        if right is not left and (not len(left) or pdf.side.nunique() < 2):
            return pd.DataFrame({"p": [], "n": []})
        here, there = np.zeros(len(left)), np.zeros(len(right))
        for i, j in _blocks(np.array(left.v.tolist()), np.array(right.v.tolist()), eps):
            here += np.bincount(i, right.w.to_numpy()[j], len(left))
            there += np.bincount(j, left.w.to_numpy()[i], len(right))
        out = pd.DataFrame({"p": left.p, "n": here.astype(int)})
        return out if right is left else pd.concat([out, pd.DataFrame({"p": right.p, "n": there.astype(int)})])

    met = placed.join(ends, [*cells, "t"])
    totals = met.select("pair", "side", "p", "w", "v").groupBy("pair").applyInPandas(counted, "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))
    cores = cut(totals.select("p", (F.col("n") >= min_samples).alias("core")))

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(pdf)
        if not len(left):
            return pd.DataFrame({"p": [], "q": [], "core": []})
        both = left if right is left else pd.concat([left, right], ignore_index=True)
        p, core, root, touch = both.p.to_numpy(), both.core.to_numpy(bool), np.arange(len(both)), np.zeros((0, 2), int)
        for i, j in _blocks(np.array(left.v.tolist()), np.array(right.v.tolist()), eps):
            j = j + (0 if right is left else len(left))
            root = _joined(root, i[core[i] & core[j]], j[core[i] & core[j]])
            edge, heart = np.concatenate([i[~core[i] & core[j]], j[core[i] & ~core[j]]]), np.concatenate([j[~core[i] & core[j]], i[core[i] & ~core[j]]])
            touch = np.unique(np.concatenate([touch, np.stack([edge, root[heart]], 1)]), axis=0)
        touch = np.unique(np.stack([touch[:, 0], root[touch[:, 1]]], 1), axis=0)
        stars = np.flatnonzero(core & (root != np.arange(len(both))))
        return pd.DataFrame({"p": np.concatenate([p[stars], p[touch[:, 0]]]), "q": np.concatenate([p[root[stars]], p[touch[:, 1]]]), "core": np.repeat([True, False], [len(stars), len(touch)])})

    found = cut(met.join(cores, "p").select("pair", "side", "p", "w", "v", "core").groupBy("pair").applyInPandas(linked, "p long, q long, core boolean"))
    grouped = components(found.where("core").select(F.col("p").alias("a"), F.col("q").alias("b")))
    of_core = cores.where("core").join(grouped, F.col("p") == F.col("node"), "left").select("p", F.coalesce("root", "p").alias("cluster"))
    border = found.where("not core").join(of_core.withColumnRenamed("p", "q"), "q").groupBy("p").agg(F.min("cluster").alias("cluster"))
    told = cores.join(of_core.unionAll(border), "p", "left").join(points.select("p", "v"), "p")
    told = told.select(F.col("v").alias("__v"), "cluster", "core")
    return rows.join(told, rows["v"] == F.col("__v"), "left").select(F.col("key").alias(key), "cluster", F.coalesce("core", F.lit(False)).alias("core"))
