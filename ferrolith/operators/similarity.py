"""Similarity to reference sets, between groups, and within a radius."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.operators import nearest


def nearest_cosine(df: DataFrame, reference: DataFrame, key: str, vector: str, block: int = nearest.BLOCK) -> DataFrame:
    """(key, nearest): the highest cosine to a row of the reference set other than itself; see ``nearest``."""
    return nearest.nearest(df, reference, key, vector, block).select(key, "nearest")


def group_means(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, mean array): elementwise means, summed before the shuffle."""
    long = df.select(group, F.posexplode(vector).alias("i", "v"))
    means = long.groupBy(group, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))


def group_similarity(df: DataFrame, group: str, vector: str, most_groups: int = 2000) -> DataFrame:
    """(a, b, cosine) of the mean vectors of every pair of groups; over ``most_groups`` groups are refused."""
    means = group_means(df, group, vector)
    rows = means.limit(most_groups + 1).collect()
    if len(rows) > most_groups:
        raise ValueError(f"over {most_groups} groups")
    rows.sort(key=lambda r: r[0])
    m = np.array([r["mean"] for r in rows], float).reshape(len(rows), -1)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    c = m @ m.T
    out = [(rows[i][0], rows[j][0], float(c[i, j])) for i in range(len(rows)) for j in range(i + 1, len(rows))]
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame(out, f"a {kind}, b {kind}, cosine double")


def set_jaccard(df: DataFrame, key: str, members: str) -> DataFrame:
    """(a, b, jaccard) of keys that share a member, by counting joined members. ``members`` is an array."""
    long = df.select(key, F.explode(F.array_distinct(members)).alias("m"), F.size(F.array_distinct(members)).alias("n"))
    pairs = long.alias("x").join(long.alias("y"), F.expr(f"x.m = y.m and x.{key} < y.{key}"))
    met = pairs.groupBy(F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(F.count("*").alias("shared"))
    return met.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def novelty(df: DataFrame, archive: DataFrame, key: str, vector: str, scale: float = 1.0) -> DataFrame:
    """(key, novelty): 1 - exp(-d^2 / (2 scale^2)) of unit vectors, d being the distance to the nearest in the archive."""
    near = nearest_cosine(df, archive, key, vector)
    square = F.greatest(2 - 2 * F.col("nearest"), F.lit(0.0))
    return near.select(key, F.coalesce(1 - F.exp(-square / (2 * scale * scale)), F.lit(1.0)).alias("novelty"))


def radius_neighbours(points: DataFrame, group: str, key: str, axes: list[str], radius: float, k: int) -> DataFrame:
    """(group, src, dst, distance): the k nearest others within the radius in the same group.

    Points fall into cells as wide as the radius; a point meets the points of its own and neighbouring
    cells alone, by an equi-join.
    """
    cell = [F.floor(F.col(a) / radius).alias(f"c_{a}") for a in axes]
    p = points.select(group, key, *axes, *cell)
    shifts = F.array(*(F.struct(*(F.lit(d).alias(f"d_{a}") for a, d in zip(axes, s, strict=True))) for s in product((-1, 0, 1), repeat=len(axes))))
    left = p.select(group, F.col(key).alias("src"), *(F.col(a).alias(f"x_{a}") for a in axes), *(F.col(f"c_{a}") for a in axes), F.explode(shifts).alias("s"))
    left = left.select(group, "src", *(f"x_{a}" for a in axes), *((F.col(f"c_{a}") + F.col(f"s.d_{a}")).alias(f"c_{a}") for a in axes))
    met = left.join(p.withColumnRenamed(key, "dst"), [group, *(f"c_{a}" for a in axes)]).where("src <> dst")
    d = F.sqrt(sum((F.col(f"x_{a}") - F.col(a)) * (F.col(f"x_{a}") - F.col(a)) for a in axes))
    w = Window.partitionBy(group, "src").orderBy("distance", "dst")
    return met.select(group, "src", "dst", d.alias("distance")).where(F.col("distance") <= radius).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def triplets(edges: DataFrame, group: str) -> DataFrame:
    """(group, src, a, b): pairs of different edges of one source; a source has at most k edges."""
    return edges.alias("x").join(edges.alias("y"), F.expr(f"x.{group} = y.{group} and x.src = y.src and x.dst <> y.dst")).select(f"x.{group}", "x.src", F.col("x.dst").alias("a"), F.col("y.dst").alias("b"))
