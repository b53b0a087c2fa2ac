"""Order-based operators: running sums over any number of rows, ranks, keep-last, top-k."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder; on one machine without one, in a temporary folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='checkpoints-')}")
    return df.checkpoint()


def _ranges(df: DataFrame, keys: list[str], order: str, buckets: int) -> DataFrame:
    """``df`` with ``__bucket``: which range of approximate quantiles of its key a row is in."""
    share = [i / buckets for i in range(1, buckets)]
    bounds = df.groupBy(*keys).agg(F.percentile_approx(order, share).alias("__bounds"))
    placed = df.join(bounds, keys) if keys else df.crossJoin(F.broadcast(bounds))  # without keys: one row
    return placed.withColumn("__bucket", F.size(F.filter("__bounds", lambda b: b < F.col(order)))).drop("__bounds")


def cumulative(df: DataFrame, keys: list[str], order: str, sums: dict[str, str], buckets: int = 64) -> DataFrame:
    """``df`` with running sums of ``sums`` (new name: column), by ``order`` (distinct within a key).

    A key's rows fall into ranges by approximate quantiles; windows run inside ranges, and the ranges'
    totals, at most ``buckets`` a key, give the offsets. No task gets a whole key. ``df`` is computed
    once and cut, as bounds, totals and windows all read it.
    """
    placed = _ranges(cut(df), keys, order, buckets)
    part = Window.partitionBy(*keys, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = placed.groupBy(*keys, "__bucket").agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__bucket", *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums))
    out = placed.join(offsets, [*keys, "__bucket"])
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(part) + F.col(f"__o_{n}"))
    return out.drop("__bucket", *(f"__o_{n}" for n in sums))


def with_next(df: DataFrame, keys: list[str], order: str, name: str, buckets: int = 64) -> DataFrame:
    """``df`` with the next greater ``order`` of the key (distinct within it), in ranges as in ``cumulative``."""
    placed = _ranges(cut(df), keys, order, buckets)
    firsts = placed.groupBy(*keys, "__bucket").agg(F.min(order).alias("__first"))
    after = firsts.select(*keys, "__bucket", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__bucket")).alias("__next"))
    inside = F.lead(order).over(Window.partitionBy(*keys, "__bucket").orderBy(order))
    return placed.join(after, [*keys, "__bucket"]).withColumn(name, F.coalesce(inside, F.col("__next"))).drop("__bucket", "__next")


def _tie(df: DataFrame, names: list[str]) -> Column:
    """A hash of the columns that can be hashed: all but maps."""
    return F.xxhash64(*(n for n in names if "map<" not in df.schema[n].dataType.simpleString()))


def keep_last(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row of the largest ``sequence`` for each key; a mergeable aggregate, not a sort of each key.

    Of equal sequences a hash of the row decides, so that reruns agree; a null sequence is the smallest.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(sequence, _tie(df, rest))).alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest)).select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row of the smallest ``sequence`` for each key; equal sequences as in ``keep_last``, a null one is the last choice."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(sequence).isNull(), sequence, _tie(df, rest))).alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest)).select(*df.columns)


def top_k(df: DataFrame, score: str, k: int, tie: str, descending: bool = True) -> DataFrame:
    """The k best; ties by ``tie``, ascending. Spark keeps k rows a partition."""
    return df.orderBy(F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last(), F.col(tie)).limit(k)


def top_k_per_group(df: DataFrame, group: str, score: Column, k: int, tie: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(score, F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def average_ranks(df: DataFrame, value: str, name: str = "rank", keys: list[str] | None = None) -> DataFrame:
    """``df`` with the mean rank (from 1) of each value, ties shared."""
    keys = keys or []
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ranked = cumulative(counted, keys, value, {"__last": "__n"}).select(*keys, value, (F.col("__last") - (F.col("__n") - 1) / 2).alias(name))
    return df.join(ranked, [*keys, value])


def rank_normalized(df: DataFrame, value: str, tie: str, name: str = "rank01") -> DataFrame:
    """(position - 1) / (n - 1), ties by ``tie``; 1 for a single row."""
    counted = cut(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n")))
    before = cumulative(counted, [], value, {"__last": "__n"}).select(value, (F.col("__last") - F.col("__n")).alias("__before"))
    n = counted.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__all"))
    placed = df.join(before, value).crossJoin(F.broadcast(n))  # one row
    at = F.col("__before") + F.row_number().over(Window.partitionBy(value).orderBy(tie)) - 1
    return placed.withColumn(name, F.when(F.col("__all") > 1, at / (F.col("__all") - 1)).otherwise(1.0)).drop("__before", "__all")
