"""Structured Streaming: windowed drift against a baseline, and reliability counts kept across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_shift(stream: DataFrame, baseline: dict[str, tuple[float, float]], time: str, group: str, value: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, group, n, mean, shift): each window's mean against the group's baseline (mean, std)."""
    known = F.create_map(*(F.lit(x) for g, (m, s) in baseline.items() for x in (g, F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")))))
    t = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    by = t.groupBy(F.window("__t", window).alias("w"), F.col(group)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    b = F.try_element_at(known, F.col(group))
    return by.select(F.col("w.start").alias("start"), group, "n", "mean", (F.abs(F.col("mean") - b["m"]) / F.when(b["s"] > 1e-12, b["s"]).otherwise(1.0)).alias("shift"))


def keep_counts(stream: DataFrame, state_path: str, group: str, success: str):
    """A writer that adds each batch's successes and failures by group to a Parquet state, a folder for each batch.

    A batch that runs again writes the same folder, so that counts are exact.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(group).agg(F.sum(F.col(success).cast("long")).alias("successes"), F.sum(1 - F.col(success).cast("long")).alias("failures")).write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return stream.writeStream.foreachBatch(add)


def read_counts(spark, state_path: str, group: str) -> DataFrame:
    return spark.read.parquet(state_path).groupBy(group).agg((1 + F.sum("successes")).alias("alpha"), (1 + F.sum("failures")).alias("beta"))
