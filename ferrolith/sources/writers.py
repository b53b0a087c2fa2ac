"""Sinks: tables, views, strict JSON reports and assignments, by Spark's commit protocol."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").format(format)
    writer = writer.option("header", True) if format == "csv" else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def sql(df: DataFrame, query: str, name: str = "materials") -> DataFrame:
    """Any SQL over the table as the view ``name``; never stale."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.sql(query)


def write_assignment(assigned: DataFrame, path: str, format: str = "csv") -> None:
    """Sorted by split and id across files."""
    write_table(assigned.orderBy("split", *[c for c in assigned.columns if c != "split"]), path, format)


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as strict JSON: NaN and infinities are null."""
    safe = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < math.inf), F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(safe).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def report_json(row: DataFrame) -> str:
    """A one-row report as sorted JSON."""
    return json.dumps(json.loads(json_rows(row).first()[0]), sort_keys=True)


def report_markdown(row: DataFrame, title: str) -> str:
    """A one-row report as a Markdown table."""
    values = json.loads(json_rows(row).first()[0])
    return "\n".join([f"# {title}", "", "| metric | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in sorted(values.items()))])


def write_iteration(candidates: DataFrame, path: str, iteration: int) -> None:
    """One JSON row of a round with its candidates, best first; a round's pool is bounded by the loop."""
    made = candidates.agg(F.count("*").alias("n_candidates"), F.sort_array(F.collect_list(F.struct("acquisition_value", *[c for c in candidates.columns if c != "acquisition_value"])), asc=False).alias("candidates"))
    made.withColumn("iteration", F.lit(iteration)).coalesce(1).write.mode("overwrite").json(path)


def final_report(candidates: DataFrame, k: int = 50) -> DataFrame:
    """The k best candidates over all rounds."""
    return candidates.orderBy(F.desc("acquisition_value"), "formula").limit(k)
