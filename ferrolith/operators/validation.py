"""Validation of a whole dataset: every check of rows in one scan, then the checks that need a shuffle, gates and a report.

Schema, provenance, units, trust and summaries are one aggregate whose partial sums merge; which rows are at
fault is one table from one scan. Duplicates are a count by key, leakage one by key and split, outliers by
ranges, drift by the operators of ``drift`` and ``joint``. Counts of nothing are 0, so that an empty table
passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.chem import present
from ferrolith.functions.numeric import finite
from ferrolith.operators import drift, joint, quality
from ferrolith.operators.ordered import cut

REQUIRED = ("jid", "atoms")
TIERS = ("raw", "curated", "benchmark")
#: Metrics that must be 0, that must be so if asked for, and in strict mode.
HARD = ("schema_violations", "provenance_missing", "leakage_count", "unit_violations")
STRICT = ("duplicate_count", "outlier_count", "drift_alert_count", "joint_drift_alert_count")


def faults(df: DataFrame, required: tuple = REQUIRED, units: dict[str, list[str]] | None = None) -> Column:
    """An array of (check, field, found) of a row: fields that it lacks, unknown provenance, units that are none of the property's."""
    kind = present(quality.column_or_null(df, "provenance_type"))
    fault = lambda check, field, found: F.struct(F.lit(check).alias("check"), F.lit(field).alias("field"), found.cast("string").alias("found"))
    none = F.lit(None).cast("string")
    each = [F.when(quality.column_or_null(df, c).isNull(), fault("schema", c, none)) for c in required]
    each.append(F.when(kind.isNotNull() & ~kind.isin(*quality.PROVENANCE), fault("schema", "provenance_type", kind)))
    each.append(F.when(kind.isNull() | ~kind.isin(*quality.PROVENANCE), fault("provenance", "provenance_type", kind)))
    for p, wanted in (units or {}).items():
        unit = F.coalesce(*(F.lower(present(quality.column_or_null(df, c))) for c in (f"{p}_unit", f"{p}_units", "unit", "units")))
        each.append(F.when(quality.column_or_null(df, p).isNotNull() & unit.isNotNull() & ~unit.isin(*(u.strip().lower() for u in wanted)), fault("unit", p, unit)))
    return F.array_compact(F.array(*each))


def violations(df: DataFrame, key: str = "jid", required: tuple = REQUIRED, units: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, check, field, found) of every fault of every row: one scan, no shuffle."""
    named = quality.column_or_null(df, key).cast("string").alias(key)
    return df.select(named, F.explode(faults(df, required, units)).alias("f")).select(key, "f.*")


def scanned(df: DataFrame, properties: tuple = (), required: tuple = REQUIRED, units: dict[str, list[str]] | None = None, stats: dict | None = None) -> DataFrame:
    """One row from one scan: n_samples, schema_violations, provenance_missing (rows), unit_violations, tier_<tier>, and <property>_n, _mean, _std, _least, _most."""
    trusted = quality.trust(df.withColumn("__faults", faults(df, required, units)), stats or {})
    of = lambda check: F.size(F.filter("__faults", lambda f: f["check"] == check))
    count = lambda c: F.count(F.when(c, 1))
    out = [F.count("*").alias("n_samples"), count(of("schema") > 0).alias("schema_violations"), count(of("provenance") > 0).alias("provenance_missing"), F.coalesce(F.sum(of("unit")), F.lit(0)).alias("unit_violations")]
    out += [count(F.col("trust_tier") == t).alias(f"tier_{t}") for t in TIERS]
    for p in properties:
        x = finite(quality.column_or_null(df, p).try_cast("double"))
        out += [f(x).alias(f"{p}_{n}") for n, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_pop), ("least", F.min), ("most", F.max))]
    return trusted.agg(*out)


def validate_dataset(
    df: DataFrame, key: str = "jid", properties: tuple = (), required: tuple = REQUIRED, units: dict[str, list[str]] | None = None, stats: dict | None = None, assigned: DataFrame | None = None,
    baseline: DataFrame | None = None, baseline_summary: dict[str, dict[str, float]] | None = None, strict: bool = False, drift_hard: bool = False, joint_hard: bool = False, **joint_how,
) -> DataFrame:
    """One row: the counts of ``scanned``, those of duplicates, leakage, outliers and drift, gate_failures and gate_pass.

    drift_summary has each property's shift of the mean, in deviations of the baseline.
    ``assigned``: (key, split), whose keys must be in one split each. ``baseline``: earlier rows, whose
    properties are tested against these one by one and together. ``baseline_summary``: mean and std by
    property. A gate is a count that must be 0: the hard ones always, drift if asked for, all in strict mode.
    """
    checked = (*([key] if key in df.columns else []), *(c for c in dict.fromkeys((*required, *properties, "provenance_type", "source_key", "source_version", "source_id", "unit", "units", *(c for p in (units or {}) for c in (p, f"{p}_unit", f"{p}_units")), *(stats or {}))) if c in df.columns and c != key))
    df = df.select(*checked)
    one = scanned(df, properties, required, units, stats)
    numbers = [p for p in properties if p in df.columns]

    def beside(one: DataFrame, part: DataFrame) -> DataFrame:
        return one.crossJoin(F.broadcast(part))  # one row each

    extra: dict[str, DataFrame | Column] = {}
    if key in df.columns:
        one = beside(one, quality.duplicates(df.where(F.col(key).isNotNull()), key).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count")))
    if assigned is not None:
        one = beside(one, quality.overlap_counts(assigned, key).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("leakage_count")))
    if numbers:
        values = cut(quality.long_form(df.withColumn(key, quality.column_or_null(df, key)), numbers, [key]))
        one = beside(one, quality.outliers(values, key).agg(F.count("*").alias("outlier_count")))
        if baseline is not None:
            before = [p for p in numbers if p in baseline.columns]
            old = cut(quality.long_form(baseline.withColumn(key, quality.column_or_null(baseline, key)), before, [key]))
            tested = drift.drift(old.withColumnRenamed(key, "key"), values.where(F.col("property").isin(before)).withColumnRenamed(key, "key"))
            one = beside(one, tested.agg(F.count(F.when(F.col("alert"), 1)).alias("drift_alert_count")))
            one = beside(one, joint.joint_drift(baseline, df, before, key, **joint_how).select(F.col("alert").cast("long").alias("joint_drift_alert_count")))
    for name in ("duplicate_count", "leakage_count", "outlier_count", "drift_alert_count", "joint_drift_alert_count"):
        if name not in one.columns:
            extra[name] = F.lit(0).cast("long")
    shifts = [F.struct(F.lit(p).alias("property"), (F.abs(F.col(f"{p}_mean") - s["mean"]) / (s["std"] if (s.get("std") or 0) > 1e-12 else 1.0)).alias("shift")) for p, s in (baseline_summary or {}).items() if f"{p}_mean" in one.columns]
    summary = F.map_from_entries(F.filter(F.array(*shifts), lambda s: s["shift"].isNotNull())) if shifts else F.create_map().cast("map<string,double>")
    one = one.withColumns(extra | {"drift_summary": summary})
    tested = [*HARD, *(STRICT if strict else [c for c, hard in (("drift_alert_count", drift_hard), ("joint_drift_alert_count", joint_hard)) if hard])]
    failures = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in tested)))
    return one.withColumn("gate_failures", failures).withColumn("gate_pass", F.size("gate_failures") == 0)


def markdown(report: DataFrame) -> str:
    """The one row of ``validate_dataset`` as a text of a few lines."""
    r = report.first()
    lines = ["# Data validation", "", f"Samples: {r.n_samples}", "", "| check | count | gate |", "| --- | --- | --- |"]
    lines += [f"| {c} | {r[c]} | {'pass' if not r[c] else 'fail' if any(f.startswith(f'{c}=') for f in r.gate_failures) else 'warning'} |" for c in (*HARD, *STRICT)]
    return "\n".join([*lines, "", f"Overall: {'pass' if r.gate_pass else 'fail'}", ""])
