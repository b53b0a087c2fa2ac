"""Validation of whole datasets."""

import pytest
from pyspark.sql import functions as F

from ferrolith.operators import splits, validation

KIND = "jid string, atoms string, provenance_type string, source_key string, source_version string, source_id string, e double, e_unit string"


def records(spark, n=50, kind="dft_primary"):
    return spark.createDataFrame([(f"T{i}", "{}", kind, "test", "1.0", f"T{i}", 0.1 * i, "eV") for i in range(n)], KIND)


def one(df):
    (r,) = df.collect()
    return r


def test_clean_data_passes(spark):
    df = records(spark)
    assigned = splits.iid_split(df, "jid")
    r = one(validation.validate_dataset(df, properties=("e",), assigned=assigned, units={"e": ["eV"]}))
    assert r.gate_pass and r.gate_failures == [] and r.n_samples == 50 and r.leakage_count == 0 and r.outlier_count == 0
    assert (r.tier_raw, r.tier_curated, r.tier_benchmark) == (0, 0, 50) and r.e_n == 50 and r.e_mean == pytest.approx(2.45)
    assert "Overall: pass" in validation.markdown(validation.validate_dataset(df))


def test_faults_are_counted_and_told(spark):
    bad = [("T0", None, "dft_primary", None, None, None, 1.0, "meV"), (None, "{}", "unknown", "k", "1", "i", float("nan"), None), ("T1", "{}", None, "k", "1", "i", 900.0, None), (" T1", "{}", "", "k", "1", "i", None, "meV")]
    df = records(spark, 20).unionAll(spark.createDataFrame(bad, KIND))
    found = sorted(map(tuple, validation.violations(df, units={"e": ["eV"]}).collect()), key=repr)
    want = [("T0", "schema", "atoms", None), ("T0", "unit", "e", "mev"), (None, "schema", "jid", None), (None, "schema", "provenance_type", "unknown"), (None, "provenance", "provenance_type", "unknown"), ("T1", "provenance", "provenance_type", None), (" T1", "provenance", "provenance_type", None)]
    assert found == sorted(want, key=repr)
    leaking = spark.createDataFrame([("T0", "train"), ("T0", "test"), ("T1", "train"), ("T1", "train")], "jid string, split string")
    r = one(validation.validate_dataset(df, properties=("e",), assigned=leaking, units={"e": ["eV"]}, strict=True, baseline_summary={"e": {"mean": 0.0, "std": 2.0}, "absent": {"mean": 1.0, "std": 1.0}}))
    assert (r.schema_violations, r.provenance_missing, r.unit_violations, r.duplicate_count, r.leakage_count, r.outlier_count) == (2, 3, 1, 3, 1, 1)
    assert r.gate_failures == ["schema_violations=2", "provenance_missing=3", "leakage_count=1", "unit_violations=1", "duplicate_count=3", "outlier_count=1"] and not r.gate_pass
    assert set(r.drift_summary) == {"e"} and r.drift_summary["e"] == pytest.approx(r.e_mean / 2)
    lenient = one(validation.validate_dataset(df.where("jid like 'T%' and provenance_type = 'dft_primary' and atoms is not null").unionAll(records(spark, 1)), properties=("e",)))
    assert lenient.duplicate_count == 1 and lenient.gate_pass


def test_drift_gates(spark):
    old, new = records(spark, 80), records(spark, 80).withColumn("e", F.col("e") * 3 + 50)
    r = one(validation.validate_dataset(new, properties=("e",), baseline=old, permutations=39))
    assert r.drift_alert_count == 1 and r.joint_drift_alert_count == 1 and r.gate_pass
    r = one(validation.validate_dataset(new, properties=("e",), baseline=old, drift_hard=True, joint_hard=True, permutations=39))
    assert r.gate_failures == ["drift_alert_count=1", "joint_drift_alert_count=1"]
    r = one(validation.validate_dataset(old, properties=("e",), baseline=old, strict=True, permutations=39))
    assert r.gate_pass


def test_row_checks_are_one_scan(spark, tmp_path):
    records(spark).write.parquet(f"{tmp_path}/t")
    plan = validation.scanned(spark.read.parquet(f"{tmp_path}/t"), ("e",), units={"e": ["eV"]})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert validation.violations(spark.read.parquet(f"{tmp_path}/t"))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_empty(spark):
    df = records(spark).limit(0)
    r = one(validation.validate_dataset(df, properties=("e", "absent"), assigned=splits.iid_split(records(spark), "jid").limit(0)))
    assert r.gate_pass and r.n_samples == 0 and r.duplicate_count == 0 and validation.violations(df).count() == 0
