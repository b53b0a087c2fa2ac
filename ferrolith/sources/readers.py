"""Sources: property tables, records, assignments, checkpoints, run results, trackers; with their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolith.functions.chem import present
from ferrolith.functions.numeric import finite
from ferrolith.operators.ordered import keep_last

NUMERIC = ["ehull", "spillage", "formation_energy_peratom", "optb88vdw_bandgap", "mbj_bandgap", "hse_gap", "bulk_modulus_kv", "shear_modulus_gv", "poisson", "density"]
TOPOLOGY = "jid string, formula string, space_group int, topo_class string, band_gap double, source string, spillage double, si_score double, ml_probability double, ml_uncertainty double, topological_probability double, topology_ci_low double, topology_ci_high double, ood_score double"


def number(value: Column) -> Column:
    """A finite double; words for a missing value, and anything else that is no number, are NULL."""
    return finite(present(value).try_cast("double"))


def read_properties(spark: SparkSession, path: str, numeric: list[str] | None = None) -> DataFrame:
    """A JSON array (or lines) of property rows: listed columns become numbers, missing ones NULL."""
    kinds = T.StructType([T.StructField(c, T.StringType()) for c in ("jid", "formula", "spg_number", *NUMERIC)] + [T.StructField("atoms", T.StructType([T.StructField("elements", T.ArrayType(T.StringType())), T.StructField("coords", T.ArrayType(T.ArrayType(T.DoubleType())))]))])
    raw = spark.read.schema(kinds).json(path, multiLine=True)
    return raw.withColumns({c: number(F.col(c)) for c in numeric or NUMERIC} | {"spg_number": F.col("spg_number").try_cast("int")})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """By ending: .json (a list, or an object with ``records``), .jsonl (a bad line fails), .csv with a header."""
    if path.endswith(".jsonl"):
        return spark.read.json(path, mode="FAILFAST")
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True)
    if not path.endswith(".json"):
        raise ValueError(f"no reader for {path}")
    raw = spark.read.json(path, multiLine=True)
    return raw.select(F.explode("records").alias("r")).select("r.*") if "records" in raw.columns else raw


def read_or_empty(spark: SparkSession, path: str, schema: str = TOPOLOGY) -> DataFrame:
    """A CSV store; an unreadable one is an empty table."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", enforceSchema=False)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def normalize_topology(df: DataFrame, schema: str = TOPOLOGY) -> DataFrame:
    """The fixed columns: absent ones NULL, strings trimmed, classes in upper case, a default source, numbers finite."""
    out = []
    for f in T.StructType.fromDDL(schema).fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None).cast("string")
        if isinstance(f.dataType, T.StringType):
            c = present(c)
            c = F.upper(c) if f.name == "topo_class" else F.coalesce(c, F.lit("custom")) if f.name == "source" else c
        else:
            c = number(c).cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def merge_keep_last(*tables: DataFrame, key: str = "jid") -> DataFrame:
    """The tables' union; of rows with equal keys, that of the latest table."""
    whole = None
    for i, t in enumerate(tables):
        t = t.withColumn("__seq", F.lit(i))
        whole = t if whole is None else whole.unionByName(t, allowMissingColumns=True)
    return keep_last(whole, [key], "__seq").drop("__seq")


def read_assignment(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, split) of valid rows; an id with two splits is an error."""
    split = F.lower(F.trim("split"))
    kept = df.select(present(F.col(key)).alias(key), split.alias("split")).where(F.col(key).isNotNull() & F.col("split").isin("train", "val", "test")).distinct()
    bad = kept.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][key]} has contradicting splits")
    return kept


def read_iterations(spark: SparkSession, pattern: str) -> DataFrame:
    """Checkpoint files of rounds, one row a candidate, with the file's iteration."""
    raw = spark.read.json(pattern, multiLine=True)
    return raw.select(F.col("iteration").alias("round"), F.explode("candidates").alias("c")).select("round", "c.*")


def resume_state(candidates: DataFrame, tail: int = 5000, least: float = 0.3) -> tuple[int, DataFrame, DataFrame]:
    """(last round, the latest ``tail`` candidates, the last round's seeds of a score over ``least``)."""
    last = candidates.agg(F.max("round")).first()[0] or 0
    seeds = candidates.where((F.col("round") == last) & (F.col("acquisition_value") > least))
    return last, candidates.orderBy(F.desc("round"), "formula").limit(tail), seeds


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Result files, one row each, with the run's folder as ``run_id``."""
    return spark.read.json(pattern, multiLine=True).withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def read_tracker(spark: SparkSession, path: str) -> DataFrame:
    """(id, category, field, value) of a Markdown tracker: '## category', '### id', '- field: value'; the first id wins.

    One file is one ordered list, so its lines are numbered in one task.
    """
    lines = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")).select("file", F.posexplode(F.split("value", "\n")).alias("line", "text"))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    category, heading = (F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in (r"^##\s+([^#].*?)\s*$", r"^###\s+(.*?)\s*$"))
    named = lines.withColumn("category", F.last(category, ignorenulls=True).over(w)).withColumn("id", F.last(heading, ignorenulls=True).over(w)).withColumn("head", F.max(F.when(heading.isNotNull(), F.col("line"))).over(w))
    first = named.groupBy("id").agg(F.min("head").alias("first"))
    fields = named.withColumn("field", F.lower(F.trim(F.regexp_extract("text", r"^-\s*([^:]+):", 1)))).withColumn("value", F.trim(F.regexp_extract("text", r"^-\s*[^:]+:\s*(.*)$", 1)))
    return fields.where("field <> '' and id is not null").join(first, "id").where("head = first").select("id", "category", "field", "value")


def units_spec(overrides: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Expected units by property, overrides over the defaults."""
    defaults = {"formation_energy_peratom": ["ev/atom"], "ehull": ["ev/atom"], "optb88vdw_bandgap": ["ev"], "bulk_modulus_kv": ["gpa"], "shear_modulus_gv": ["gpa"], "density": ["g/cm3"]}
    return defaults | (overrides or {})
