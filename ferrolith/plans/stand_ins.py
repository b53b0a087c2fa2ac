"""Domain tables made from the test tables: the same columns as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = ["Li", "O", "Fe", "Na", "Cl", "Bi", "Te", "Si", "C", "Sn"]
KINDS = ["dft_primary", "experimental", "db_import", "literature", "synthetic"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a part with any line: a formula, gaps with missing values, moduli, provenance.

    Averages are made of whole numbers, so that their sums don't depend on order.
    """
    whole = lambda c, k: F.sum(F.round(F.col(c) * k).cast("long")).cast("double")
    lines = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").cast("double").alias("n"), whole("l_discount", 100).alias("d"), whole("l_tax", 100).alias("t"), whole("l_quantity", 1).alias("q"))
    p = read(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"))
    names = F.array(*map(F.lit, ELEMENTS))
    key, size = F.col("p_partkey"), F.col("p_size")
    gap = F.col("d") * 0.6 / F.col("n")
    formula = F.concat(F.get(names, (size % 10).cast("int")), (key % 4 + 1).cast("string"), F.get(names, (F.floor(key / 4) % 10).cast("int")), (size % 3 + 1).cast("string"))
    return p.select(
        key.alias("part"), F.concat(F.lit("M"), key.cast("string")).alias("jid"), formula.alias("formula"), F.col("p_brand").alias("source_key"), (key % 240).cast("int").alias("spg_number"), size.alias("size"),
        F.when(size % 7 != 0, gap).alias("optb88vdw_bandgap"), F.when(size % 3 != 0, gap * 1.2 + 0.1).alias("mbj_bandgap"), F.when(size % 5 == 0, gap * 1.3 + 0.2).alias("hse_gap"),
        (F.col("t") * 0.025 / F.col("n")).alias("ehull"), (F.col("q") / F.col("n") / 50).alias("spillage"), (-F.col("d") * 0.3 / F.col("n")).alias("formation_energy_peratom"),
        (size * 4.0 + 10).alias("bulk_modulus_kv"), (F.col("q") * 2 / F.col("n")).alias("shear_modulus_gv"), (F.col("p_retailprice") / 200).alias("density"), ((size % 10) * 0.015 + 0.2).alias("poisson"),
        F.get(F.array(*map(F.lit, KINDS)), (key % 6).cast("int")).alias("provenance_type"), F.when(size % 4 == 0, "").otherwise("v1").alias("source_version"), F.concat(F.lit("s"), key.cast("string")).alias("source_id"),
        (size > 25).cast("int").alias("label"),
    )


_LIST = "[" + ", ".join(f"'{e}'" for e in ELEMENTS) + "]"
_KIND = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
#: The same as a common table expression ``materials``.
MATERIALS = f"""li AS (SELECT l_partkey, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS d,
  CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS t, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) AS q FROM lineitem GROUP BY 1),
materials AS (SELECT p_partkey AS part, 'M' || p_partkey AS jid,
  {_LIST}[p_size % 10 + 1] || (p_partkey % 4 + 1) || {_LIST}[(p_partkey // 4) % 10 + 1] || (p_size % 3 + 1) AS formula,
  {_LIST}[p_size % 10 + 1] AS e1, CAST(p_partkey % 4 + 1 AS DOUBLE) AS c1, {_LIST}[(p_partkey // 4) % 10 + 1] AS e2, CAST(p_size % 3 + 1 AS DOUBLE) AS c2,
  p_brand AS source_key, CAST(p_partkey % 240 AS INTEGER) AS spg_number, p_size AS size,
  CASE WHEN p_size % 7 <> 0 THEN d * 0.6::DOUBLE / n END AS optb88vdw_bandgap, CASE WHEN p_size % 3 <> 0 THEN d * 0.6::DOUBLE / n * 1.2::DOUBLE + 0.1::DOUBLE END AS mbj_bandgap,
  CASE WHEN p_size % 5 = 0 THEN d * 0.6::DOUBLE / n * 1.3::DOUBLE + 0.2::DOUBLE END AS hse_gap,
  t * 0.025::DOUBLE / n AS ehull, q / n / 50 AS spillage, -d * 0.3::DOUBLE / n AS formation_energy_peratom,
  p_size * 4.0::DOUBLE + 10 AS bulk_modulus_kv, q * 2 / n AS shear_modulus_gv, p_retailprice / 200 AS density, (p_size % 10) * 0.015::DOUBLE + 0.2::DOUBLE AS poisson,
  {_KIND}[p_partkey % 6 + 1] AS provenance_type, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'v1' END AS source_version, 's' || p_partkey AS source_id, CAST(p_size > 25 AS INTEGER) AS label
  FROM part JOIN li ON p_partkey = l_partkey)"""


def phi(z: str) -> str:
    """The normal distribution function of an SQL expression, by the polynomial of functions.numeric.normal_cdf."""
    t = f"(1 / (1 + 0.3275911::DOUBLE * (abs({z}) / sqrt(2::DOUBLE))))"
    tail = f"{t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))) * exp(-(abs({z}) / sqrt(2::DOUBLE)) * (abs({z}) / sqrt(2::DOUBLE)))"
    return f"(CASE WHEN {z} >= 0 THEN 1 - 0.5::DOUBLE * ({tail}) ELSE 0.5::DOUBLE * ({tail}) END)"


def r6(x, digits: int = 6):
    """Rounded, with no negative zero."""
    return F.round(x, digits) + F.lit(0.0)
