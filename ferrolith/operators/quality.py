"""Data quality: schema, provenance, duplicates, leakage, outliers, units, summaries, trust and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.functions.chem import present
from ferrolith.functions.numeric import finite

#: Provenance types with their trust points.
PROVENANCE = {"dft_primary": 30, "experimental": 25, "db_import": 20, "literature": 12, "synthetic": 8}


def column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def schema_violations(df: DataFrame, required: list[str], key: str = "jid") -> DataFrame:
    """(key, missing) of rows that lack a required field or have an unknown provenance type."""
    missing = [F.when(column_or_null(df, c).isNull(), F.lit(c)) for c in required]
    kind = present(column_or_null(df, "provenance_type"))
    missing.append(F.when(kind.isNotNull() & ~kind.isin(*PROVENANCE), F.lit("provenance_type")))
    return df.select(F.col(key), F.array_compact(F.array(*missing)).alias("missing")).where(F.size("missing") > 0)


def provenance_violations(df: DataFrame, key: str = "jid") -> DataFrame:
    kind = present(column_or_null(df, "provenance_type"))
    return df.select(F.col(key), F.coalesce(kind, F.lit("missing")).alias("provenance_type")).where(~F.col("provenance_type").isin(*PROVENANCE))


def fill_provenance(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Empty provenance columns filled from ``defaults``."""
    return df.withColumns({c: F.coalesce(present(column_or_null(df, c)), F.lit(v)) for c, v in defaults.items()})


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of trimmed keys with more than one row; the number of duplicates is the sum of n - 1."""
    return df.groupBy(F.trim(F.col(key).cast("string")).alias(key)).agg(F.count("*").alias("n")).where("n > 1")


def overlap_counts(assigned: DataFrame, key: str, split: str = "split", splits: tuple = ("train", "val", "test")) -> DataFrame:
    """(left, right, n): distinct keys that two splits share, zero included."""
    flags = assigned.groupBy(key).agg(*(F.max((F.col(split) == s).cast("int")).alias(s) for s in splits))
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1 :]]
    sums = flags.agg(*(F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}|{b}") for a, b in pairs))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{a}|{b}").alias("n")) for a, b in pairs))).alias("p")).select("p.*")


def overlap_by_field(assigned: DataFrame, fields: list[str], split: str = "split", splits: tuple = ("train", "val", "test")) -> DataFrame:
    return reduce(DataFrame.unionByName, (overlap_counts(assigned.where(F.col(f).isNotNull()), f, split, splits).withColumn("field", F.lit(f)) for f in fields))


def long_form(df: DataFrame, properties: list[str], keys: list[str] | None = None) -> DataFrame:
    """One row for each property's finite value."""
    pairs = F.array(*(F.struct(F.lit(p).alias("property"), finite(F.col(p).cast("double")).alias("value")) for p in properties))
    return df.select(*(keys or []), F.explode(pairs).alias("p")).select(*(keys or []), "p.*").where("value is not null")


def summarize(values: DataFrame, sample: bool = False) -> DataFrame:
    """count, mean, std (of the population, or of the sample), min and max of each property."""
    std = F.stddev_samp if sample else F.stddev_pop
    return values.groupBy("property").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), std("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"))


def median_mad(values: DataFrame) -> DataFrame:
    """Each property's median and the median of the distances from it."""
    middle = values.groupBy("property").agg(F.median("value").alias("median"))
    met = values.join(F.broadcast(middle), "property")  # a row a property
    return met.groupBy("property").agg(F.first("median").alias("median"), F.median(F.abs(F.col("value") - F.col("median"))).alias("mad"))


def _upper_median(values: DataFrame, value: str) -> DataFrame:
    """The element at n // 2 of the sorted values: the discrete percentile just above the middle."""
    from ferrolith.operators.ordered import cumulative, cut

    counts = cut(values.groupBy("property", value).agg(F.count("*").alias("__n")))
    n = counts.groupBy("property").agg(F.sum("__n").alias("__all"))
    placed = cumulative(counts, ["property"], value, {"__last": "__n"}).join(F.broadcast(n), "property")
    return placed.where(F.col("__last") > F.floor(F.col("__all") / 2)).groupBy("property").agg(F.min(value).alias("middle"), F.first("__all").alias("n"))


def outliers(values: DataFrame, key: str, sigma: float = 5.0) -> DataFrame:
    """(property, key, value) beyond sigma * 1.4826 * MAD of the upper median; under 3 values there are none."""
    from ferrolith.operators.ordered import cut

    middle = cut(_upper_median(values, "value"))
    met = values.join(F.broadcast(middle), "property").withColumn("distance", F.abs(F.col("value") - F.col("middle")))
    mad = _upper_median(met.drop("middle", "n"), "distance").select("property", F.when(F.col("middle") == 0, F.lit(1e-10)).otherwise(F.col("middle")).alias("mad"))
    return met.join(F.broadcast(mad), "property").where((F.col("n") >= 3) & (F.col("distance") > sigma * 1.4826 * F.col("mad"))).select("property", key, "value")


def unit_violations(df: DataFrame, properties: list[str], spec: dict[str, list[str]], key: str = "jid") -> DataFrame:
    """(key, property, unit) where a stated unit is none of the property's; a missing unit is no violation."""
    each = []
    for p in properties:
        unit = F.coalesce(*(F.lower(present(column_or_null(df, c))) for c in (f"{p}_unit", f"{p}_units", "unit", "units")))
        wanted = F.array(*(F.lit(u.strip().lower()) for u in spec.get(p, [])))
        each.append(F.struct(F.lit(p).alias("property"), F.when(column_or_null(df, p).isNotNull() & ~F.array_contains(wanted, unit), unit).alias("unit")))
    return df.select(key, F.explode(F.array(*each)).alias("u")).select(key, "u.*").where("unit is not null")


def mean_shift(old: DataFrame, new: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(property, shift, alert): |difference of means| over the old standard deviation (1 if tiny)."""
    a, b = summarize(old), summarize(new)
    met = a.select("property", F.col("mean").alias("old_mean"), "std").join(b.select("property", F.col("mean").alias("new_mean")), "property")
    shift = F.abs(F.col("new_mean") - F.col("old_mean")) / F.when(F.col("std") > 1e-12, F.col("std")).otherwise(1.0)
    return met.select("property", shift.alias("shift"), (shift > threshold).alias("alert"))


def trust(df: DataFrame, stats: dict[str, dict[str, float]]) -> DataFrame:
    """``df`` with trust_score (0 to 93) and trust_tier.

    Provenance type up to 30, completeness of the four provenance fields up to 20, schema 20,
    cross validation 8, and plausibility: each property of ``stats`` adds its share of 15 points if the
    value lies within 3 scales of the middle, of 8 points within 5. Middle and scale are median and
    1.4826 * MAD where these are given, else mean and std; missing values add none. Without ``stats``
    plausibility is 8.
    """
    kind = present(column_or_null(df, "provenance_type"))
    provenance = F.lit(0)
    for name, points in PROVENANCE.items():
        provenance = F.when(kind == name, F.lit(points)).otherwise(provenance)
    fields = [present(column_or_null(df, c)).isNotNull().cast("int") for c in ("provenance_type", "source_key", "source_version", "source_id")]
    complete = reduce(lambda a, b: a + b, fields) * 5
    plausible = F.lit(0.0 if stats else 8.0)
    for p, s in stats.items():
        robust = (s.get("mad") or 0) > 1e-12 and s.get("median") is not None
        middle, scale = (s["median"], 1.4826 * s["mad"]) if robust else (s.get("mean"), s.get("std") or 0)
        if p in df.columns and scale > 1e-12:
            z = F.abs(F.col(p) - middle) / scale
            plausible = plausible + F.when(z <= 3, 15 / len(stats)).when(z <= 5, 8 / len(stats)).otherwise(0.0)
    score = provenance + complete + 20 + plausible + 8
    return df.withColumn("trust_score", score.cast("double")).withColumn("trust_tier", F.when(F.col("trust_score") >= 70, "benchmark").when(F.col("trust_score") >= 40, "curated").otherwise("raw"))


def tier_counts(trusted: DataFrame) -> DataFrame:
    tiers = trusted.sparkSession.createDataFrame([("benchmark",), ("curated",), ("raw",)], "trust_tier string")
    return tiers.join(trusted.groupBy("trust_tier").agg(F.count("*").alias("n")), "trust_tier", "left").select("trust_tier", F.coalesce("n", F.lit(0)).alias("n"))


def gates(metrics: DataFrame, limits: dict[str, float], warnings: dict[str, float] | None = None, strict: bool = False) -> DataFrame:
    """A one-row table of metrics with ``failures`` (names over their limit) and ``gate_pass``."""
    tested = limits | (warnings or {} if strict else {})
    failures = F.array_compact(F.array(*(F.when(F.col(m) > x, F.lit(m)) for m, x in tested.items())))
    return metrics.withColumn("failures", failures).withColumn("gate_pass", F.size("failures") == 0)


def remove_outliers(df: DataFrame, properties: list[str], cut: float = 3.5, modified: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed rows): a row goes if any property's (modified) z-score is over ``cut``."""
    values = long_form(df, properties)
    found = median_mad(values).collect() if modified else summarize(values).collect()  # a row a property
    tests = [(F.abs(F.col(r.property) - r.median) * 0.6745 / r.mad > cut) if modified else (F.abs(F.col(r.property) - r["mean"]) / r["std"] > cut) for r in found if (r.mad if modified else r["std"]) > 1e-12]
    flagged = F.coalesce(reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests), F.lit(False)), F.lit(False))
    return df.where(~flagged), df.where(flagged)


def ood(df: DataFrame, history: DataFrame, properties: list[str], least: int = 24) -> DataFrame:
    """``df`` with ``ood``: 1 - exp(-excess) of the RMS of robust z distances over the history's 95th percentile."""
    if history.count() < least:
        return df.withColumn("ood", F.lit(0.0))
    stats = history.agg(*(x for p in properties for x in (F.median(p).alias(f"m_{p}"), (F.percentile(p, F.lit(0.75)) - F.percentile(p, F.lit(0.25))).alias(f"s_{p}")))).first()
    scale = {p: (stats[f"s_{p}"] / 1.349) if stats[f"s_{p}"] and stats[f"s_{p}"] > 1e-12 else 1.0 for p in properties}
    rms = F.sqrt(sum(F.pow((F.col(p) - stats[f"m_{p}"]) / scale[p], F.lit(2)) for p in properties) / len(properties))
    bound = max(history.select(rms.alias("d")).agg(F.percentile("d", F.lit(0.95))).first()[0], 1e-12)
    return df.withColumn("ood", 1 - F.exp(-F.greatest(rms / bound - 1, F.lit(0.0))))


def normalize(df: DataFrame, targets: list[str]) -> DataFrame:
    """Each target as (x - mean) / population std, a tiny std being 1."""
    stats = df.agg(*(x for t in targets for x in (F.avg(t).alias(f"m_{t}"), F.stddev_pop(t).alias(f"s_{t}"))))
    met = df.crossJoin(F.broadcast(stats))  # one row
    made = {f"{t}_norm": (F.col(t) - F.col(f"m_{t}")) / F.when(F.col(f"s_{t}") > 1e-8, F.col(f"s_{t}")).otherwise(1.0) for t in targets}
    return met.withColumns(made).select(*df.columns, *made)


def label_count_filter(df: DataFrame, properties: list[str], least: int) -> DataFrame:
    """Rows with at least ``least`` present labels."""
    return df.where(reduce(lambda a, b: a + b, (present(F.col(p)).isNotNull().cast("int") for p in properties)) >= least)


def validate(df: DataFrame, required: list[str], properties: list[str], key: str = "jid") -> DataFrame:
    """One row of counts: rows, schema violations, provenance violations, duplicates, outliers."""
    one = df.agg(F.count("*").alias("n_rows"))
    parts = {
        "schema_violations": schema_violations(df, required, key),
        "provenance_violations": provenance_violations(df, key),
        "outliers": outliers(long_form(df, properties, [key]), key),
    }
    for name, part in parts.items():
        one = one.crossJoin(part.agg(F.count("*").alias(name)))  # one row each
    return one.crossJoin(duplicates(df, key).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")))


def rolling_residual_scale(history: DataFrame, order: str, z: str, window: int = 128, level: float = 0.9) -> DataFrame:
    """RMS and conformal quantile of the last ``window`` standardized residuals."""
    recent = history.orderBy(F.desc(order)).limit(window)
    return recent.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col(z) * F.col(z))).alias("rms"), F.percentile(F.abs(F.col(z)), F.lit(level)).alias("quantile"))


def cluster_summary(df: DataFrame, cluster: str, properties: list[str]) -> DataFrame:
    """count, mean and sample std of each property by cluster."""
    return long_form(df, properties, [cluster]).groupBy(cluster, "property").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def balanced_sample(df: DataFrame, label: str, key: str, n: int | None = None) -> DataFrame:
    """The same number of rows of each label, by a hash of the key."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    w = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= min(least, n or least)).drop("__at")
