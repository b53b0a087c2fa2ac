"""Deterministic train / validation / test splits, whole groups together, with hashed manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.functions import chem
from ferrolith.operators import split_search


def split_counts(n: int, ratios: tuple = (0.8, 0.1, 0.1)) -> list[int]:
    """Floors, the rest by largest fraction, and at least 1 for each positive ratio where n allows."""
    if any(r < 0 for r in ratios) or not sum(ratios) > 0:
        raise ValueError("ratios must be non-negative with a positive sum")
    share = [r / sum(ratios) * n for r in ratios]
    out = [int(x) for x in share]
    for i in sorted(range(len(ratios)), key=lambda i: (-(share[i] - out[i]), i))[: n - sum(out)]:
        out[i] += 1
    for i, r in enumerate(ratios):
        if r > 0 and out[i] == 0 and n >= sum(x > 0 for x in ratios):
            j = max(range(len(out)), key=lambda k: out[k])
            out[i], out[j] = 1, out[j] - 1
    return out


def iid_split(df: DataFrame, key: str, ratios: tuple = (0.8, 0.1, 0.1), seed: int = 42, buckets: int = 256) -> DataFrame:
    """(key, split) with exact counts, in the order of a hash.

    Rows are numbered inside ranges of the hash whose sizes give the offsets: no task sorts all rows.
    """
    hashed = df.select(key, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("__h"))
    hashed = hashed.withColumn("__b", F.conv(F.substring("__h", 1, 4), 16, 10).cast("int") % buckets)
    sizes = hashed.groupBy("__b").agg(F.count("*").alias("n")).orderBy("__b").collect()  # at most ``buckets`` rows
    train, val, _ = split_counts(sum(r.n for r in sizes), ratios)
    starts, at = [], 0
    for r in sizes:
        starts.append((r["__b"], at))
        at += r.n
    offset = df.sparkSession.createDataFrame(starts, "__b int, __start long")
    placed = hashed.join(F.broadcast(offset), "__b").withColumn("__at", F.col("__start") + F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)))
    return placed.select(key, F.when(F.col("__at") <= train, "train").when(F.col("__at") <= train + val, "val").otherwise("test").alias("split"))


def group_split(df: DataFrame, key: str, group: str, **how) -> DataFrame:
    """(key, group, split): groups stay whole, dealt by ``split_search``; ``how``: its ratios, seed, weights, target, trait."""
    return split_search.assign(df, key, group, **how)


def compositional_split(df: DataFrame, key: str, formula: str = "formula", target: str | None = None, features: str | None = None, label_weight: float = 0.2, leakage_weight: float = 0.2, **how) -> DataFrame:
    """Whole chemical systems together; what has no formula is the system ``unknown``.

    ``target``: a column whose mean splits should share. Systems are similar by the cosine of the mean
    ``features`` (an array column), or by the Jaccard similarity of their elements.
    """
    system = F.coalesce(F.nullif(chem.chemical_system(F.col(formula)), F.lit("")), F.lit("unknown"))
    trait = F.col(features).cast("array<double>").alias("trait") if features else F.coalesce(chem.elements(F.col(formula)), F.array().cast("array<string>")).alias("trait")
    made = df.select(key, system.alias("group"), (F.col(target).cast("double") if target else F.lit(None).cast("double")).alias("target"), trait)
    return group_split(made, key, "group", target=F.col("target"), trait=F.col("trait"), kind="vectors" if features else "sets", label_weight=label_weight, leakage_weight=leakage_weight, **how)


def prototype_split(df: DataFrame, key: str, spacegroup: str = "spacegroup", target: str | None = None, features: str | None = None, label_weight: float = 0.2, leakage_weight: float = 0.2, **how) -> DataFrame:
    """Whole space groups together; what is no number of one is a group of its own name, similar to none."""
    number = chem.space_group(F.col(spacegroup))
    named = F.coalesce(number.cast("string"), chem.present(F.col(spacegroup)), F.lit("unknown"))
    trait = F.col(features).cast("array<double>") if features else F.when(number.isNotNull(), F.array(number.cast("double"))).otherwise(F.array().cast("array<double>"))
    made = df.select(key, named.alias("group"), (F.col(target).cast("double") if target else F.lit(None).cast("double")).alias("target"), trait.alias("trait"))
    return group_split(made, key, "group", target=F.col("target"), trait=F.col("trait"), kind="vectors" if features else "spacegroups", label_weight=label_weight, leakage_weight=leakage_weight, **how)


def id_hash(df: DataFrame, key: str, by: list[str], exact: bool = False) -> DataFrame:
    """(by, n, ids_sha256): a fingerprint of each split's id set, the same in any row order.

    Ids are dealt to 256 parts by their MD5; a part's sorted ids, a line each, are hashed, and the
    part hashes in order again. ``exact`` hashes all sorted ids as one text, for small splits.
    """
    lines = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    ids = df.select(*by, F.col(key).cast("string").alias("__id"))
    if exact:
        return ids.groupBy(*by).agg(F.count("*").alias("n"), lines(F.col("__id")).alias("ids_sha256"))
    parts = ids.groupBy(*by, F.substring(F.md5("__id"), 1, 2).alias("__part")).agg(F.count("*").alias("__n"), lines(F.col("__id")).alias("__h"))
    ordered = F.array_sort(F.collect_list(F.struct("__part", "__h")))  # at most 256
    return parts.groupBy(*by).agg(F.sum("__n").alias("n"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["__h"]), "\n"), 256).alias("ids_sha256"))


def manifest(assigned: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One row: counts and id hashes by split, overlaps, and the hash of these as the manifest's id."""
    from ferrolith.operators.quality import overlap_counts

    by = id_hash(assigned, key, ["split"]).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", F.struct("n", "ids_sha256"))))).alias("splits"))
    shared = overlap_counts(assigned, key).agg(F.sum("n").alias("overlap"))
    said = F.to_json(F.struct(F.lit(seed).alias("seed"), F.col("splits").alias("splits")))
    return by.crossJoin(shared).withColumn("seed", F.lit(seed)).withColumn("manifest_id", F.sha2(said, 256))  # one row each


def attach(df: DataFrame, assigned: DataFrame, key: str, split: str) -> DataFrame:
    """The rows of one split; ids without a split are dropped."""
    return df.join(assigned.where(F.col("split") == split).select(key).distinct(), key, "left_semi")


def jaccard(a: DataFrame, b: DataFrame, key: str, group: str = "split") -> DataFrame:
    """(group, jaccard) of two assignments' id sets; two empty sets have 1."""
    both = a.select(key, group).distinct().withColumn("__a", F.lit(1)).join(b.select(key, group).distinct().withColumn("__b", F.lit(1)), [key, group], "full")
    return both.groupBy(group).agg((F.sum(F.coalesce("__a", F.lit(0)) * F.coalesce("__b", F.lit(0))) / F.count("*")).alias("jaccard"))
