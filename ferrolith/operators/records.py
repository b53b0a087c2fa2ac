"""Records: ids, names, aliases, presence counts, groups' label sums, pools of a discovery loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.numeric import clip, finite
from ferrolith.operators import pareto
from ferrolith.operators.selection import sample

#: Reading states by rank, as lists sort by them.
STATES = ["not_started", "queued", "scanned", "in_progress", "unknown", "complete"]


def sample_id(df: DataFrame, index: str) -> Column:
    """``jid`` where the table has that column, else ``source_id``; a null of the chosen column is 'idx:' and the index.

    A null ``jid`` does not fall back to ``source_id``.
    """
    chosen = next((F.col(c) for c in ("jid", "source_id") if c in df.columns), F.lit(None))
    return F.coalesce(chosen.cast("string"), F.concat(F.lit("idx:"), F.col(index).cast("string")))


def source_version(url: Column, prefix: str = "figshare_", default: str | None = None) -> Column:
    """``prefix`` and the number after '/files/' in a URL; ``default`` where there is none."""
    number = F.regexp_extract(url, r"/files/(\d+)", 1)
    return F.when(number != "", F.concat(F.lit(prefix), number)).otherwise(F.lit(default))


def canonical(df: DataFrame, name: str, source: str | None = None) -> Column:
    """A finite property under its canonical name, or of its source's column where that is null or absent."""
    there = [F.col(c).try_cast("double") for c in (name, source) if c in df.columns]
    return finite(F.coalesce(*there)) if there else F.lit(None).cast("double")


def aliased(value: Column, aliases: dict[str, str], default: str | None = None) -> Column:
    """What ``aliases`` calls a trimmed value, as it is or in lower case; else ``default``, or the value itself."""
    if not aliases:
        return F.trim(value) if default is None else F.lit(default)
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    found = F.coalesce(F.try_element_at(table, F.trim(value)), F.try_element_at(table, F.lower(F.trim(value))))
    return F.coalesce(found, F.trim(value) if default is None else F.lit(default))


def error_bucket(message: Column, kind: Column | None = None) -> Column:
    """timeout, oom, interrupt or exception, by the error's type and message."""
    said = F.lower(F.trim(F.coalesce(message, F.lit(""))))
    late = F.coalesce(kind == "TimeoutError", F.lit(False)) if kind is not None else F.lit(False)
    return F.when(late, "timeout").when(said.contains("out of memory"), "oom").when(said.contains("keyboardinterrupt"), "interrupt").otherwise("exception")


def clean_names(names: Column) -> Column:
    """Trimmed names in their order, blank and repeated ones left out."""
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != ""))


def element_shares(symbols: Column) -> Column:
    """map(element, share of the atoms) of an array of symbols; blanks are left out, NULL without atoms."""
    clean = F.filter(F.transform(symbols, lambda s: F.trim(s)), lambda s: s != "")
    made = F.map_from_entries(F.transform(F.array_distinct(clean), lambda e: F.struct(e, F.size(F.filter(clean, lambda s: s == e)) / F.size(clean))))
    return F.when(F.size(clean) > 0, made)


def find_record(df: DataFrame, wanted: str, key: str = "jid") -> DataFrame:
    """The record of a trimmed id, in a table of one row; ValueError where it is empty or absent."""
    if not wanted.strip():
        raise ValueError("the id is empty")
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    found = df.where(F.trim(F.col(key).cast("string")) == wanted.strip()).limit(1)
    if found.isEmpty():
        raise ValueError(f"no record {wanted.strip()}")
    return found


def group_label_stats(df: DataFrame, group: str, target: str) -> DataFrame:
    """(group, total, n, squares) of finite targets; groups without any are left out."""
    v = finite(F.col(target).cast("double"))
    made = df.select(group, v.alias("v")).where("v is not null")
    return made.groupBy(group).agg(F.sum("v").alias("total"), F.count("*").alias("n"), F.sum(F.col("v") * F.col("v")).alias("squares"))


def presence(df: DataFrame, properties: list[str], split: str = "split") -> DataFrame:
    """(split, property, present, finite_count, nan_count), in one pass; columns the table lacks count 0."""
    sums = []
    for p in properties:
        v = F.col(p).cast("double") if p in df.columns else F.lit(None).cast("double")
        sums += [F.count(v).alias(f"{p}__a"), F.count(finite(v)).alias(f"{p}__b"), F.count(F.when(F.isnan(v), 1)).alias(f"{p}__c")]
    wide = df.groupBy(split).agg(*sums)
    each = F.array(*(F.struct(F.lit(p).alias("property"), F.col(f"{p}__a").alias("present"), F.col(f"{p}__b").alias("finite_count"), F.col(f"{p}__c").alias("nan_count")) for p in properties))
    return wide.select(split, F.explode(each).alias("x")).select(split, "x.*")


def error_counts(df: DataFrame, errors: str, split: str = "split") -> DataFrame:
    """(split, error, n) of an array column of error codes."""
    return df.select(split, F.explode(errors).alias("error")).groupBy(split, "error").agg(F.count("*").alias("n"))


def stats_records(df: DataFrame, assigned: DataFrame | None, key: str, split: str = "train") -> tuple[DataFrame, str]:
    """The records that statistics are taken of, and why: one split's, or all where that has none."""
    if df.isEmpty():
        return df, "empty"
    if assigned is None or (ids := assigned.where(F.col("split") == split).select(key).distinct()).isEmpty():
        return df, "all_records"
    chosen = df.join(ids, key, "left_semi")
    return (df, "all_records_fallback") if chosen.isEmpty() else (chosen, f"{split}_split")


def priorities(df: DataFrame, k: int, grade: str = "grade", state: str = "state", key: str = "id") -> DataFrame:
    """The k first of grade A that are not complete, by the rank of their state, then by id."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col(state))
    open_ones = df.where((F.col(grade) == "A") & F.col(state).isin(STATES[:-1]))
    return open_ones.orderBy(rank, key).limit(k)


def unique_formulas(df: DataFrame, formula: str = "formula") -> DataFrame:
    """The distinct formulas, sorted."""
    return df.select(F.trim(formula).alias(formula)).where(F.col(formula) != "").distinct().orderBy(formula)


def objective_points(df: DataFrame, terms: list[str]) -> Column:
    """The terms as a point of the unit cube; missing, NaN and infinite ones are 0."""
    return F.array(*(clip(F.coalesce(finite(F.col(t).cast("double")), F.lit(0.0)), 0, 1) for t in terms))


def feasible_point(point: Column, threshold: float, synthesis: float | None = None) -> Column:
    """A finite point whose first term is ``threshold`` at least; with ``synthesis`` its third term that at least, false without a third."""
    whole = ~F.exists(point, lambda x: finite(x).isNull())
    mask = whole & (F.get(point, F.lit(0)) >= threshold)
    if synthesis is not None:
        mask = mask & (F.get(point, F.lit(2)) >= synthesis)
    return F.coalesce(mask, F.lit(False))


def baseline_summary(report: Column) -> Column:
    """details.property_summary of a JSON report: map(property, map(name, number)); NULL where there is none."""
    return F.from_json(F.get_json_object(report, "$.details.property_summary"), "map<string,map<string,double>>")


def update_pools(labelled: DataFrame, pool: DataFrame, picked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(labelled, pool) after a round: picked rows of the pool move, ids that are no longer there stay out."""
    ids = picked.select(key).distinct()
    moved = pool.join(ids, key, "left_semi")
    return labelled.unionByName(moved.join(labelled.select(key), key, "left_anti"), allowMissingColumns=True), pool.join(ids, key, "left_anti")


def subset(df: DataFrame, key: str, n: int, strategy: str = "random", score: str | None = None, vector: str | None = None, seed: int = 42) -> DataFrame:
    """n rows by ``random`` (a hash), ``kcenter`` (greedy, over ``vector``) or ``hybrid``: half the best by ``score``, half k-center of the rest."""
    if strategy == "random":
        return sample(df, key, n, seed)
    if strategy == "kcenter":
        return df.join(F.broadcast(pareto.k_center(df, key, vector, n).select(key)), key, "left_semi")  # n rows
    if strategy != "hybrid":
        raise ValueError(f"no strategy {strategy!r}")
    best = df.orderBy(F.desc_nulls_last(score), key).limit(n // 2)
    rest = df.join(F.broadcast(best.select(key)), key, "left_anti")  # n rows at most
    return best.unionByName(subset(rest, key, n - n // 2, "kcenter", vector=vector))


def coverage_vector(shares: Column, labels: list[str], space_group: Column | None = None, weights: tuple = (1.0, 0.35, 0.25)) -> Column:
    """For k-center: element shares, which labels are there, and the space group over 230, each by its weight."""
    parts = [F.transform(shares, lambda x: x * weights[0]), F.array(*(F.when(F.col(c).isNotNull(), weights[1]).otherwise(0.0) for c in labels))]
    if space_group is not None:
        parts.append(F.array(F.coalesce(space_group / F.lit(230.0), F.lit(0.0)) * weights[2]))
    return reduce(F.concat, parts)
