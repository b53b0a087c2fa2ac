"""Budgets, samples, tags, substitutions, option products: the selection steps of a discovery loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.functions import chem


def hybrid_budget(df: DataFrame, score: str, spread: str, key: str, k: int, share: float = 0.3) -> DataFrame:
    """k rows: the best k - round(k * share) by score, then the most uncertain of the rest; short of these, the next best.

    Only the best k of either order can be taken, so no more than 2k rows are ranked.
    """
    n_uncertain = round(k * share)
    best = df.orderBy(F.desc_nulls_last(score), key).limit(k)
    wide = df.orderBy(F.desc_nulls_last(spread), key).limit(k)
    pool = best.unionByName(wide).dropDuplicates([key])
    by_score = F.row_number().over(Window.orderBy(F.desc_nulls_last(score), key))
    ranked = pool.withColumn("__s", by_score).withColumn("__top", F.col("__s") <= k - n_uncertain)
    by_spread = F.row_number().over(Window.partitionBy("__top").orderBy(F.desc_nulls_last(spread), key))
    chosen = ranked.withColumn("picked_by", F.when(F.col("__top"), "score").when(by_spread <= n_uncertain, "uncertainty"))
    return chosen.where("picked_by is not null").drop("__s", "__top")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def spread_ordinals(n: int, k: int) -> list[int]:
    """k near-even positions of 0 to n - 1, both ends among them."""
    if k >= n:
        return list(range(n))
    if k == 1:
        return [0]
    return sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})


def option_products(df: DataFrame, key: str, options: list[str]) -> DataFrame:
    """(key, ordinal, choice array): every combination of a row's option arrays, ordinals as mixed-radix numbers.

    One option after the other is exploded, so that no array of all combinations is made; a row with an
    empty option has none.
    """
    made = df.select(key, *options, F.lit(0).cast("long").alias("ordinal"), F.slice(options[0], 1, 0).alias("choice"))
    for o in options:
        kept = [key, *options, "choice", "ordinal"]
        made = made.select(*kept, F.posexplode(o).alias("__at", "__option"))
        made = made.withColumn("ordinal", F.col("ordinal") * F.size(o) + F.col("__at")).withColumn("choice", F.concat("choice", F.array("__option"))).select(*kept)
    return made.select(key, "ordinal", "choice")


def subsets(elements: Column, most: int = 12) -> Column:
    """All non-empty subsets of an array of at most ``most`` elements, by bit masks, smaller first."""
    n = F.least(F.size(elements), F.lit(most))
    masks = F.sequence(F.lit(1).cast("long"), (F.pow(F.lit(2.0), n) - 1).cast("long"))
    made = F.transform(masks, lambda m: F.filter(F.slice(elements, F.lit(1), n), lambda _, i: F.getbit(m, i) == 1))
    return F.transform(F.array_sort(F.transform(made, lambda s: F.struct(F.size(s).alias("n"), s.alias("s")))), lambda x: x["s"])


def element_frequency(df: DataFrame, formula: str = "formula", k: int = 24) -> DataFrame:
    """(element, n): the k elements that most formulas have."""
    each = df.select(F.explode(chem.elements(F.col(formula))).alias("element"))
    return each.groupBy("element").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "element").limit(k)


def tag(text: Column, rules: dict[str, list[str]]) -> Column:
    """The tags any of whose keywords a text has."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (low.contains(w) for w in words)), F.lit(t)) for t, words in rules.items())))


def tag_counts(df: DataFrame, tags: str = "tags") -> DataFrame:
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def bond_importance(edges: DataFrame) -> DataFrame:
    """(bond, n, importance): means by the sorted pair of elements."""
    bond = F.array_join(F.array_sort(F.array("a", "b")), "-")
    return edges.groupBy(bond.alias("bond")).agg(F.count("*").alias("n"), F.avg("importance").alias("importance"))


def parse_mutations(text: Column) -> Column:
    """'A->B;C->D' as an array of (old, new)."""
    pairs = F.filter(F.split(text, ";"), lambda p: F.regexp_like(p, F.lit(r"^\s*\w+\s*->\s*\w+\s*$")))
    return F.transform(pairs, lambda p: F.struct(F.trim(F.split_part(p, F.lit("->"), F.lit(1))).alias("old"), F.trim(F.split_part(p, F.lit("->"), F.lit(2))).alias("new")))


def update_substitutions(state: DataFrame | None, outcomes: DataFrame, decay: float = 0.95) -> DataFrame:
    """(old, new, n, reward): the state's counts decayed, and the round's (mutations, reward) added."""
    seen = outcomes.select(F.explode(parse_mutations(F.col("mutations"))).alias("m"), "reward").groupBy("m.old", "m.new").agg(F.count("*").cast("double").alias("n"), F.sum("reward").alias("reward"))
    if state is None:
        return seen
    old = state.select("old", "new", (F.col("n") * decay).alias("n"), (F.col("reward") * decay).alias("reward"))
    return old.unionByName(seen).groupBy("old", "new").agg(F.sum("n").alias("n"), F.sum("reward").alias("reward"))


def action_logits(state: DataFrame, prior: float = 0.0, weight: float = 1.0, explore: float = 0.5) -> DataFrame:
    """``state`` with ``logit``: prior, mean reward and a bound that shrinks with use."""
    whole = state.agg(F.sum("n").alias("__all"))
    return state.crossJoin(F.broadcast(whole)).withColumn("logit", prior + weight * F.col("reward") / F.greatest(F.col("n"), F.lit(1e-9)) + explore * F.sqrt(F.ln(1 + F.col("__all")) / (1 + F.col("n")))).drop("__all")  # one row


def seed_stability(assigned: DataFrame, seed: str = "seed", split: str = "split") -> DataFrame:
    """(split, seeds, mean, cv, relative_range) of the split sizes over seeds."""
    sizes = assigned.groupBy(seed, split).agg(F.count("*").alias("n"))
    return sizes.groupBy(split).agg(F.count("*").alias("seeds"), F.avg("n").alias("mean"), (F.stddev_pop("n") / F.avg("n")).alias("cv"), ((F.max("n") - F.min("n")) / F.avg("n")).alias("relative_range"))


def incumbent(history: DataFrame, energy: str, quantile: float | None = None) -> DataFrame:
    """One row: the least finite energy, or a quantile of them."""
    e = F.when(~F.isnan(energy) & (F.abs(F.col(energy)) < float("inf")), F.col(energy))
    return history.agg((F.min(e) if quantile is None else F.percentile(e, F.lit(quantile))).alias("incumbent"))


def screen(df: DataFrame, directions: dict[str, bool], key: str, k: int) -> DataFrame:
    """The k best by the sum of min-max scaled columns; a True direction means larger is better."""
    span = df.agg(*(x for c in directions for x in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"))))
    met = df.crossJoin(F.broadcast(span))  # one row
    parts = []
    for c, up in directions.items():
        x = F.coalesce(F.try_divide(F.col(c) - F.col(f"__lo_{c}"), F.col(f"__hi_{c}") - F.col(f"__lo_{c}")), F.lit(0.0))
        parts.append(x if up else 1 - x)
    return met.withColumn("screen_score", reduce(lambda a, b: a + b, parts)).select(*df.columns, "screen_score").orderBy(F.desc("screen_score"), key).limit(k)
