"""Mixing sources to target weights by a splitting tree over blocks. DataFrame functions only.

Each source's target is its weight's share of the whole draw, stopped at ``most_copies`` times its
size, the excess going to the others by weight. A source's documents fall by hash into blocks. Its
quota of block draws is whole passes over all its blocks and one further pass over blocks in permuted
order until the next block would pass the target; of that block, pieces and then documents are drawn
in permuted order while they come nearer to it.

The quotas of all sources go down a binary tree: at each node a random half of the draws, its exact
size fixed beforehand, goes left, so that what each source sends left is multivariate hypergeometric,
and every draw is in just one output shard. What a document's block was dealt is what the mix takes of
it. Within a shard documents are ordered by a hash.

A draw's place in the tree is its rank by a hash, told by the counts of hash ranges and by ranks within
a range, so that no task sees all draws. Sources' targets are told in one task from a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.llm._common import cut, free_name, n_space_words, sized

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2
BLOCKS_PER_SOURCE = 2048
ROWS_PER_BLOCK = 64
SHARDS = 16
ROWS_PER_PIECE = 1 << 16
SEED = 11


def _hash(seed: int, *columns: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *(F.col(c) if isinstance(c, str) else c for c in columns))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most_copies: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water filling under the caps.

    Weights repeat over the sources in code point order, null last. What a source takes is the lesser of
    its cap and level * weight; the level follows from the sources ordered by cap / weight.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    w = sizes.withColumn("weight", weight).withColumn("most", (F.col("source_size") * most_copies).cast("double"))
    w = w.withColumn("ratio", F.col("most") / F.col("weight"))
    up, whole = Window.orderBy("ratio", F.col("source").asc_nulls_last()), Window.partitionBy()
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("drawn", F.sum("source_size").over(whole) * share)
    w = w.withColumn("level", (F.col("drawn") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source in that order that the level leaves under its cap fixes the level for all that follow
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)
    return w.select("source", "source_size", F.when(free.isNull() | (F.col("ratio") < free["ratio"]), F.col("most")).otherwise(F.least("most", free["level"] * F.col("weight"))).alias("target"))


def _by_source(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """Left join by source (nulls are equal) and ``more``; ``right`` is broadcast if it is small."""
    names = ["source", *more]
    other = sized(cut(right)).withColumnsRenamed({n: f"{n}_r" for n in names})
    on = F.col("source").eqNullSafe(F.col("source_r"))
    for n in more:
        on = on & (F.col(n) == F.col(f"{n}_r"))
    return left.join(other, on, "left").drop(*(f"{n}_r" for n in names))


def _filled(units: DataFrame, unit: str, seed: int, nearest: bool = False) -> DataFrame:
    """(source, unit, whole, part, over) from (source, unit, unit_size, rest): units in permuted order until ``rest`` is met.

    ``part`` marks the unit that the rest ends in, ``over`` is what is left for it. With ``nearest``,
    a unit is whole while it comes nearer.
    """
    permuted = Window.partitionBy("source").orderBy(_hash(seed, unit), unit)
    start, size, rest = F.sum("unit_size").over(permuted) - F.col("unit_size"), F.col("unit_size"), F.col("rest")
    made = units.withColumn("start", start)
    whole = F.col("start") + (size / 2 if nearest else size) <= rest
    return made.select("source", unit, whole.alias("whole"), (~whole & (F.col("start") < rest)).alias("part"), (rest - F.col("start")).alias("over"))


def _shard_of(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """``draws`` (source, block, pass_no) with the leaf ``node`` that the splitting tree sends each to."""
    ranked = draws.withColumn("key", _hash(seed, "source", "block", "pass_no")).withColumn("range", F.shiftrightunsigned("key", 52))
    counts = ranked.groupBy("range").agg(F.count("*").alias("n"))  # at most 4,096 rows
    offset = F.sum("n").over(Window.orderBy("range")) - F.col("n")
    starts = counts.select("range", offset.alias("before"), F.sum("n").over(Window.partitionBy()).alias("n"))
    inside = Window.partitionBy("range").orderBy("key", "source", "block", "pass_no")
    tree = ranked.join(F.broadcast(starts), "range").withColumn("rank", F.col("before") + F.row_number().over(inside) - 1).withColumn("node", F.lit(0))
    for depth in range(shards.bit_length() - 1):
        # an odd draw goes left or right by a hash of the node
        left = F.floor((F.col("n") + F.pmod(_hash(seed + 1, F.lit(depth), "node"), F.lit(2))) / 2)
        goes = F.col("rank") >= F.col("left")
        tree = tree.withColumn("left", left).withColumn("right", goes.cast("int"))
        tree = tree.withColumn("rank", F.col("rank") - F.col("right") * F.col("left")).withColumn("n", F.when(F.col("right") == 1, F.col("n") - F.col("left")).otherwise(F.col("left"))).withColumn("node", F.col("node") * 2 + F.col("right"))
    return tree.select("source", "block", "pass_no", "node")


def _dealt(documents: DataFrame, weights: tuple, share: float, most_copies: int, blocks_per_source: int, shards: int, seed: int, whole_rows: bool) -> DataFrame:
    """source, row_hash, source_size, target, shards of every document, with doc_id and size or (``whole_rows``) ``row``, all its columns."""
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    keyed = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    keyed = keyed.select("row", F.col("row.source").alias("source"), F.xxhash64(F.lit(seed), F.col("row.doc_id"), F.col("row.text")).alias("row_hash"))
    narrow = cut(keyed.select(F.col("row.doc_id").alias("doc_id"), "source", "row_hash", n_space_words(F.col("row.text")).alias("size")))
    counts = cut(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")))
    goal = targets(counts.select("source", "source_size"), weights, share, most_copies)
    goal = _by_source(goal, counts.select("source", "source_rows"))
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most_copies), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    goal = goal.withColumn("blocks", F.greatest(F.lit(1), F.least(F.lit(blocks_per_source), F.ceil(F.col("source_rows") / ROWS_PER_BLOCK))).cast("int")).withColumn("passes", passes)
    goal = cut(goal.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    side = goal.select("source", "source_size", "target", "blocks", "passes", "rest")

    def placed(rows: DataFrame) -> DataFrame:
        return _by_source(rows, side).withColumn("block", F.pmod(_hash(seed + 1, "row_hash"), F.col("blocks")).cast("int")).withColumn("piece", F.pmod(_hash(seed + 7, "row_hash"), F.lit(blocks_per_source)).cast("int"))

    sizes = placed(narrow)
    block = sizes.groupBy("source", "block").agg(F.sum("size").alias("unit_size"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    block = cut(_by_source(_filled(block, "block", seed + 2), side.select("source", "passes")))
    # every pass of every block, and the blocks of the last pass, go down the tree
    last = (F.col("whole") | F.col("part")).cast("int")
    drawn = block.where(F.col("passes") + last > 0).select("source", "block", F.explode(F.sequence(F.lit(1), F.col("passes") + last)).alias("pass_no"))
    tree = _shard_of(drawn, shards, seed + 4).groupBy("source", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass_no", "node"))), lambda x: x["node"]).alias("nodes"))
    block = _by_source(block.drop("passes"), tree, "block")
    # the one block of each source that its rest ends in is told by pieces, one of these row by row
    inner = _by_source(sizes.drop("rest"), block.where("part").select("source", "block", F.col("over").alias("rest")), "block").where("rest is not null")
    piece = cut(_filled(inner.groupBy("source", "piece").agg(F.sum("size").alias("unit_size"), F.first("rest").alias("rest")), "piece", seed + 5))
    least = _by_source(inner.drop("rest"), piece.where("part").select("source", "piece", F.col("over").alias("rest")), "piece").where("rest is not null")
    alone = _filled(least.groupBy("source", "row_hash").agg(F.sum("size").alias("unit_size"), F.first("rest").alias("rest")), "row_hash", seed + 6, nearest=True)

    rows = _by_source(placed(keyed) if whole_rows else sizes, block.select("source", "block", "whole", "part", "nodes"), "block")
    rows = _by_source(rows, piece.select("source", "piece", F.col("whole").alias("piece_in")), "piece")
    rows = _by_source(rows, alone.where("whole").select("source", "row_hash", F.lit(True).alias("row_in")), "row_hash")
    extra = F.col("whole") | (F.col("part") & (F.coalesce("piece_in", F.lit(False)) | F.coalesce("row_in", F.lit(False))))
    nodes = F.coalesce("nodes", F.array().cast("array<int>"))
    taken = F.when(extra, nodes).otherwise(F.slice(nodes, F.lit(1), F.col("passes")))
    return rows.select(*(["row"] if whole_rows else ["doc_id", "size"]), "source", "row_hash", "source_size", "target", taken.alias("shards"))


def plan(documents: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most_copies: int = MOST_COPIES, blocks_per_source: int = BLOCKS_PER_SOURCE, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, row_hash, size, source_size, target, copies, shards) of every row.

    ``shards`` has the output shard of each copy. Null texts have size 0; rows without words are drawn
    like others; rows that repeat id, text and source are drawn alike; an empty table gives no rows.
    """
    rows = _dealt(documents, weights, share, most_copies, blocks_per_source, shards, seed, whole_rows=False)
    return rows.select("doc_id", "source", "row_hash", "size", "source_size", "target", F.size("shards").alias("copies"), "shards")


def mix(documents: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most_copies: int = MOST_COPIES, blocks_per_source: int = BLOCKS_PER_SOURCE, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The drawn rows, all columns, each as often as it is drawn, with ``mix_shard`` and ``mix_order``.

    Where ``documents`` has columns of these names, they stay, and the new ones have '_' appended.
    The rows are those that ``plan`` draws.
    """
    rows = _dealt(documents, weights, share, most_copies, blocks_per_source, shards, seed, whole_rows=True)
    shard, order = free_name(documents, "mix_shard"), free_name(documents, "mix_order")
    spread = rows.select("row", "row_hash", F.posexplode("shards").alias("copy", "shard"))
    return spread.select(*(F.col("row").getField(c).alias(c) for c in documents.columns), F.col("shard").alias(shard), _hash(seed + 8, "row_hash", "copy", "shard").alias(order))


def shuffled(documents: DataFrame, **how) -> DataFrame:
    """The drawn rows, ``documents``' columns alone, dealt by shard and in their shuffled order within it.

    A shard is split into as many ranges of its order as its rows ask for (ROWS_PER_PIECE a range), so
    that no task holds a whole shard; files of a shard follow one another in its order.
    """
    made = mix(documents, **how)
    shard, order = made.columns[-2:]
    ranges = 1 << max(0, (documents.count() // (how.get("shards", SHARDS) * ROWS_PER_PIECE)).bit_length())
    at = F.shiftrightunsigned(F.col(order), 64 - (ranges.bit_length() - 1)) if ranges > 1 else F.lit(0)  # its leading bits
    return made.repartition(F.col(shard), at).sortWithinPartitions(shard, order).select(*(F.col(f"`{c}`") for c in documents.columns))
