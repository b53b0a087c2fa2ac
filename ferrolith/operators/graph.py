"""Connected components of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.operators.ordered import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) of links (a, b: long): root is the least node that can be reached; nodes without a link to another are left out.

    Large and small stars in turn: each node's greater neighbours are hung on the least node it knows, then
    all it knows are. Each round is cut. It ends when a round changes nothing, in about the logarithm of
    the longest path, whatever that is. A hub joins its one least node, so its rows may be split.
    """
    now = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        hung = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = hung.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        now = cut(hung.join(least, "a").select(pairs).select("e.*").where("a <> b").distinct())
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new
