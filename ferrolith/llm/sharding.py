"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows of equal text are a group and stay in one shard, unless the group alone passes a shard's share
of bytes, tokens or rows; then it is split by a hash of its ids, and of its rows where an id repeats. Groups of some weight (over a
64th of a shard in any of the three, so at most 3 * 64 * shards of them) are placed one by one; all
others are bundled by a hash of their text into ``bundles`` bundles. The driver sees the vectors of
these bounded units alone. Heaviest first, a unit goes where the dot product of its vector with the
residual capacity is highest. Shards whose residual of bytes is far from the largest don't count: far
is WIDE of the mean residual, so less and less, and NEAR at last, so that the law ``bytes`` holds
(sizes near equal) while tokens and rows are balanced on the way.

Slots count through a shard unit by unit, so that rows are numbered within units only.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolith.llm._common import cut, n_space_words

SHARDS = 16
BUNDLES = 8192
WIDE, NEAR = 0.25, 0.002


def place(vectors: np.ndarray, shards: int = SHARDS, wide: float = WIDE, near: float = NEAR) -> np.ndarray:
    """The shard of each row of ``vectors`` (bytes, tokens, rows), heaviest first; no rows give none."""
    total = np.maximum(vectors.sum(axis=0), 1)
    share = vectors * shards / total
    left = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), int)
    for i in np.lexsort((np.arange(len(vectors)), -share.max(axis=1))):
        v = share[i]
        room = left[:, 0]
        fit = room >= room.max() - max(near, wide * room.mean())
        out[i] = int(np.argmax(np.where(fit, left @ v, -np.inf)))
        left[out[i]] -= v
    return out


def assign(documents: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, text_md5, shard, slot) of every row.

    A null text is as an empty one (size 1). Repeated rows get slots of their own, and are split among
    shards where they are many; an empty table gives no rows. Only doc_id and text are read, so that
    other columns' names can't clash.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), n_space_words(text).alias("tokens"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_md5")))
    sums = (F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
    total = [float(x or 0) for x in rows.agg(*sums).first()]
    fair = [max(x / shards, 1) for x in total]
    heavy = " or ".join(f"{c} > {x / 64}" for c, x in zip("btr", fair, strict=True))
    groups = rows.groupBy("text_md5").agg(*sums).where(heavy).orderBy("text_md5").collect()  # at most 3 * 64 * shards
    table = []
    for i, g in enumerate(groups):
        over = max(g[c] / x for c, x in zip("btr", fair, strict=True))
        table.append((g.text_md5, i, over > 1, min(4096, math.ceil(over * bundles / shards / 8)) if g.r > 1 else 1))
    big = spark.createDataFrame(table, "big_md5 string, big int, apart boolean, pieces int")
    rows = rows.join(F.broadcast(big), F.col("text_md5") == F.col("big_md5"), "left")
    # ids decide the piece; rows of one that alone has much of a piece are told apart by their place in the written table
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    often = rows.where("apart").groupBy("text_md5", "doc_id").agg(*sums).where(" or ".join(f"{c} > {x / 64}" for c, x in zip("btr", fair, strict=True)))
    often = F.broadcast(often.select(F.col("text_md5").alias("o_md5"), F.col("doc_id").alias("o_id"), F.lit(True).alias("often")))  # at most 3 * 64 * shards
    rows = rows.join(often, (F.col("text_md5") == F.col("o_md5")) & F.col("doc_id").eqNullSafe(F.col("o_id")), "left")
    piece = F.pmod(F.when(F.col("often"), F.xxhash64("doc_id", F.lit(3), "place")).otherwise(F.xxhash64("doc_id", F.lit(3))), F.col("pieces")).cast("int")
    unit = F.when(F.col("big").isNull(), F.struct(F.lit(-1).alias("big"), F.pmod(F.xxhash64("text_md5"), F.lit(bundles)).cast("int").alias("piece"))).otherwise(F.struct("big", piece.alias("piece")))
    rows = rows.withColumn("unit", unit)
    units = rows.groupBy("unit").agg(*sums).select("unit.*", "b", "t", "r").orderBy("big", "piece").collect()  # bundles and pieces
    apart = {row[1]: row[2] for row in table}
    named, vectors, of = {}, [], []
    for u in units:
        key = (u.big, None if u.big >= 0 and not apart[u.big] else u.piece)
        k = named.setdefault(key, len(named))
        if k == len(vectors):
            vectors.append([0, 0, 0])
        vectors[k] = [x + y for x, y in zip(vectors[k], (u.b, u.t, u.r), strict=True)]
        of.append(k)
    at = place(np.array(vectors, float).reshape(-1, 3), shards)
    start, dealt = [0] * shards, []
    for u, k in zip(units, of, strict=True):
        shard = int(at[k])
        dealt.append((u.big, u.piece, shard, start[shard]))
        start[shard] += u.r
    kind = T.StructType([T.StructField(n, t) for n, t in (("d_big", T.IntegerType()), ("d_piece", T.IntegerType()), ("shard", T.IntegerType()), ("start", T.LongType()))])
    deal = spark.createDataFrame(dealt, kind)
    rows = rows.join(F.broadcast(deal), F.expr("unit.big = d_big and unit.piece = d_piece"))
    order = Window.partitionBy("unit").orderBy("doc_id", "text_md5")
    return rows.withColumn("slot", F.col("start") + F.row_number().over(order) - 1).select("doc_id", "size", "tokens", "text_crc32", "text_md5", "shard", "slot")
