"""Near duplicates by the Jaccard similarity of five-word shingles, 0.8 at least.

Equal shingle sets become one node. Every node goes through operator 5's method first: SimHash fingerprints
of the shingles, those within 2 bits told by tiles (`simhash.links`). At 0.8 fingerprints differ in 5 to 10
bits, so nodes also meet where one of 32 bands of four MinHash values agrees: a pair at 0.8 meets nowhere
with a chance of 5e-8, and less beyond. All that meet are compared, on the whole sets, unless they are in
one component already; no pairs of a band's members are made.

First come the links of the fingerprints, and a pass over the bands that is cheap and settles most: every
band has one head, that of its nodes which meets most others, as copies are more like what they were copied
from than like each other; every node is compared with the head with which it shares most bands. Where bands
of over TILE_NODES nodes still hold several components, up to PASSES more passes over these bands alone
follow, with heads drawn anew, of other components and not tried before.

Then what is left is settled for good, however few the passes were: nodes of bands that still hold several
components, in clusters of such bands, are dealt into tiles of TILE_NODES nodes or TILE_HASHES hashes, large
components into tiles of their own. All pairs of tiles are compared in numpy, but for two tiles of the same
component; a pair of tiles is a group of bounded size, and gives at most one link for each of its components.
So every pair of nodes that meet is compared or already linked, and no link is lost but by the chance above.

The number of jobs doesn't grow with the rows, and tables of a few numbers a row are held in few partitions:
it is jobs and tasks, not rows, that fill the driver's heap, and small files the disks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.llm import simhash
from ferrolith.llm._common import components, few, release, remove_saved, saved, sized
from ferrolith.llm.simhash import CHUNK, SEED, first_of_each, row_hash

SHINGLE = 5
LEAST = 0.8
BANDS = 32
PER_BAND = 4
#: Nodes and hashes that a tile has on average, at most.
TILE_NODES, TILE_HASHES = 512, 1_000_000
#: Passes over crowded bands after the first, at most; tiles settle the rest.
PASSES = 4
#: Columns of the product that counts common hashes.
WIDTH = 8192
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * PER_BAND, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * PER_BAND, np.uint64) * np.uint64(2)


def shingles(text: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``n`` words; of all words where they are fewer, none without words."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    said = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(said, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - n] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(said[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], np.uint64))


def band_keys(found: np.ndarray) -> list[int]:
    """A signed 64-bit key of each band of MinHash values; none of an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * PER_BAND, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), CHUNK // 64):
        least = np.minimum(least, (found[i : i + CHUNK // 64, None] * _TIMES + _PLUS).min(axis=0))
    kept = least.astype("<u8").tobytes()
    width = 8 * PER_BAND
    keys = [xxhash.xxh64_intdigest(kept[width * i : width * (i + 1)], i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _signed(documents: DataFrame) -> DataFrame:
    """(doc_id, row, fp, bits, keys) of every row: fp is a digest of the shingle set, bits its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(2).cast(pa.binary())]
            fp = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets)).view(np.int64)
            bits = np.fromiter((simhash.majority(s) for s in sets), np.uint64, len(sets)).view(np.int64)
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp), pa.array(bits), keys], ["doc_id", "row", "fp", "bits", "keys"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", row_hash().alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, row long, fp long, bits long, keys array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(fp, s) of (fp, text): the sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()).view(np.int64) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["fp", "s"])

    return texts.mapInArrow(run, "fp long, s array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows of ``pairs`` (a, b, and others) whose sets' Jaccard similarity is ``least`` or more."""
    left = sets.select(F.col("fp").alias("a"), F.col("s").alias("x")).join(sized(pairs), "a")
    right = sets.select(F.col("fp").alias("b"), F.col("s").alias("y")).join(sized(saved(pairs.select("b").distinct())), "b", "left_semi")
    both = left.join(right, "b")
    can = both.where(F.least(F.size("x"), F.size("y")) >= least * F.greatest(F.size("x"), F.size("y")) - 1e-9)
    same = F.size(F.array_intersect("x", "y"))
    return can.where(same >= least * (F.size("x") + F.size("y") - same) - 1e-9).drop("x", "y")


def _tile_links(least: float):
    """Links between components of a pair of tiles, (fp, root, side, s): one for each component at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "root", "fp"], ignore_index=True)
        sizes = pdf.s.map(len).to_numpy()
        _, flat = np.unique(np.concatenate(pdf.s.tolist()), return_inverse=True)
        owner = np.repeat(np.arange(len(pdf)), sizes)
        left = np.flatnonzero(pdf.side.to_numpy() == 0)
        right = np.flatnonzero(pdf.side.to_numpy() == 1)
        right = right if len(right) else left
        often = (np.bincount(flat[np.isin(owner, left)], minlength=flat.max(initial=0) + 1) > 0) & (np.bincount(flat[np.isin(owner, right)], minlength=flat.max(initial=0) + 1) > 0)
        often &= np.bincount(flat) > 1
        column = np.cumsum(often) - 1
        kept = often[flat]
        at, who = column[flat[kept]], owner[kept]
        order = np.argsort(at, kind="stable")
        at, who, common = at[order], who[order], np.zeros((len(left), len(right)), np.float32)
        for c in range(0, int(often.sum()), WIDTH):
            low, high = np.searchsorted(at, (c, c + WIDTH))
            has = np.zeros((len(pdf), min(WIDTH, int(often.sum()) - c)), np.float32)
            has[who[low:high], at[low:high] - c] = 1
            common += has[left] @ has[right].T
        same = common.astype(np.float64)
        root = pdf.root.to_numpy()
        near = (same >= least * (sizes[left][:, None] + sizes[right][None] - same) - 1e-9) & (root[left][:, None] != root[right][None])
        i, j = np.nonzero(near)
        pairs = np.unique(np.sort(np.stack([root[left][i], root[right][j]], 1), axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
        above: dict[int, int] = {}

        def find(x: int) -> int:
            while above.get(x, x) != x:
                x = above[x]
            return x

        links = []
        for x, y in pairs.tolist():
            x, y = find(x), find(y)
            if x != y:
                above[max(x, y)] = min(x, y)
                links.append((min(x, y), max(x, y)))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _alike(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (fp, bits) that operator 5's tiles link, enough to span what they link."""
    hubs = saved(nodes.groupBy("bits").agg(F.min("fp").alias("hub")))
    equal = nodes.join(hubs, "bits").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    stars = simhash.links(hubs.select(F.col("bits").alias("fp"))).distinct()
    ends = [hubs.select(F.col("bits").alias(x), F.col("hub").alias(f"hub_{x}")) for x in "ab"]
    return equal.unionAll(stars.join(ends[0], "a").join(ends[1], "b").select("hub_a", "hub_b")).where("a <> b")


def _partners(now: DataFrame, turn: int, tried: DataFrame | None = None) -> DataFrame:
    """(a, root, b, other) of ``now`` (fp, key, root, meets): each node with a band's head in another component."""
    chance = (F.xxhash64(F.lit(turn), "fp").bitwiseAND(F.lit((1 << 53) - 1)) + 1) / F.lit(float(1 << 53))
    rank = -F.ln(chance) / F.pow("meets", F.lit(4)) if turn else -F.col("meets")
    heads = now.groupBy("key").agg(F.min_by(F.struct("fp", "root"), F.struct(rank, "fp")).alias("head"))
    met = now.join(heads, "key").where("root <> head.root").groupBy("fp", "root", "head").agg(F.count("*").alias("bands"))
    met = met.select(F.col("fp").alias("a"), "root", F.col("head.fp").alias("b"), F.col("head.root").alias("other"), "bands")
    if tried is not None:
        met = met.join(tried, ["a", "b"], "left_anti")
    return met.groupBy("a", "root").agg(F.max(F.struct("bands", "b", "other")).alias("p")).select("a", "root", "p.b", "p.other")


def _settled(keyed: DataFrame, label: DataFrame, n: int, sets: DataFrame, least: float) -> DataFrame | None:
    """All links (a, b) between components of ``label`` whose nodes meet: see the module, the last step. None where none meet."""
    now = few(keyed.select("fp", "key").join(label.select("fp", "root"), "fp"), BANDS * n)
    open_ = now.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("fp").alias("hub")).where("r0 <> r1").select("key", "hub")
    edges = saved(few(few(now.join(open_, "key").select(F.col("fp").alias("a"), F.col("hub").alias("b")), BANDS * n).distinct(), n))
    if edges.isEmpty():
        return None
    clusters = components(edges).select(F.col("node").alias("fp"), F.col("root").alias("cluster"))
    nodes = few(edges.select(F.col("a").alias("fp")).unionAll(edges.select(F.col("b").alias("fp"))).distinct(), n)
    nodes = nodes.join(clusters, "fp", "left").select("fp", F.coalesce("cluster", "fp").alias("cluster")).join(label.select("fp", "root"), "fp").join(sets.select("fp", F.size("s").alias("size")), "fp")
    nodes = saved(few(nodes, n))
    tiles = F.ceil(F.greatest(F.sum("n") / TILE_NODES, F.sum("hashes") / TILE_HASHES))
    by_root = saved(few(nodes.groupBy("cluster", "root").agg(F.count("*").alias("n"), F.sum("size").alias("hashes")), n))
    large = (F.col("n") > TILE_NODES) | (F.col("hashes") > TILE_HASHES)
    own = by_root.where(large).groupBy("cluster", "root").agg(tiles.alias("tiles"))
    rest = by_root.where(~large).groupBy("cluster").agg(tiles.alias("tiles"))
    dealt = saved(few(own.unionByName(rest.withColumn("root", F.lit(None).cast("long"))), n))
    own, rest = dealt.where("root is not null"), dealt.where("root is null").drop("root")
    placed = nodes.join(own, ["cluster", "root"], "left").join(rest.withColumnRenamed("tiles", "shared"), "cluster", "left")
    alone = F.col("tiles").isNotNull()
    placed = few(placed.select("fp", "root", "cluster", F.when(alone, F.col("root")).alias("of"), F.when(alone, F.pmod(F.xxhash64("fp"), "tiles")).otherwise(F.pmod(F.xxhash64("root"), "shared")).alias("tile")), n)
    each = dealt.select("cluster", F.col("root").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"))
    left, right = F.struct("of", "tile").alias("x"), F.struct("of", "tile").alias("y")
    pairs = few(each.select("cluster", left).join(each.select("cluster", right), "cluster").where("x <= y and (x.of is null or y.of is null or x.of <> y.of)"), n)
    pairs = pairs.withColumn("pair", F.monotonically_increasing_id())
    ends = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("t"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("x").alias("t"), F.lit(0).alias("side")), F.struct(F.col("y").alias("t"), F.lit(1).alias("side"))))
    sent = saved(pairs.select("cluster", "pair", F.explode(ends).alias("e")).select("cluster", "pair", "e.side", F.coalesce("e.t.of", F.lit(0).cast("long")).alias("of"), F.col("e.t.of").isNull().alias("shared"), "e.t.tile"))
    met = placed.select("fp", "root", "cluster", F.coalesce("of", F.lit(0).cast("long")).alias("of"), F.col("of").isNull().alias("shared"), "tile").join(sent, ["cluster", "of", "shared", "tile"])
    met = few(met.select("pair", "side", "fp", "root"), n).join(sets, "fp")
    return saved(few(met.groupBy("pair").applyInPandas(_tile_links(least), "a long, b long").distinct(), n))


def near_duplicates(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, row, fp, root) of every row: ``root`` names its component, ``row`` is a hash of id and text.

    Null and blank texts have the empty set and are copies of each other. Null ids are rows like others. An
    empty table gives no rows; other columns are not read, so that their names can't clash.
    """
    spark = documents.sparkSession
    made = saved(_signed(documents))
    nodes = saved(made.groupBy("fp").agg(F.min("row").alias("row"), F.min("bits").alias("bits"), F.min("keys").alias("keys")))
    meet = nodes.select("fp", F.explode("keys").alias("key"))
    shared = meet.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    keyed = saved(meet.join(shared, "key"))
    release(spark)
    alike = saved(_alike(nodes.where(F.size("keys") > 0).select("fp", "bits")))
    meets = keyed.select("fp", "members").unionAll(alike.select(F.explode(F.array("a", "b")).alias("fp"), F.lit(0).cast("long"))).groupBy("fp").agg(F.sum("members").cast("double").alias("meets"))
    shown = saved(nodes.select("fp", "row").join(meets, "fp"))
    n = shown.count()
    texts = documents.select(row_hash().alias("row"), F.col("text").cast("string").alias("text")).join(sized(shown.select("fp", "row")), "row").select("fp", "text")
    sets = saved(_sets(texts).groupBy("fp").agg(F.first("s").alias("s")))  # repeated rows have equal sets
    release(spark)

    label = few(shown.select("fp", F.col("fp").alias("root"), "meets"), n)

    def joined(links: DataFrame) -> DataFrame:
        moved = components(links).withColumnRenamed("root", "to")
        return saved(few(label.join(moved, F.col("root") == F.col("node"), "left").select("fp", F.coalesce("to", "root").alias("root"), "meets"), n))

    now = keyed.select("fp", "key").join(label, "fp")
    tried = saved(few(_partners(now, 0).select("a", "b").unionAll(alike).distinct(), n))
    label = joined(saved(few(_verified(tried, sets, least).select("a", "b"), n)))
    release(spark)
    crowded = keyed.where(F.col("members") > TILE_NODES).select("fp", "key")
    for turn in range(1, 0 if crowded.isEmpty() else PASSES + 1):
        pairs = saved(few(_partners(few(crowded.join(label, "fp"), BANDS * n), turn, tried), n))
        linked = saved(few(_verified(pairs, sets, least).select(F.col("root").alias("a"), F.col("other").alias("b")).distinct(), n))
        if linked.isEmpty():
            break
        tried = tried.unionAll(pairs.select("a", "b"))
        label = joined(linked)
        release(spark)
    links = _settled(keyed, label, n, sets, least)
    label = label if links is None else joined(links)
    named = saved(few(label.select(F.col("fp").alias("node"), "root"), n))
    remove_saved(nodes, keyed, alike, sets)
    release(spark)
    return made.join(sized(named), F.col("fp") == F.col("node"), "left").select("doc_id", "row", "fp", F.coalesce("root", "fp").alias("root"))


def keep_one(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of each component, all columns, whatever their names: that of the smallest doc_id, null ids last."""
    return first_of_each(documents, near_duplicates(documents, least))
