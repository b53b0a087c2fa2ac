"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are made in Arrow batches. Equal fingerprints become one node, so copies are never
compared. Two fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of ``blocks``
blocks of bits, so nodes meet only in the groups of those that agree on such blocks; each group is
sorted by population count and cut into tiles, and numpy compares tile against tile by exclusive or
and bit counts, skipping tiles whose counts lie beyond the radius. What a group returns is a
spanning star of each of its components: no link between different texts is lost, none is repeated.
A group of over ``most_tiled`` nodes is not gathered in a task: it is cut into cells of equal population
count, those over ``most_tiled`` nodes by a hash, and each pair of cells whose counts lie within the
radius is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.llm._common import components, cut, sized

SEED = 42
SHINGLE = 3
BITS = 64
RADIUS = 2
BLOCKS = 4
TILE = 256
MOST_TILED = 16_384
CHUNK = 65_536


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text; 0 where it has no words."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space alone
    n = len(words)
    if not n:
        return 0
    said = b" ".join(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(said, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[: n - shingle] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(said[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes``."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        some = hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            made = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _stars(fp: np.ndarray, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of one group's components of two nodes or more, without the roots' own rows."""
    pops = np.bitwise_count(fp)
    order = np.argsort(pops, kind="stable")
    left, pops = fp[order], pops[order].astype(np.int64)
    nodes, roots = [], []
    while len(left) > 1:
        front, front_pop, got = left[:1], pops[:1], [left[:1]]
        left, pops = left[1:], pops[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(front), tile):
                some, some_pop = front[i : i + tile], front_pop[i : i + tile]
                lo, hi = np.searchsorted(pops, [some_pop.min() - radius, some_pop.max() + radius + 1])
                for j in range(lo, hi, 8 * tile):
                    k = min(j + 8 * tile, hi)
                    near[j:k] |= (np.bitwise_count(some[:, None] ^ left[None, j:k]) <= radius).any(axis=0)
            front, front_pop = left[near], pops[near]
            left, pops = left[~near], pops[~near]
            got.append(front)
        if len(part := np.concatenate(got)) > 1:
            root = part.view(np.int64).min()
            others = part.view(np.int64)[part.view(np.int64) != root]
            nodes.append(others)
            roots.append(np.full(len(others), root))
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(nodes or empty), np.concatenate(roots or empty)


def _links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of equal key; the rows are sorted by key."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(edge)
    two = edge[:-1][size == 2]
    near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
    a, b = [fp[two][near].view(np.int64)], [fp[two + 1][near].view(np.int64)]
    for at, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
        x, y = _stars(fp[at : at + n], radius)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, most_tiled: int = MOST_TILED) -> DataFrame:
    """(a, b) links between distinct ``fp``, enough to span each component of those within ``radius`` bits."""
    if BITS % blocks or not 0 < radius < blocks:
        raise ValueError("blocks must divide 64, and radius be under blocks")
    width = BITS // blocks
    masks = [sum(((1 << width) - 1) << (width * i) for i in kept) for kept in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keyed = nodes.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)))).alias("key"))
    count = keyed.groupBy("key").agg(F.count("*").alias("n"))
    small = keyed.join(count.where(F.col("n").between(2, most_tiled)).select("key"), "key", "left_semi")
    large = keyed.join(count.where(F.col("n") > most_tiled).select("key"), "key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            key = np.concatenate((key, b.column(0).to_numpy()))
            fp = np.concatenate((fp, b.column(1).to_numpy().view(np.uint64)))
            if len(key):
                whole = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
                x, y = _links(key[:whole], fp[:whole], radius)
                key, fp = key[whole:], fp[whole:]
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
        if len(key):
            x, y = _links(key, fp, radius)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    # large groups: pairs of cells instead
    of_pop = large.withColumn("pop", F.bit_count("fp"))
    cells = cut(of_pop.groupBy("key", "pop").agg(F.ceil(F.count("*") / most_tiled).cast("int").alias("cells")))  # at most 65 rows a large group
    placed = of_pop.join(sized(cells), ["key", "pop"]).withColumn("cell", F.pmod(F.xxhash64(F.lit(SEED), "fp"), F.col("cells")).cast("int"))
    other = sized(cells.select("key", F.col("pop").alias("other_pop"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other_cell")))
    own, their = F.struct("pop", "cell"), F.struct(F.col("other_pop").alias("pop"), F.col("other_cell").alias("cell"))
    paired = placed.join(other, "key").where(F.abs(F.col("pop") - F.col("other_pop")) <= radius)
    paired = paired.select(F.xxhash64("key", F.least(own, their), F.greatest(own, their)).alias("key"), "fp")
    return small.select("key", "fp").unionAll(paired).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, blocks: int = BLOCKS, most_tiled: int = MOST_TILED) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    The component's id is the smallest doc_id that links within ``radius`` bits reach. Null and
    blank texts have fingerprint 0 and are linked like others; repeated rows get equal rows; null
    ids are never the smallest (a component of null ids alone has a null id); an empty table gives
    no rows.
    """
    made = cut(fingerprints(documents, shingle))
    nodes = cut(made.groupBy("fp").agg(F.min("doc_id").alias("least")))
    star = components(links(nodes, radius, blocks, most_tiled))
    rooted = nodes.join(star, nodes["fp"] == star["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return made.join(named, "fp").select("doc_id", "fp", "component_id")


def row_hash() -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def first_of_each(documents: DataFrame, found: DataFrame) -> DataFrame:
    """One row of each ``root`` of ``found`` (doc_id, row, root), all columns: that of the smallest doc_id, null ids last.

    Columns of any name stay.
    """
    pick = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("p"))
    kept = cut(pick.select(F.col("p.row").alias("hash"), F.col("p.doc_id").alias("id")))
    marked = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("all"), row_hash().alias("hash_of"))
    met = marked.join(kept, (F.col("hash_of") == F.col("hash")) & F.col("all.doc_id").eqNullSafe(F.col("id")), "left_semi")
    # of rows that repeat id and text, any one stays
    return met.dropDuplicates(["hash_of"]).select("all.*")


def keep_one(documents: DataFrame, **how) -> DataFrame:
    """One row of each component, all columns: that of the smallest doc_id, null ids last."""
    ids = documents.select(F.struct("doc_id", row_hash().alias("row")).alias("doc_id"), "text")
    found = near_duplicates(ids, **how)
    return first_of_each(documents, found.select("doc_id.doc_id", "doc_id.row", F.col("component_id").alias("root")))
