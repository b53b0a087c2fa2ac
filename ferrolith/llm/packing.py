"""Best-fit packing of token sequences, bulk-synchronous.

Documents are tokenized once, in Arrow batches; texts over ``length`` tokens are cut into pieces. A full
piece is a sequence of its own, and so is at first one of over half a sequence; what is left free in a
sequence is its gap. All other pieces are placed class by class of length, longest first. A class takes
sweeps until it is placed:

1. pieces and gaps are range-sorted together by size, descending;
2. each piece looks for its successor, the smallest gap that is no smaller. Inside a range tasks match
   them as brackets match, gaps opening and pieces closing; a gap opens once for each piece of the
   largest size at hand that it holds, at least once. What stays unmatched in a range has a rank there,
   and ranges settle these among each other by ranks, from one row of counts for each range;
3. gaps shrink by what was placed, and the rest of the class meets them again.

Pieces that no gap takes open sequences, as few as their tokens and their number ask for, and these are
gaps of the next sweep. Classes, and sweeps within a class, are bounded by ``length``, not by the rows.

Each sweep is written to the shared folder, so that plans don't grow and lost executors cost one sweep.
Many equal lengths are told apart by a hash, and so no range is one length. A piece is a row of two
numbers in the sweeps; texts and ids never move.

Null texts are empty: just the end mark. Repeated rows are packed each. Empty tables give no rows. Only
doc_id and text are read, so that other columns' names can't clash.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.llm._common import saved
from ferrolith.llm._words import slices, split_words

LENGTH = 4096
END = 1
#: Words, and ids of them, that a worker keeps before it begins anew.
KEPT_WORDS, KEPT_IDS = 600_000, 10_000_000
#: Words that the tokenizer gets at a time.
PARTED = 1_000
#: Words of letters of ASCII and Latin-1, and punctuation that may end a word.
LATIN, TAILS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"), b".,;:!?"
#: Classes of pieces end at these parts of a sequence.
CLASSES = (2, 3, 4, 6, 12, 48)
#: A sweep over the gaps there are is worth while if they could take one in so many of the pieces left.
WORTH = 8
#: Rows of a range of a sweep.
RANGE_ROWS = 200_000


class Tokens:
    """Ids of texts, by the whole or, for a tokenizer to which white space only parts words, each distinct word once.

    What a tokenizer does to white space, case, punctuation and ends of words is tried when it is loaded.
    Where letters and the punctuation behind them are coded apart, a word ends there too. Words of Latin
    letters, which are one token or end with one that ends a word, go to the tokenizer in one text; other
    words go in a text parted by a special token, which is told before words are. Texts that hold a
    special token's string are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are as many as there are cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in added.values()]
        parting = [(i, t.content) for i, t in added.items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        ids = lambda *texts: [i for x in self.whole(list(texts)) for i in x.tolist()]
        self.by_words = bool(parting) and all(ids(x) == ids("ab", "cd") for x in ("ab cd", "\t ab\ncd\x0b\x0c\r", "ab  cd "))
        self.mark, self.parting = parting[0] if parting else (None, "")
        self.lower = ids("Ab CD Éc Çà") == ids("ab cd Éc Çà")
        self.tails = TAILS if all(ids(f"ab{c}{x}cd") == ids("ab", f"{c}{x}cd") for c in TAILS.decode() for x in ("", " ", "'", "5", "é", ".", "\u0301")) else b""
        words = [w for w, _ in sorted(self.tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.array([bool(suffix) and w.endswith(suffix) for w in words] + [False] * len(added))
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, and how many each has."""
        (ids,) = self.whole([self.parting.join(w.decode() for w in words)])
        ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
        return ids[ids != self.mark], np.diff(ends, prepend=-1) - 1

    def spaced(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that are told by tokens that end words."""
        (ids,) = self.whole([b" ".join(words).decode()])
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(words) or len(ids) != ends[-1] + 1:
            return self.parted(words)
        return ids, np.diff(ends, prepend=-1)

    def learn(self, words: list[bytes]) -> None:
        latin = [bool(LATIN.fullmatch(w)) for w in words] if self.ends.any() else [False] * len(words)
        flat, sizes = [self.flat], [self.sizes]
        for how, some in ((self.spaced, [w for w, x in zip(words, latin, strict=True) if x]), (self.parted, [w for w, x in zip(words, latin, strict=True) if not x])):
            for s in range(0, len(some), PARTED):
                ids, each = how(some[s : s + PARTED])
                assert len(each) == len(some[s : s + PARTED])
                flat.append(ids)
                sizes.append(each)
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some)), strict=True))
        self.flat, self.sizes = np.concatenate(flat), np.concatenate(sizes)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; nulls are empty."""
        raw = texts.cast(pa.large_binary()).to_pylist()
        if not self.by_words:
            return self.whole([(t or b"").decode() for t in raw])
        whole = [i for i, t in enumerate(raw) if t and any(s in t for s in self.special)]
        if whole:
            texts = pa.array([b"" if i in set(whole) else t for i, t in enumerate(raw)], pa.large_binary())
        words = split_words(texts, b" \t\n\x0b\x0c\r", lower=self.lower, tails=self.tails)
        if len(self.known) > KEPT_WORDS or len(self.flat) > KEPT_IDS:
            self.clear()
        self.learn([w for w in words.values if w not in self.known])
        own = np.fromiter(map(self.known.__getitem__, words.values), np.int64, len(words.values))
        each = self.sizes[own][words.codes]
        begins = (np.cumsum(self.sizes) - self.sizes)[own][words.codes]
        ends = np.cumsum(each)
        every = self.flat[np.repeat(begins - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.searchsorted(words.rows, np.arange(len(texts)), "right")
        out = np.split(every, np.append(0, ends)[last][:-1]) if len(texts) else []
        for i, ids in zip(whole, self.whole([raw[i].decode() for i in whole]), strict=True):
            out[i] = ids
        return out


@lru_cache(1)
def _tokens(path: str) -> Tokens:
    """One for each worker process: it takes as long to load as some megabytes to encode."""
    return Tokens(path)


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """Rows (row, doc_id, piece, start, length, ids_crc32), and ``ids`` as little-endian unsigned 32-bit numbers if asked for.

    ``row`` numbers the pieces, as long as the table that this is written to is read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer)
        for b in slices(batches, "text"):
            at, piece, start, size, crc, raw = [], [], [], [], [], []
            for i, ids in enumerate(tokens(b.column("text"))):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for k, s in enumerate(range(0, len(ids), length)):
                    part = ids[s : s + length].tobytes()
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    size.append(len(part) // 4)
                    crc.append(crc32(part))
                    if with_ids:
                        raw.append(part)
            cols = [b.column("doc_id").take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(raw, pa.binary())] if with_ids else cols, [*names, "ids"] if with_ids else names)

    out = docs.select("doc_id", "text").mapInArrow(cut_up, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{', ids binary' if with_ids else ''}")
    return out.withColumn("row", F.monotonically_increasing_id())


PLACED, ALONE, GAP, ENDS = range(4)


def _matched(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """One range, sorted, as rows of four kinds.

    PLACED: a piece with the ``bin`` whose gap it closes. ALONE: one that closes none, with its ``rank``
    among these. GAP: what is left of a gap, how many pieces it still takes (``slots``), how many slots lie
    between it and the range's end (``rank``) and whether it took one (``bin``: 1 or 0). ENDS: one row,
    how many pieces are alone (``id``) and how many slots open (``size``).
    """
    part = TaskContext.get().partitionId()
    ids, sizes, gaps = [], [], []
    for b in batches:
        ids.append(b.column("id").to_numpy(zero_copy_only=False))
        sizes.append(b.column("size").to_numpy(zero_copy_only=False))
        gaps.append(b.column("gap").to_numpy(zero_copy_only=False))
    if not ids:
        return
    ids, sizes, gaps = np.concatenate(ids), np.concatenate(sizes), np.concatenate(gaps).astype(bool)
    slots = np.where(gaps, np.maximum(sizes // most, 1), 0)
    owner, left, open_ = np.full(len(ids), -1), slots.copy(), []
    for i in range(len(ids)) if not gaps.all() else ():
        if gaps[i]:
            open_.append(i)
        elif open_:
            g = open_[-1]
            owner[i] = g
            left[g] -= 1
            if not left[g]:
                open_.pop()
    placed = owner >= 0
    alone = ~gaps & ~placed
    sizes_left = sizes - np.bincount(owner[placed], sizes[placed], len(ids)).astype(np.int64)
    rank = np.where(gaps, np.cumsum(left[::-1])[::-1] - left, np.cumsum(alone) - 1)
    kind = np.where(gaps, GAP, np.where(placed, PLACED, ALONE))
    bins = np.where(gaps, left < slots, ids[np.maximum(owner, 0)])
    cols = [np.append(ids, alone.sum()), np.append(np.where(gaps, sizes_left, sizes), left.sum()), np.append(kind, ENDS), np.append(bins, 0), np.append(left, 0), np.append(rank, 0), np.full(len(ids) + 1, part)]
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["id", "size", "kind", "bin", "slots", "rank", "part"])


class Sweep(NamedTuple):
    placed: DataFrame  # (id, size, bin)
    gaps: DataFrame  # (id, size): what is left of all gaps
    rest: DataFrame  # (id, size): pieces that no gap takes
    left: int  # how many these are
    tokens: int  # and how long together
    least: int  # and the shortest of them
    most: int  # and the longest
    able: int  # gaps that took a piece now and could take the shortest


def sweep(todo: DataFrame, gaps: DataFrame, most: int, rows: int) -> Sweep:
    """One sweep: pieces ``todo`` (id, size), none over ``most``, into ``gaps`` (id, size); ``rows`` in all."""
    both = todo.select("id", "size", F.lit(False).alias("gap")).unionAll(gaps.select("id", "size", F.lit(True).alias("gap")))
    order = [F.desc("size"), F.desc("gap"), F.xxhash64("id"), F.col("id")]
    ranges = rows // RANGE_ROWS
    ranged = (both.repartitionByRange(ranges, *order) if ranges > 1 else both.coalesce(1)).sortWithinPartitions(*order)  # one range needs no shuffle
    found = saved(ranged.mapInArrow(lambda it: _matched(it, most), "id long, size long, kind long, bin long, slots long, rank long, part long"))
    ends = sorted((r.part, r.id, r.size) for r in found.where(F.col("kind") == ENDS).collect())
    open_, shares = [], []  # ranges settle by ranks: a row for each range, and at most two shares for each
    for part, closed, free in ends:
        at = 0
        while at < closed and open_:
            g, taken, n = open_[-1]
            k = min(n, closed - at)
            shares.append((part, at, at + k, g, taken - at))
            at += k
            open_[-1] = (g, taken + k, n - k)
            if n == k:
                open_.pop()
        if free:
            open_.append((part, 0, free))
    placed = found.where(F.col("kind") == PLACED).select("id", "size", "bin")
    alone = found.where(F.col("kind") == ALONE).select("id", "size", "part", "rank")
    gaps = found.where(F.col("kind") == GAP).select("id", "size", (F.col("bin") == 1).alias("took"))
    spark, rest = todo.sparkSession, alone.select("id", "size")
    if shares:
        table = F.broadcast(spark.createDataFrame(shares, "in long, low long, high long, g long, plus long"))
        alone = alone.join(table, (F.col("part") == F.col("in")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
        alone = alone.select("id", "size", "g", (F.col("rank") + F.col("plus")).alias("slot"))
        used: dict[int, int] = {}
        for _, low, high, g, plus in shares:
            used[g] = max(used.get(g, 0), high + plus)
        last = F.broadcast(spark.createDataFrame(list(used.items()), "g long, used long"))
        taking = found.where((F.col("kind") == GAP) & (F.col("slots") > 0)).join(last, F.col("part") == F.col("g")).where("rank < used")
        taking = taking.select(F.col("id").alias("bin"), "g", F.explode(F.sequence("rank", F.least(F.col("rank") + F.col("slots"), F.col("used")) - 1)).alias("slot"))
        settled = saved(alone.join(taking, ["g", "slot"], "left").select("id", "size", "bin"))
        across = settled.where("bin is not null")
        placed, rest = placed.unionAll(across), settled.where("bin is null").select("id", "size")
        less = across.select(F.col("bin").alias("id"), (-F.col("size")).alias("size"), F.lit(True).alias("took"))
        gaps = saved(gaps.unionAll(less).groupBy("id").agg(F.sum("size").alias("size"), F.max("took").alias("took")))
    left = gaps.where("size > 0").select("id", "size")
    n = sum(closed for _, closed, _ in ends) - sum(high - low for _, low, high, _, _ in shares)
    if not n:
        return Sweep(placed, left, rest, 0, 0, 0, 0, 0)
    tokens, least, longest = rest.agg(F.sum("size"), F.min("size"), F.max("size")).first()
    return Sweep(placed, left, rest, n, tokens, least, longest, gaps.where(F.col("took") & (F.col("size") >= least)).count())


def classes(length: int) -> list[tuple[int, int]]:
    """(low, high] of the classes below half a sequence, longest first."""
    cuts = sorted({length // j for j in CLASSES} - {0}, reverse=True)
    return [(low, high) for high, low in zip(cuts, [*cuts[1:], 0], strict=True)]


def place(lengths: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (id, size, bin): a sequence for each piece of ``lengths`` (id: distinct, 0 or more; size: 1 to ``length``).

    ``lengths`` should be a written table, as each class reads it. A sequence is named by the long piece
    that opened it, or by a negative number.
    """
    spark = lengths.sparkSession
    own = lengths.where(F.col("size") > length // 2).select("id", "size", F.col("id").alias("bin"))
    gaps = own.select("id", (F.lit(length) - F.col("size")).alias("size")).where("size > 0")
    cuts = classes(length)
    counts = {r["k"]: r for r in lengths.where(F.col("size") <= length // 2).groupBy(F.expr(" + ".join(f"int(size <= {high})" for _, high in cuts) or "0").alias("k")).agg(F.count("*").alias("n"), F.sum("size").alias("tokens"), F.min("size").alias("least"), F.max("size").alias("most")).collect()}
    done, opened, bins = [own], 0, own.count()
    for k, (low, high) in enumerate(cuts, 1):
        if k not in counts:
            continue
        todo = lengths.where((F.col("size") > low) & (F.col("size") <= high)).select("id", "size")
        n, tokens, least, most = (counts[k][c] for c in ("n", "tokens", "least", "most"))
        fits = bins > 0  # the first sweep looks at the gaps there are
        while n:
            if not fits:
                new = max(-(-tokens // length), -(-n // (length // least)))
                gaps = gaps.unionAll(spark.range(opened + 1, opened + new + 1).select((-F.col("id")).alias("id"), F.lit(length).cast("long").alias("size")))
                opened, bins = opened + new, bins + new
            got = sweep(todo, gaps, most, n + bins)
            done.append(got.placed)
            todo, gaps, n, tokens, least, most = got.rest, got.gaps, got.left, got.tokens, got.least, got.most
            fits = got.able * WORTH >= n
    return reduce(DataFrame.unionAll, done)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """``pieces`` with the ``sequence_id`` and the ``offset`` in it of each, longest first in a sequence."""
    cut_up = saved(pieces(docs, tokenizer, length, end, with_ids))
    placed = place(cut_up.select(F.col("row").alias("id"), F.col("length").alias("size")), length)
    at = Window.partitionBy("bin").orderBy(F.desc("size"), "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(F.col("id").alias("row"), F.col("bin").alias("sequence_id"), F.coalesce(F.sum("size").over(at), F.lit(0)).alias("offset"))
    return cut_up.join(placed, "row").drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids, starts): the ids of each sequence in order and where its pieces begin; ``packed`` has ``ids``."""
    by = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most a sequence's tokens
    got = packed.groupBy("sequence_id").agg(by.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return got.select("sequence_id", joined.alias("ids"), F.col("p.offset").alias("starts"))
