"""Phrase collocation mining by top-order marginalisation.

For each place the window of the longest order, that word and the words that lead it, padded where its
piece of text ends, is all that is counted; a ROLLUP sums the counts of successively shorter prefixes,
and these are the counts of all shorter phrases, so that no order is exploded or counted by itself.

Windows are kept short where that is provably harmless: a first pass counts words and pairs by 64-bit
hashes, a second one the triples that frequent pairs make, and a window ends before a pair or triple that
occurs fewer than ``least`` times, as no phrase across it can be a candidate. Those that do occur so often
are told by bitmaps, whose false positives only leave windows longer than need be. Their sizes follow the
number of what is frequent, up to MOST_BITS; beyond that they fill up and fewer windows are cut, with the
same result.

Null texts are empty, a null lang is ``und``; other columns than lang and text are not read, so that
their names can't clash; repeated rows count as often as they occur; an empty table has no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.llm._common import saved
from ferrolith.llm._words import Words, slices, split_words

ORDER = 5
LEAST = 100
TOP = 2000
SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Bits of the bitmap of frequent words and pairs: 64 MB at most.
LEAST_BITS, MOST_BITS, BITS_A_KEY = 20, 29, 16
#: Hashes that a task gathers before it adds equal ones up and sends them.
GATHERED = 2_000_000


def _named(b: pa.RecordBatch, words: Words) -> tuple[np.ndarray, list[str]]:
    """For each word the number of its language, and the languages."""
    named = b.column("lang").dictionary_encode()
    return named.indices.to_numpy(zero_copy_only=False)[words.rows].astype(np.int64), named.dictionary.to_pylist()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two; not the same for (b, a)."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019) + (a >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _shifted(x: np.ndarray, k: int) -> np.ndarray:
    """``x`` from its place ``k`` on, filled up with zeros."""
    return np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])


def _keys(words: Words, lang: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word with its language, and of it with the next one and the next two words."""
    hashes = np.array([xxhash.xxh64_intdigest(v) for v in words.values], np.uint64)
    tongue = np.array([xxhash.xxh64_intdigest(v.encode()) for v in langs], np.uint64)
    one = _mixed(tongue[lang], hashes[words.codes])
    each = hashes[words.codes]
    two = _mixed(one, _shifted(each, 1))
    return one, two, _mixed(two, _shifted(each, 2))


def _triples(pairs: np.ndarray) -> np.ndarray:
    """Where a pair begins that the next word begins another one."""
    return pairs & _shifted(pairs, 1)


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(np.add.reduceat(c[order], first))], ["h", "n"])


def _hashed(batches: Iterator[pa.RecordBatch], pairs: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Hashes of words and pairs, or given the bitmap of frequent ``pairs`` of triples made of such, with counts in parts of a task."""
    hashes, counts, held = [], [], 0
    for b in slices(batches, "text"):
        words = split_words(b.column("text"), SPACES, BREAKS, lower=True)
        if not len(words.codes):
            continue
        one, two, three = _keys(words, *_named(b, words))
        for x in (one, two[words.linked]) if pairs is None else (three[_triples(words.linked & _test(pairs, two))],):
            h, c = np.unique(x, return_counts=True)
            hashes.append(h)
            counts.append(c)
            held += len(h)
        if held >= GATHERED:
            yield _summed(hashes, counts)
            hashes, counts, held = [], [], 0
    if held:
        yield _summed(hashes, counts)


def _bitmap(docs: DataFrame, least: int, pairs: Broadcast | None = None) -> np.ndarray:
    """A bitmap over the low bits of the hashes of ``_hashed`` that occur ``least`` times or more."""
    counted = docs.mapInArrow(lambda it: _hashed(it, pairs.value if pairs else None), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    keys = saved(counted.where(F.col("n") >= least).select("h"))
    bits = min(MOST_BITS, max(LEAST_BITS, (keys.count() * BITS_A_KEY).bit_length()))
    place = F.col("h").bitwiseAND((1 << bits) - 1) + 1  # Spark counts a bitmap's places from 1
    parts = keys.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("b"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for k, b in parts.toLocalIterator():  # 4 KB each, 64 MB together at most
        out[(k - 1) * len(b) : k * len(b)] = np.frombuffer(b, np.uint8)
    return out


def _test(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def windows(docs: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """Rows (lang, w1 .. w``order``, n): how often each window of the longest order occurs; '' pads.

    Only what can be part of a phrase of ``least`` occurrences is told apart: a window ends before the
    first rarer pair or triple, and a rarer first word is '' too.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    shared = docs.sparkSession.sparkContext.broadcast
    frequent = shared(_bitmap(docs, least))
    longer = shared(_bitmap(docs, least, frequent)) if order > 2 else None
    names = [f"w{k + 1}" for k in range(order)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words = split_words(b.column("text"), SPACES, BREAKS, lower=True)
            if not len(words.codes):
                continue
            lang, langs = _named(b, words)
            one, two, three = _keys(words, lang, langs)
            going, pairs = _test(frequent.value, one), words.linked & _test(frequent.value, two)
            triples = _triples(pairs) & _test(longer.value, three) if longer else pairs
            code, v = words.codes + 1, len(words.values) + 1
            leads = [np.where(going, code, 0)]
            for k in range(1, order):  # a place has its k-th lead if the pair, then all triples before it are frequent
                going = going & (pairs if k == 1 else _shifted(triples, k - 2))
                leads.append(np.where(going, _shifted(code, k), 0))
            values = pa.array([b"", *words.values], pa.binary()).cast(pa.string())
            several = leads[min(1, order - 1)] > 0
            for places in (np.flatnonzero(~several), np.flatnonzero(several)):
                keys = lang[places]
                for c in leads if places.size and several[places[0]] else leads[:1]:
                    keys = np.unique(keys * v + c[places], return_inverse=True)[1]
                _, first, n = np.unique(keys, return_index=True, return_counts=True)
                at = places[first]
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(lang[at])), *(values.take(pa.array(c[at])) for c in leads), pa.array(n.astype(np.int64))], ["lang", *names, "n"])

    rows = docs.mapInArrow(counted, f"lang string, {', '.join(f'{w} string' for w in names)}, n long")
    return rows.groupBy("lang", *names).agg(F.sum("n").alias("n"))


def phrases(counted: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """Rows (lang, k, words, f): each phrase of k words that occurs ``least`` times or more; k = 0: all words of a language.

    A ROLLUP over ``windows``: the sum for a prefix of k words is the number of places where they stand.
    """
    names = [f"w{k + 1}" for k in range(order)]
    summed = counted.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("__g"))
    k = F.lit(order) - F.length(F.regexp_replace(F.bin("__g"), "0", ""))
    rows = summed.where(F.col("lang").isNotNull()).withColumn("k", k.cast("int"))
    words = F.slice(F.array(*names), F.lit(1), F.col("k"))
    return rows.select("lang", "k", words.alias("words"), "f").where((F.col("k") == 0) | ((F.col("f") >= least) & (F.element_at(F.concat(F.array(F.lit("")), "words"), -1) != "")))


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def mine(docs: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """Candidates (lang, phrase, a, l, r, n, score) that no longer candidate explains: phrases of 2 to ``order`` words.

    score: floor(1000 a n / (l r)) of the cut that scores least, ties to the shortest first part. A
    candidate goes if a longer one with as many occurrences holds its words; as counts never grow with
    length, one with one word more then does so too, and only those are looked up. Products are
    decimals of 38 digits: exact while a and n are below 10^17.
    """
    known = saved(phrases(windows(docs, order, least), order, least))
    all_words = known.where("k = 0").select("lang", F.col("f").alias("n"))
    counts = known.where("k > 0").select("lang", _phrase(F.col("words")).alias("part"), F.col("f").alias("part_f"))
    longer = known.where("k > 2").select("lang", F.explode(F.array(_phrase(F.slice("words", 1, F.col("k") - 1)), _phrase(F.slice("words", 2, F.col("k") - 1)))).alias("phrase"), F.col("f").alias("over"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    cands = known.where("k > 1").select("lang", _phrase(F.col("words")).alias("phrase"), "words", "k", F.col("f").alias("a"))
    cands = cands.join(longer, ["lang", "phrase"], "left").where("over is null or over < a")
    cuts = cands.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", _phrase(F.slice("words", F.lit(1), F.col("cut"))).alias("first"), _phrase(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("first"), F.col("part_f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("part").alias("rest"), F.col("part_f").alias("r")), ["lang", "rest"]).join(all_words, "lang")
    cuts = cuts.withColumn("score", F.expr("(1000BD * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))").cast("long"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("c"))
    return best.select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")


def top(mined: DataFrame, most: int = TOP) -> DataFrame:
    """Each language's first ``most`` by score descending, a descending, phrase by UTF-8 bytes; with their ``rank`` from 1."""
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return mined.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most).withColumn("rank", F.col("rank").cast("long"))
