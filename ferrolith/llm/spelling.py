"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols, so that a word becomes a short number: its reduced word. From each
distinct reduced word the full neighbourhood of one edit is generated (itself, deletions, replacements
and insertions, over the symbols alone); it is joined to the reduced vocabulary, and what meets is
verified on the original strings by edit distance. An edit of a word is an edit of its reduced word or
leaves it as it is, so that no near pair is missed; how many symbols there are decides work, not results.

Words too long for a number of 62 bits are found otherwise, exactly too: one edit leaves the first or
the last half of PART letters as it is, so such words meet by their length and either of these.

Null texts have no words, a null doc_id is the empty text in the hash that deletes letters; repeated rows
count as often as they occur; empty tables have no words. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.llm._common import ascii_lower, saved

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A form is this many times as frequent as its word.
TIMES = 10
#: One in so many occurrences loses a letter.
NOISE = 31
#: Symbols (a power of 2 as bits) and the vocabulary from which on there are more of them.
BITS, MANY, MORE_BITS = 2, 4_000_000, 3
LETTERS = "".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)]))


def occurrences(docs: DataFrame, least: int = LEAST_LETTERS, noise: int = NOISE) -> DataFrame:
    """Rows (word): every occurrence of ``least`` code points or more, letters lost by the hash of id and run."""
    run = F.explode(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(rf"[a-z\x{{C0}}-\x{{FF}}]{{{least},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__d"), run.alias("run"))
    h = runs.withColumn("h", F.crc32(F.concat_ws(":", "__d", "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, cast(h % char_length(run) as int))"), F.substring("run", at + 2, F.char_length("run")))
    return h.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least)


def vocabulary(docs: DataFrame, least: int = LEAST_LETTERS, count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """Rows (word, n) of the words that occur ``count`` times or more; summed in each task before the shuffle."""
    return occurrences(docs, least, noise).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def symbol(letter: str, bits: int) -> int:
    """The symbol of a letter: a multiplicative hash of its code point."""
    return (ord(letter) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)


def reduced(word: Column, bits: int) -> Column:
    """The reduced word as a number: a leading 1, then ``bits`` for each letter."""
    digits = F.translate(word, LETTERS, "".join(str(symbol(c, bits)) for c in LETTERS))
    return F.conv(F.concat(F.lit("1"), digits), 1 << bits, 10).cast("long")


def neighbourhood(key: str, bits: int) -> Column:
    """All reduced words within one edit of the reduced word ``key``, itself included; an array."""
    s, full = 1 << bits, (1 << bits) - 1
    length = f"cast((length(bin({key})) - 1) / {bits} as int)"
    low = f"({key} & (shiftleft(1L, {bits} * i) - 1))"
    upper = f"shiftright({key}, {bits} * (i + 1))"
    replaced = f"transform(sequence(0, {full}), x -> shiftleft(shiftleft({upper}, {bits}) + x, {bits} * i) + {low})"
    deleted = f"array(shiftleft({upper}, {bits} * i) + {low})"
    inserted = f"transform(sequence(0, {full}), x -> shiftleft(shiftleft(shiftright({key}, {bits} * i), {bits}) + x, {bits} * i) + {low})"
    inner = f"flatten(transform(sequence(0, {length} - 1), i -> concat({replaced}, {deleted}, {inserted})))"
    last = f"flatten(transform(sequence({length}, {length}), i -> {inserted}))"
    assert s <= 16
    return F.array_distinct(F.concat(F.expr(inner), F.expr(last)))


def near_pairs(words: DataFrame, bits: int) -> DataFrame:
    """Rows (word, near), both ways round, of the different ``words`` (word) that one edit parts; ``words`` is a written table."""
    most = 60 // bits  # letters of a neighbour at most, so that numbers have 62 bits
    short = words.where(F.char_length("word") <= most).select("word", reduced(F.col("word"), bits).alias("key"))
    keys = short.select("key").distinct()
    around = keys.select("key", F.explode(neighbourhood("key", bits)).alias("other"))
    met = around.join(keys.select(F.col("key").alias("other")), "other")
    pairs = short.join(met, "key").join(short.select(F.col("word").alias("near"), F.col("key").alias("other")), "other")
    part = most // 2
    long_ = words.where(F.char_length("word") >= most).select("word", F.char_length("word").alias("size"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, part).alias("part")), F.struct(F.lit(1).alias("side"), F.expr(f"right(word, {part})").alias("part"))))
    halves = long_.select("word", "size", ends.alias("e")).select("word", "size", "e.*")
    others = halves.select(F.col("word").alias("near"), F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"), "side", "part")
    longer = halves.join(others, ["size", "side", "part"]).where(F.greatest(F.char_length("word"), F.char_length("near")) > most)
    pairs = pairs.select("word", "near").unionAll(longer.select("word", "near").distinct())
    return pairs.where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))


def variants(words: DataFrame, times: int = TIMES, bits: int | None = None) -> DataFrame:
    """``words`` (word: distinct, n) with n_near, form, form_n and root.

    form: the near word of largest n, ties to the first in code-point order, if that n is ``times`` the
    word's or more; root: what forms lead to at last. A step multiplies n, so a chain has few, and they
    are followed two, four, eight at a time.
    """
    words = saved(words.select("word", "n"))
    bits = bits or (BITS if words.count() <= MANY else MORE_BITS)
    pairs = near_pairs(words, bits).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b"))
    told = words.join(best, "word", "left").withColumn("ok", -F.col("b.m") >= times * F.col("n"))
    told = saved(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("ok"), F.col("b.w")).alias("form"), F.when(F.col("ok"), -F.col("b.m")).alias("form_n")))
    steps = told.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # as long as some root has a form itself
        nexts = steps.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        steps = saved(steps.join(nexts, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        if steps.where("moved").isEmpty():
            break
        steps = steps.select("word", "root")
    return told.join(steps.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
