"""Benchmark decontamination by a prefix-filtered join of word shingles. DataFrame functions only.

Benchmark items are cut into windows of ``window`` consecutive words (an item of fewer words is one
window), and windows into shingles of ``shingle`` words. One pass over the documents keeps the
places where any benchmark shingle stands. Those places give each shingle's frequency; a window's
shingles are ordered by rarity, and only the first ``m - ceil(containment * m) + 1`` of its ``m``
shingles, its prefix, are joined: a window that occurs must share one of them. A joined place gives
the window's start; starts at which the window would leave the document are dropped (length and
position), and the rest are verified by counting the window's shingles that stand, text for text,
at their own offsets.

Broadcast: the benchmark's shingles, only while there are at most ``broadcast_shingles``; beyond
that the same join shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.llm._common import NOT_WORD, cut, with_words, sized

WINDOW = 10
SHINGLE = 5
BROADCAST_SHINGLES = 200_000


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window_id, n, words) and which item has which (window_id, item_id).

    Null texts and texts without a word have no window. Items with a null id have windows, but
    belong to no list of items. Items that share a window share its row.
    """
    items = with_words(benchmark.select("item_id", "text"), F.col("text"), "words", NOT_WORD, lower=True).where(F.size("words") > 0)
    starts = items.select("item_id", "words", F.explode_outer(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))).alias("at"))
    found = starts.select("item_id", F.slice("words", F.col("at"), F.least(F.lit(window), F.size("words"))).alias("words")).withColumn("window_id", F.sha2(F.concat_ws(" ", "words"), 256))
    windows = found.groupBy("window_id").agg(F.first("words").alias("words")).select("window_id", F.size("words").alias("n"), "words")
    return windows, found.where("item_id is not null").select("window_id", "item_id").distinct()


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(window_id, n, m, k, offset, said): the m shingles of each window; k is their length."""
    k = F.least(F.lit(shingle), F.col("n"))
    at = windows.select("window_id", "n", "words", k.alias("k"), (F.col("n") - k + 1).alias("m"), F.explode_outer(F.sequence(F.lit(0), F.col("n") - k)).alias("offset"))
    return at.select("window_id", "n", "m", "k", "offset", F.concat_ws(" ", F.slice("words", F.col("offset") + 1, F.col("k"))).alias("said"))


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, containment: float = 1.0, broadcast_shingles: int = BROADCAST_SHINGLES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, rows, items): where windows occur, every document's row, which item has a window.

    spans: (doc_id, text_hash, n_words, window_id, start, n); rows: (doc_id, text_hash, n_words,
    copies). A document's key is its id with the hash of its text: rows that repeat both are one
    key with ``copies`` over 1. Null texts have no words.
    """
    windows, owners = benchmark_windows(benchmark, window)
    pieces = cut(window_shingles(windows, shingle))
    known = cut(pieces.select("k", "said").distinct().withColumn("w", F.split("said", " ")))
    lengths = sorted(r.k for r in known.select("k").distinct().collect())  # at most ``shingle`` values
    small = known.count() <= broadcast_shingles

    def hashed(words: str, at, k: int):
        return F.xxhash64(*(F.get(words, at + i) for i in range(k)))

    h = F.coalesce(*(F.when(F.col("k") == k, hashed("w", F.lit(0), k)) for k in lengths), F.lit(0).cast("long"))
    keys = known.select(h.alias("h"), F.col("k").alias("k_known"), F.col("said").alias("said_known"))
    docs = with_words(documents.select("doc_id", "text"), F.col("text"), "words", NOT_WORD, lower=True)
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size("words").alias("n_words"), "words")
    # the outer form keeps documents without words, and keeps Spark from splitting each text again for an inferred filter
    at = docs.select("doc_id", "text_hash", "n_words", "words", F.posexplode_outer("words").alias("at", "word")).withColumn("at", F.coalesce("at", F.lit(0)))
    if len(lengths) < 2:
        k = lengths[0] if lengths else 0
        at = at.select("doc_id", "text_hash", "n_words", "words", "at", F.lit(k).alias("k"), (hashed("words", F.col("at"), k) if k else F.lit(None).cast("long")).alias("h"))
    else:
        tried = F.array(*(F.struct(F.lit(k).alias("k"), hashed("words", F.col("at"), k).alias("h")) for k in lengths))
        at = at.select("doc_id", "text_hash", "n_words", "words", "at", F.explode(tried).alias("t")).select("doc_id", "text_hash", "n_words", "words", "at", "t.k", "t.h")
    said = F.concat_ws(" ", F.slice("words", F.col("at") + 1, F.col("k")))
    is_row = (F.col("at") == 0) & (F.col("k") == (lengths[0] if lengths else 0))
    hit = F.col("said_known").isNotNull() & (F.col("k_known") == F.col("k")) & (F.col("at") + F.col("k") <= F.col("n_words"))
    if small:
        met = at.join(F.broadcast(keys), "h", "left").where(is_row | hit)
        places = met.select("doc_id", "text_hash", "n_words", "at", F.when(hit & (said == F.col("said_known")), F.col("said_known")).alias("said"), is_row.alias("is_row"))
    else:
        met = at.select("doc_id", "text_hash", "n_words", "at", "k", "h", said.alias("said")).join(keys, "h").where(hit & (F.col("said") == F.col("said_known")))
        rows = at.where(is_row).select("doc_id", "text_hash", "n_words", "at", F.lit(None).cast("string").alias("said"), F.lit(True).alias("is_row"))
        places = met.select("doc_id", "text_hash", "n_words", "at", "said", F.lit(False).alias("is_row")).unionAll(rows)
    places = cut(places.where("is_row or said is not null"))
    seen = places.where("said is not null").groupBy("said").agg(F.count("*").alias("seen"))
    stand = places.where("said is not null").select("doc_id", "text_hash", "n_words", "at", "said").distinct()
    ranked = pieces.join(seen, "said").select("window_id", "n", "m", "offset", "said", "seen")
    # shingles that stand nowhere are the rarest; a window that lacks more of them than containment allows can't occur
    ranked = ranked.join(ranked.groupBy("window_id").agg(F.count("*").alias("there"), F.max("m").alias("m_")).where(F.col("there") >= F.ceil(F.col("m_") * containment - 1e-9)).select("window_id", "there"), "window_id")
    order = F.row_number().over(Window.partitionBy("window_id").orderBy("seen", "said", "offset"))
    prefix = ranked.withColumn("rank", order).where(F.col("rank") <= F.col("there") - F.ceil(F.col("m") * containment - 1e-9) + 1)
    candidates = stand.join(prefix.select("said", "window_id", "n", "m", "offset"), "said").withColumn("start", F.col("at") - F.col("offset"))
    candidates = candidates.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words"))).select("doc_id", "text_hash", "n_words", "window_id", "n", "m", "start").distinct()
    expected = candidates.join(pieces.select("window_id", "offset", "said"), "window_id").withColumn("at", F.col("start") + F.col("offset"))
    same = expected.alias("e").join(stand.alias("s"), F.expr("e.doc_id <=> s.doc_id and e.text_hash = s.text_hash and e.n_words = s.n_words and e.at = s.at and e.said = s.said"), "left_semi")
    whole = same.groupBy("doc_id", "text_hash", "n_words", "window_id", "n", "m", "start").agg(F.count("*").alias("found"))
    spans = whole.where(F.col("found") >= F.ceil(F.col("m") * containment - 1e-9)).select("doc_id", "text_hash", "n_words", "window_id", "start", "n")
    every = places.where("is_row").groupBy("doc_id", "text_hash", "n_words").agg(F.count("*").alias("copies"))
    return spans, every, owners


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, containment: float = 1.0, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """One row for each document row: doc_id, text_hash, n_words, n_hit, spans, n_items, items, contaminated.

    ``spans`` are the merged word ranges [start, end) under any occurring window, ``items`` the
    sorted ids of items with one. An empty benchmark leaves all clean; an empty table of documents
    gives no rows; repeated rows get equal rows.
    """
    found, every, owners = find(documents, benchmark, window, shingle, containment, broadcast_shingles)
    key = ["doc_id", "text_hash", "n_words"]
    # the longest window at a start covers the others there; arrays are at most as long as the document
    starts = found.groupBy(*key, "start").agg(F.max("n").alias("n"))
    merged = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end")))),
        F.expr("named_struct('n', 0, 'last', 0)"),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["last"], x["start"]))).alias("n"), F.greatest(a["last"], x["end"]).alias("last")),
    )["n"]
    hits = starts.groupBy(*key).agg(merged.cast("long").alias("n_hit"))
    items = found.select(*key, "window_id").distinct().join(owners, "window_id").groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    same = F.expr("e.doc_id <=> x.doc_id and e.text_hash = x.text_hash and e.n_words = x.n_words")
    out = every.alias("e").join(hits.alias("x"), same, "left").select("e.*", F.coalesce("x.n_hit", F.lit(0)).alias("n_hit"))
    out = out.alias("e").join(items.alias("x"), same, "left").select("e.*", F.coalesce("x.items", F.array().cast("array<string>")).alias("items"))
    out = out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents, all their columns, in which no benchmark window occurs.

    Null texts and null ids are rows like others, and columns of any name stay.
    """
    found = cut(find(documents, benchmark, **how)[0].select("doc_id", "text_hash").distinct())
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col("row.text")) == F.col("text_hash"))
    return rows.join(sized(found), same, "left_anti").select("row.*")
