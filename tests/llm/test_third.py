"""Packing, collocations and spelling variants against plain restatements."""

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrolith.llm import collocations, packing, queries, spelling
from tests.llm import brute
from tests.llm.test_first import odd_documents, tables

tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(tokenizers.path("word_bpe_49k.json"))


def cut_up(docs, length=4096):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(PATH), []
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(doc_id, k, s, len(ids[s : s + length]), zlib.crc32(ids[s : s + length].tobytes())) for k, s in enumerate(range(0, len(ids), length))]
    return out


def best_fit(sizes, length):
    gaps, n = [], 0
    for x in sorted(sizes, reverse=True):
        i = bisect_left(gaps, x)
        g = gaps.pop(i) if i < len(gaps) else length
        n += i >= len(gaps) and g == length
        if g > x:
            insort(gaps, g - x)
    return n


def check_places(rows, length):
    """No sequence is over ``length`` and its pieces lie without a gap."""
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(held)


def test_packing(spark):
    docs = tables(spark, "documents")
    rows = queries.op11_packing(spark, brute.SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(cut_up([(r.doc_id, r.text) for r in docs.collect()]))
    n = check_places(rows, 4096)
    sizes = [r.length for r in rows]
    assert n <= max(-(-sum(sizes) // 4096), best_fit(sizes, 4096)) + 1


def test_packing_odd(spark):
    docs = odd_documents(spark)
    docs = docs.unionByName(spark.createDataFrame([(9, "a <|endoftext|>b<|startoftext|>", None, None, 0), (10, "étude ́x can't     y\x1cz " + "漢字" * 50, None, None, 0), (11, "w" * 1_200_000, None, None, 0)], docs.drop("window_id", "key").schema).withColumn("window_id", F.lit(1)).withColumn("key", F.lit("k")))
    docs = docs.withColumn("row", F.lit("r")).withColumn("bin", F.lit(0)).withColumn("size", F.lit(-1))
    packed = packing.pack(docs, PATH, length=64, with_ids=True)
    rows = packed.collect()
    want = cut_up([(r.doc_id, r.text) for r in docs.collect()], 64)
    assert sorted(map(repr, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows))) == sorted(map(repr, want))
    check_places(rows, 64)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids and r.offset in whole[r.sequence_id].starts
    assert packing.pack(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("kind", ["few", "mixed", "equal", "ones", "halves"])
@pytest.mark.parametrize("in_range", [200_000, 300])
def test_place(spark, monkeypatch, kind, in_range):
    rng, length = np.random.default_rng(5), 512
    sizes = {"few": [1, 512, 300], "mixed": np.minimum(rng.geometric(0.01, 3000), length), "equal": [150] * 1000, "ones": [1] * 2000, "halves": [256, 257] * 200}[kind]
    monkeypatch.setattr(packing, "RANGE_ROWS", in_range)
    from ferrolith.llm._common import saved

    lengths = saved(spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "id long, size long"))
    got = packing.place(lengths, length).collect()
    assert sorted((r.id, r.size) for r in got) == [(i, int(s)) for i, s in enumerate(sizes)]
    held = Counter()
    for r in got:
        held[r.bin] += r.size
    assert max(held.values()) <= length
    best = best_fit(map(int, sizes), length)
    assert len(held) <= best + max(1, best // 100)


def collocated(docs, order, least):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(brute.LOW)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    cands = {p: c for p, c in f.items() if len(p) > 2 and c >= least}
    gone = {(p[0], *p[i : i + k]) for p, c in cands.items() for k in range(2, len(p) - 1) for i in range(1, len(p) - k + 1) if f[(p[0], *p[i : i + k])] <= c}
    out = []
    for p, a in cands.items():
        if p not in gone:
            cuts = [(1000 * a * n[p[0]] // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            out.append((p[0], " ".join(p[1:]), a, f[p[: k + 1]], f[(p[0], *p[k + 1 :])], n[p[0]], score))
    return out


@pytest.mark.parametrize(("order", "least"), [(5, 4), (3, 2), (2, 3)])
def test_collocations(spark, monkeypatch, order, least):
    docs = tables(spark, "documents")
    want = collocated([(r.lang, r.text) for r in docs.collect()], order, least)
    assert len(want) > 500
    mined = collocations.mine(docs, order, least)
    assert sorted(map(tuple, mined.collect())) == sorted(want)
    if order == 3:
        first = [(r.phrase, r.rank) for r in collocations.top(mined, 20).where("lang = 'en'").orderBy("rank").collect()]
        ranked = sorted((w for w in want if w[0] == "en"), key=lambda w: (-w[6], -w[2], w[1].encode()))
        assert first == [(w[1], i) for i, w in enumerate(ranked[:20], 1)]


def test_collocations_odd(spark, monkeypatch):
    docs = odd_documents(spark).unionByName(odd_documents(spark).withColumn("lang", F.lit("und"))).withColumn("w1", F.lit("x")).withColumn("n", F.lit(7)).withColumn("f", F.lit(1))
    want = sorted(collocated([(r.lang, r.text) for r in docs.collect()], 5, 2))
    assert want and sorted(map(tuple, collocations.mine(docs, 5, 2).collect())) == want
    monkeypatch.setattr(collocations, "LEAST_BITS", 15)
    monkeypatch.setattr(collocations, "MOST_BITS", 15)
    monkeypatch.setattr(collocations, "GATHERED", 5)
    real = collocations._bitmap
    monkeypatch.setattr(collocations, "_bitmap", lambda *a: real(*a) | 255)  # full ones: nothing is cut short
    assert sorted(map(tuple, collocations.mine(docs, 5, 2).collect())) == want
    assert collocations.top(collocations.mine(docs.limit(0))).count() == 0


def test_collocation_scores_are_exact(spark):
    rows = [("x", 0, [], 10**15 - 1)] + [("x", 1, [w], 10**14 + 7) for w in "ab"] + [("x", 2, ["a", "b"], 10**14 + 5)]
    counted = spark.createDataFrame([("x", "a", "b", 10**14 + 5), ("x", "a", "", 2), ("x", "b", "", 10**14 + 7), ("x", "", "", 10**15 - 1 - 2 * 10**14 - 14)], "lang string, w1 string, w2 string, n long")
    assert sorted((r.lang, r.k, r.words, r.f) for r in collocations.phrases(counted, 2, 100).collect()) == sorted(rows)
    monkey = collocations.windows
    try:
        collocations.windows = lambda *_: counted
        (r,) = collocations.mine(counted, 2, 100).collect()
    finally:
        collocations.windows = monkey
    assert r.score == 1000 * (10**14 + 5) * (10**15 - 1) // (10**14 + 7) ** 2


def spelled(docs, least=7, noise=31):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % noise == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= 2}
    near = {w: set() for w in n}
    by = {}
    for w in n:
        for i in range(len(w)):
            by.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
            if (less := w[:i] + w[i + 1 :]) in n:
                near[w].add(less)
                near[less].add(w)
    for group in by.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return out


def told(got):
    return sorted(((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()), key=repr)


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_spelling(spark, bits):
    docs = tables(spark, "documents")
    want = spelled([(r.doc_id, r.text) for r in docs.collect()])
    assert any(w[3] for w in want)
    assert told(spelling.variants(spelling.vocabulary(docs), bits=bits)) == sorted(want, key=repr)


def test_spelling_odd(spark):
    rng = np.random.default_rng(3)
    long = "".join(rng.choice(list("abcdefgé"), 90))
    texts = [long, long[:40] + long[41:], long[:89], "x" + long, long[:5] + "q" + long[6:], "a" * 29, "a" * 30, "a" * 31, "a" * 32, "z" * 60_000, "z" * 60_001, "Straße×÷Ab", "straße×÷ab", "abcdefg", "abcdef", "bcdefgh"]
    rows = [(i, " ".join([t] * (2 + 20 * (i % 2)) + ["chained"] * (k := 3 * i) + ["chaned"] * (k // 7))) for i, t in enumerate(texts)]
    docs = odd_documents(spark).select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    docs = docs.withColumn("word", F.lit("w")).withColumn("run", F.lit("r")).withColumn("h", F.lit(0))
    want = sorted(spelled([(r.doc_id, r.text) for r in docs.collect()]), key=repr)
    assert told(spelling.variants(spelling.vocabulary(docs))) == want
    chain = [("basements", 3), ("basement", 40), ("casement", 500), ("casements", 6000), ("casemints", 6000), ("casementz", 600)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert got["basements"].form == "casements" and got["basement"].root == "casements" and got["casementz"].root == "casements"
    assert got["casements"].form is None and got["casements"].n_near == 4
    assert spelling.variants(spelling.vocabulary(docs.limit(0))).count() == 0


def test_sharding_splits_rows_that_repeat(spark):
    from ferrolith.llm import sharding

    hot = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text " * 20).alias("text"))
    rest = spark.range(1000).select((F.col("id") + 10).alias("doc_id"), F.concat(F.lit("text "), F.repeat(F.lit("w "), (F.col("id") % 90).cast("int")), "id").alias("text"))
    rows = sharding.assign(hot.unionAll(rest).withColumn("place", F.lit("p"))).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert sum(r.n for r in rows) == 2000 and len(rows) == 16 and all(r.last == r.n - 1 for r in rows)
    mean = sum(r.b for r in rows) / 16
    assert max(abs(r.b / mean - 1) for r in rows) < 0.05 and max(abs(r.n / 125 - 1) for r in rows) < 0.25


def test_one_range_of_a_sweep_needs_no_shuffle(spark, monkeypatch):
    from ferrolith.llm import packing

    table = packing.saved(spark.range(300).selectExpr("id", "1 + id * 37 % 100 as size"))
    monkeypatch.setattr(type(table), "repartitionByRange", None)
    placed = packing.place(table, 100).collect()
    load = {}
    for r in placed:
        load[r.bin] = load.get(r.bin, 0) + r.size
    assert len(placed) == 300 and max(load.values()) <= 100
