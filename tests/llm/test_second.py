"""Operators 2, 3, 7, 8 and 10 against brute force, and their edge cases."""

import base64
import gzip
import hashlib
import math
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ferrolith.llm import chat, licenses, lm, queries, rules, warc
from tests.llm import brute
from tests.llm.test_first import odd_documents, tables

SF = "/root/testdata/sf0.01"


def licensed(docs):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for doc, text in docs:
        w = brute.words(text)
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        yield doc, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licenses(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op2_licenses(spark, SF).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(licensed([(r.doc_id, r.text) for r in docs.collect()]), key=lambda r: r[0])
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)
    assert any("cc-by-nc" in r.labels for r in got)


def test_licenses_odd(spark):
    notice = licenses.NOTICES[6][1].split()
    docs = odd_documents(spark).select("doc_id", "text").unionAll(spark.createDataFrame([
        (20, "MIT License mit license\nApache-LICENSE general public license"), (20, "MIT License mit license\nApache-LICENSE general public license"),
        (21, "a b " + " ".join(notice[:8]) + " oddly put in " + " ".join(notice[8:]) + " c"), (22, "in source and binary"), (23, "license"),
    ], "doc_id long, text string"))
    got = licenses.report(docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(licensed([(r.doc_id, r.text) for r in docs.collect()]))
    by = {r.doc_id: r for r in got}
    assert by[21].labels == "bsd" and by[21].spans[0].start == 2 and by[21].spans[0].end == 2 + len(brute.words(" ".join(notice))) + 3
    assert by[22].labels == by[23].labels == "" and by[20].score == 1
    half = "this source code form is subject to the "
    twice = spark.createDataFrame([(1, half * 2), (2, half + "terms of the " + half + "terms"), (3, half + "terms of the Mozilla Public License, v. 2.0")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.report(twice).collect()} == {1: "", 2: "", 3: "mpl"}
    assert licenses.report(docs.limit(0)).count() == 0


def archived(pages, least=0):
    top = {}
    for page, _, html in pages:
        data = (html or "").encode()
        if page is not None and len(data) >= least:
            top[data] = max(top.get(data, page), page)
    seen = Counter((html or "").encode() for _, _, html in pages)
    done = set()
    for page, _, html in sorted(pages, key=lambda p: (p[0] is not None, p[0] or 0)):
        data = (html or "").encode()
        revisit = len(data) >= least and seen[data] > 1 and data in top and (page != top[data] or data in done)
        if page == top.get(data):
            done.add(data)
        yield page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top[data] if revisit else None


def test_warc(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = queries.op3_warc(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(archived([tuple(r) for r in pages.collect()]), key=lambda r: r[0])


def test_warc_odd(spark, tmp_path):
    rows = [(1, "http://a/\nx", "same"), (2, None, "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300_000), (None, "v", "same"), (None, None, "alone"), (9, "w", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit(1))
    for name, least in (("a", 0), ("b", 1)):
        warc.write_archives(pages, f"file://{tmp_path}/{name}", shard_bytes=1000, roll_bytes=2000, revisit_bytes=least)
        got = warc.read_archives(spark, f"file://{tmp_path}/{name}", payloads=True)
        assert sorted(map(repr, map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))) == sorted(map(repr, archived(rows, least)))
        assert all(bytes(r.payload) == dict(((p, h and len(h)), (h or "").encode()) for p, _, h in rows).get((r.page_id, r.payload_bytes or None), bytes(r.payload)) for r in got.where("record_type = 'response'").collect())
    warc.write_archives(pages.repartition(3), f"file://{tmp_path}/again", shard_bytes=1000, roll_bytes=2000)
    files = {p.name: p.read_bytes() for p in (tmp_path / "a").glob("*.warc.gz")}
    assert files == {p.name: p.read_bytes() for p in (tmp_path / "again").glob("*.warc.gz")} and len(files) > 2
    assert all(gzip.decompress(x).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for x in files.values())
    listed = {r.file: r for r in warc.read_manifest(spark, f"file://{tmp_path}/a").collect()}
    assert {n: hashlib.sha256(x).hexdigest() for n, x in files.items()} == {n: r.sha256 for n, r in listed.items()}
    assert not list(Path(tmp_path / "a").glob("_temporary*"))
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def based(docs):
    held = {d: brute.rem(d, 10) == 0 for d, _ in docs}
    count = Counter(t for d, text in docs if not held[d] for t in [*brute.tokens(text, lower=True), None])
    n, v = sum(count.values()), len(count)
    for d, text in docs:
        tokens = [*brute.tokens(text, lower=True), None]
        yield d, held[d], len(tokens), sum(count[t] > 0 for t in tokens), n, sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)


@pytest.mark.parametrize("kept", [150_000, 50, 0])
def test_lm(spark, kept):
    docs = tables(spark, "documents")
    got = {r.doc_id: r for r in lm.score(docs, kept=kept).collect()}
    for want in based([(r.doc_id, r.text) for r in docs.collect()]):
        r = got[want[0]]
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:5]
        assert r.base_score == pytest.approx(want[5], abs=1e-6)
        assert r.score < 0 and r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / max(r.n_bytes, 1))


def test_lm_beats_a_unigram_that_spells_unseen_tokens(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    train = Counter(t for d, text in docs if brute.rem(d, 10) for t in brute.tokens(text, lower=True))
    got = queries.op7_lm(spark, SF).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    unseen = sum(len(t.encode()) + 1 for d, text in docs if not brute.rem(d, 10) for t in brute.tokens(text, lower=True) if t not in train)
    assert got[1] > got[0] - unseen * math.log10(27)


def test_lm_is_the_same_however_its_input_is_parted(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    a, b = ({r.doc_id: r.score for r in lm.score(docs.repartition(n, F.rand(n)), LESS).collect()} for n in (4, 16))
    assert a == pytest.approx(b, rel=1e-9)


LESS = (1 << 12, 1 << 13, 1 << 13, 1 << 14, 1 << 14)
M = (1 << 64) - 1


def places(token, d, node):
    """The slots of one bit, number by number: ``d`` bytes of the token are known."""
    out, context, offset = [], 0, 0
    prefix = sum((b + 1) * pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j, b in enumerate(token[:d])) & M
    for k in range(1, lm.ORDERS + 1):
        context = (context * 257 + (token[d - k] + 1 if d >= k else 0)) & M
        h = ((prefix ^ (d << 56) if k == lm.ORDERS else context) + k) * 0xD6E8FEB86659FD93 & M
        h = (h + node * 0xA0761D6478BD642F) & M
        h = (h ^ (h >> 32)) * 0xE7037ED1A0B428DB & M
        out.append(offset + ((h >> 32) & (LESS[k - 1] - 1)))
        offset += LESS[k - 1]
    return out


def openings(text):
    """(place of the first byte, place of the second or None) of each token, byte by byte."""
    said, at = "  ".encode() + b" ".join(lm.tokens_of((text or "").encode())) + b" ", 2
    for token in lm.tokens_of((text or "").encode()):
        far = next((1 + b % (lm.FAR - 1) for b in reversed(said[:at]) if b > 127), 0)
        coarse = far * (lm.COARSE // lm.FAR) + said[at - 2] * 7 % (lm.COARSE // lm.FAR)
        if at == 2:
            last, second = 32, 32
            coarse = 32 * 7 % (lm.COARSE // lm.FAR)
        else:
            last, second = said[at - 2], said[at - 3]
        fine = coarse * (lm.PREVIOUS // lm.COARSE) + (last * 3 + second * 37) % (lm.PREVIOUS // lm.COARSE)
        yield fine * 256 + said[at], (coarse * 256 + said[at]) * 256 + said[at + 1] if token else None
        at += len(token) + 1


def coded(token, model):
    """log10 of a token's bytes from the third on, bit by bit."""
    total, token = 0.0, token + b" "
    for d in range(2, len(token)):
        node = 1
        for k in range(8):
            pairs = [(float(model.counts[s].real), float(model.counts[s].imag)) for s in places(token, d, node)]
            log_odds = [max(-9.0, min(9.0, math.log((b + lm.PRIOR) / (a + lm.PRIOR)))) for a, b in pairs]
            known = next((i for i, (a, b) in enumerate(pairs) if a + b == 0), lm.ORDERS)
            n = sum(pairs[-1])
            level = lm.ORDERS - 1 + sum(n >= x for x in (1, *lm.SEEN)) if n else min(known, lm.ORDERS - 1)
            gate = level * lm.PLACES + min(d - 2, lm.PLACES - 1)
            dot = max(-12.0, min(12.0, sum(w * x for w, x in zip(model.mixer.weight[gate], log_odds, strict=True))))
            step = gate * lm.STEPS + round((dot + 12) * (lm.STEPS - 1) / 24)
            zeros, ones = model.mixer.came[:, step]
            trust = 0.5 * (zeros + ones) / (zeros + ones + 50)
            p = (1 - trust) / (1 + math.exp(-dot)) + trust * (ones + 0.02) / (zeros + ones + 0.04)
            bit = token[d] >> (7 - k) & 1
            total += math.log10(p if bit else 1 - p)
            node = node * 2 + bit
    return total


def test_lm_against_brute_force(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    train = [t for d, t in texts.items() if brute.rem(d, 10)]
    gathered = lm._gathered(docs.repartition(3)).cache()
    # what was gathered, counted again text by text
    seen = Counter(p for t in train for pair in openings(t) for p in enumerate(pair, 1) if p[1] is not None)
    assert {(r.kind, r.place): r.c for r in gathered.where("kind > 0").groupBy("kind", "place").agg(F.sum("c").alias("c")).collect()} == seen
    tokens = Counter(w for t in train for w in lm.tokens_of((t or "").encode()))
    types = lm.token_types(gathered)
    assert {bytes(r.token): r.c for r in types.where("c > 0").collect()} == tokens
    shared, weight, came = lm.train(types, LESS)
    model = lm.Inside(lm._unpacked(shared), LESS)
    model.mixer.weight, model.mixer.came = weight, came
    counts = Counter()
    for token, c in tokens.items():
        said = token + b" "
        for d in range(2, len(said)):
            for k in range(8):
                for s in places(said, d, (1 << k) | (said[d] >> (8 - k))):
                    counts[s, said[d] >> (7 - k) & 1] += c
    assert {(s, v): n for v, part in enumerate((model.counts.real, model.counts.imag)) for s, n in enumerate(part.tolist()) if n} == counts
    begun = lm.opening(gathered)
    assert (10.0 ** begun.first.astype(float)).sum(axis=1) == pytest.approx(1, abs=1e-4) and (10.0 ** begun.second.astype(float)).sum(axis=1) == pytest.approx(1, abs=1e-4)
    got = {r.doc_id: r.score for r in lm.score(docs, LESS, kept=500).collect()}
    memo = {}
    for d in sorted(texts, key=lambda d: len(texts[d] or ""))[:120]:
        want = 0.0
        for w, (one, two) in zip(lm.tokens_of((texts[d] or "").encode()), openings(texts[d]), strict=True):
            if w not in memo:
                memo[w] = coded(w, model)
            want += memo[w] + float(begun.first.ravel()[one]) + (float(begun.second[begun.row[two >> 8], two & 255]) if two is not None else 0)
        assert got[d] == pytest.approx(want, rel=2e-3)


def test_lm_is_a_distribution():
    import numpy as np

    rng = np.random.default_rng(3)
    counts = rng.integers(0, 9, sum(LESS)) + 1j * rng.integers(0, 9, sum(LESS))
    model = lm.Inside(counts.astype(np.complex64), LESS)
    model.learn([b"ab", b"abc", b"b"] * 50, np.full(150, 2))
    model.mixer.freeze()
    # the third bytes of tokens that begin alike share one tree of bits
    ends = 10.0 ** model.log10([b"ab"])[0]
    third = sum(10.0 ** (model.log10([b"ab" + bytes([x])])[0]) for x in range(256) if x != 32)
    assert 0 < ends < 1 and ends + third < 1


def test_lm_odd(spark):
    docs = odd_documents(spark)
    got = lm.score(docs).collect()
    want = list(based([(r.doc_id if r.doc_id is not None else "", r.text) for r in docs.collect()]))
    assert sorted(tuple(r)[2:5] for r in got) == sorted(w[2:5] for w in want)
    assert lm.score(docs.limit(0)).count() == 0


def ruled(text):
    w = brute.tokens(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    hit = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if brute.tokens(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_rules(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op8_rules(spark, SF).collect()}
    assert {d: tuple(r)[1:7] for d, r in got.items()} == {d: ruled(t) for d, t in docs.items()}
    assert not any(r.kept and r.base_failed for r in got.values())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1 and not got[d].base_failed]
    assert sum(not got[d].kept for d in good) <= 0.03 * len(good)


def test_rules_odd(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = rules.report(docs, labels).collect()
    assert sorted(tuple(r)[2:7] for r in got) == sorted(ruled(r.text)[:5] for r in docs.collect())
    assert all(r.kept != r.base_failed for r in got)
    assert rules.report(docs.limit(0), labels.limit(0)).count() == 0


def test_binomial_bound():
    def exact(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for k, n, p in ((0, 10, 0.1), (3, 50, 0.1), (7, 400, 0.03), (40, 1000, 0.05)):
        assert rules._beta(n - k, k + 1, 1 - p) == pytest.approx(exact(k, n, p), rel=1e-9)
    assert rules.within_risk(0, 100, 0.05, 0.05) and not rules.within_risk(0, 50, 0.05, 0.05) and not rules.within_risk(0, 0, 0.5, 0.5)


def test_rules_cutoffs_hold_the_risk(spark):
    good = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("plain words here "), 1), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " "), F.when(F.col("id") % 50 == 0, F.repeat(F.lit("#"), 60)).otherwise("")).alias("text"), F.lit("en").alias("lang"))
    labels = good.select("doc_id", F.lit(1).alias("quality"))
    got = rules.report(good, labels).where("not kept").count()
    assert got <= 0.03 * 4000


def formatted(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        yield conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    got = queries.op10_chat(spark, SF).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(formatted([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]))


def test_chat_odd(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "&lt;| <|im_end|>\n<|im_start|>x & &amp; é\U0001f600<"), (2, 1, None, ""), (None, 0, "assistant", "|im_end|>"), (3, 0, "as\n<|sistant", "&#10;"), (3, None, "assistant", "x"), (4, 0, "user", "same"), (4, 0, "user", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    made = chat.format_turns(chat.canonical(turns))
    got = chat.read_back(made)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = got.select("conv_id", F.size("turns"), F.sha2(text, 256), F.length("loss_text"), F.sha2("loss_text", 256)).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, formatted(rows)))
    for r in made.collect():
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END.strip())
        for s in r.loss:
            assert r.formatted[s.start + s.length :].startswith(chat.END)
    assert chat.format_turns(chat.canonical(turns.limit(0))).count() == 0


def test_layouts(spark):
    one = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role:string,content:string>>")
    two = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from:string,value:string>>")
    three = spark.createDataFrame([(1, "q", "", "a")], "conv_id long, instruction string, input string, output string")
    four = spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, completion string").withColumn("extra", F.lit(1))
    for df in (one, two, three, four):
        assert [tuple(r) for r in chat.canonical(df).orderBy("turn").collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1, 2)], "conv_id long, other long"))
    records = ['{"messages":[{"role":"user","content":"q"},{"content":"a","role":"assistant"}]}', '{"question":"q","answer":"a","id":3}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"prompt":"q","response":"a"}', "[]", "no", None, '{"other":1}']
    df = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")
    got = sorted(map(tuple, chat.canonical_json(df, "record").collect()))
    assert got == [x for i in range(4) for x in ((i, 0, "user", "q"), (i, 1, "assistant", "a"))]
    assert [r.record for r in chat.unread(df, "record").orderBy("conv_id").collect()] == ["[]", "no", None, '{"other":1}']
    # more fields than asked for, empty arrays, later elements with other keys, a column of another layout
    records = ['{"messages":[]}', '{"prompt":"q","completion":"a","input":"i"}', '{"messages":[{"role":"user"},{"role":"assistant","content":"a"}],"prompt":"p"}', '{"instruction":"q","input":"i","output":"a"}']
    more = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")
    assert [r.layout for r in chat.told_json(more, "record").orderBy("conv_id").collect()] == ["messages", "prompt and completion", "messages", "instruction and input"]
    assert sorted(map(tuple, chat.canonical_json(more, "record").collect())) == [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", None), (2, 1, "assistant", "a"), (3, 0, "user", "q\n\ni"), (3, 1, "assistant", "a")]
    turns = spark.createDataFrame([(1, 0, "user", "q", "p")], "conv_id long, turn long, role string, text string, prompt string")
    assert [tuple(r) for r in chat.canonical(turns).collect()] == [(1, 0, "user", "q")]
