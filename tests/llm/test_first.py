"""Operators 1, 4, 5, 6 and 9 against brute force, and their edge cases."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ferrolith.llm import decontaminate, mixing, quality, queries, sharding, simhash
from tests.llm import brute

KIND = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon"


def tables(spark, name):
    return spark.read.parquet(f"{brute.SF}/{name}.parquet")


def odd_documents(spark):
    rows = [
        (1, LONG, "en", "a", 1), (2, LONG.upper() + "!", "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (None, LONG + " end", "en", "b", 1),
        (5, "x " * 30_000, "en", "c", 1), (6, LONG, "en", "c", 1), (6, LONG, "en", "c", 1), (6, "other text é É", "en", "c", 1), (7, "one", "fr", "z", 3), (8, " \t\n ", "fr", "z", 3),
    ]
    return spark.createDataFrame(rows, KIND).withColumn("window_id", F.lit(1)).withColumn("key", F.lit("k"))


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontaminate(spark, limit):
    docs, items = tables(spark, "documents"), tables(spark, "benchmark")
    got = decontaminate.report(docs, items, broadcast_shingles=limit)
    got = got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("h"), "contaminated")
    want = brute.decontaminated([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(r[5] for r in want)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontaminate_odd(spark, limit):
    items = [(1, LONG), (2, "Gamma delta"), (10, "one"), (3, None), (4, ".."), (None, "other text"), (5, "x x x"), (6, " ".join(LONG.split()[:12]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(0))
    docs = odd_documents(spark)
    got = decontaminate.report(docs, bench, broadcast_shingles=limit).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("h"), "contaminated")
    want = brute.decontaminated([(r.doc_id, r.text) for r in docs.collect()], items)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    clean = decontaminate.clean(docs, bench, broadcast_shingles=limit)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 8]
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), bench).count() == 0


def test_decontaminate_partly(spark):
    near = LONG.split()
    near[9] = "changed"
    docs = spark.createDataFrame([(1, " ".join(near)), (2, LONG)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.report(docs, bench, window=20, containment=0.6).collect()}
    assert got == {1: 20, 2: 20}
    assert {r.doc_id: r.n_hit for r in decontaminate.report(docs, bench, window=20).collect()} == {1: 0, 2: 20}


def test_simhash(spark):
    docs = tables(spark, "documents")
    got = sorted(map(tuple, queries.op5_simhash(spark, brute.SF).collect()))
    assert got == sorted(brute.linked([(r.doc_id, r.text) for r in docs.collect()]))
    assert len({r[2] for r in got}) < len(got)


def test_simhash_odd(spark):
    docs = odd_documents(spark)
    got = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.linked([(r.doc_id, r.text) for r in docs.collect()])))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[2] for r in {(repr(x[2]), 0, x[2]) for x in brute.linked([(r.doc_id, r.text) for r in docs.collect()])})


@pytest.mark.parametrize(("radius", "most"), [(2, 16_384), (2, 3), (1, 16_384), (1, 3)])
def test_links_span_every_component(spark, radius, most):
    import random

    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(rng.choice([1, 3, 25])):
            x ^= 1 << rng.randrange(64)
            x ^= (1 << rng.randrange(64)) * rng.randrange(2)
            prints.add(x)
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), radius, most_tiled=most)

    def components(pairs):
        root = {p: p for p in prints}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = defaultdict(set)
        for p in prints:
            groups[find(p)].add(p)
        return sorted(map(sorted, groups.values()))

    near = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]
    assert components([(r.a, r.b) for r in edges.collect()]) == components(near)


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_quality_odd(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = quality.score(docs, quality.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_sharding(spark):
    docs = tables(spark, "documents")
    got = queries.op6_sharding(spark, "/root/testdata/sf0.01").toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() < 1.02 * sizes.mean() and sizes.min() > 0.98 * sizes.mean()
    for _, slots in got.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got.itertuples()} == {(d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items()}
    assert max(got.assign(text=got.doc_id.map(texts)).groupby("text")["shard"].nunique()) == 1
    assert docs.count() == sharding.assign(docs).count()


def test_sharding_odd(spark):
    docs = odd_documents(spark)
    got = sharding.assign(docs).toPandas()
    assert len(got) == docs.count() and got.loc[got.doc_id == 3, "size"].tolist() == [1]
    for _, slots in got.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    assert sharding.assign(docs.limit(0)).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same " * 20).otherwise(F.concat(F.lit("word "), F.col("id").cast("string"), F.repeat(F.lit(" x"), 80))).alias("text"))
    sizes = sharding.assign(hot).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("r")).toPandas()
    assert sizes.b.max() < 1.05 * sizes.b.mean() and sizes.r.max() < 1.1 * sizes.r.mean()


def test_mixing(spark):
    got = queries.op9_mixing(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text"), "doc_id").toPandas()
    assert (got["size"] == [len(brute.tokens(t)) for t in got.text]).all()
    sizes = got.groupby("source")["size"].sum().to_dict()
    want = brute.targets(sizes)
    for s, rows in got.groupby("source"):
        assert abs(rows.target.iloc[0] - want[s]) < 1e-6
        assert set(rows.source_size) == {sizes[s]}
        assert abs(rows.taken.sum() - want[s]) <= rows["size"].max()
    assert (got.taken <= 2 * got["size"]).all()


def test_mixing_odd(spark):
    docs = odd_documents(spark)
    assert mixing.plan(docs).count() == docs.count()
    got = mixing.mix(docs, shards=4).collect()
    again = mixing.mix(docs.repartition(3), shards=4).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.plan(docs.where("source = 'z' and text <> 'one'")).select("size", "target", "copies").first().size == 0


def test_mixing_tree(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("source"))
    got = mixing.mix(docs, shards=8, blocks_per_source=64).groupBy("mix_shard").agg(F.count("*").alias("n"), F.sum((F.col("source") == "hot").cast("int")).alias("hot")).toPandas()
    assert len(got) == 8 and got.n.max() < 1.4 * got.n.mean() and got.hot.min() > 0


def test_the_tree_decides_what_is_taken(spark):
    n = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 7).cast("int"))).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("source"))
    # the same id and text in two sources, repeated rows, and columns that clash
    docs = n.unionAll(n.where("doc_id < 50").withColumn("source", F.lit("other"))).unionAll(n.where("doc_id < 50")).withColumn("mix_shard", F.lit("own")).withColumn("shards", F.lit(1)).withColumn("block", F.lit(2))
    plan = mixing.plan(docs, shards=8, blocks_per_source=64).collect()
    draws = Counter(s for r in plan for s in r.shards)
    assert set(draws) == set(range(8)) and all(r.copies == len(r.shards) <= 2 for r in plan)
    # the draws of blocks are dealt evenly: a source's blocks have one size, so does a shard's share within a few blocks
    assert max(draws.values()) < 1.4 * min(draws.values())
    hot = Counter(s for r in plan if r.source == "hot" for s in r.shards)
    assert len(hot) == 8
    made = mixing.mix(docs, shards=8, blocks_per_source=64)
    assert made.columns == [*docs.columns, "mix_shard_", "mix_order"]
    got = Counter((r.doc_id, r.source, r.mix_shard_) for r in made.collect())
    assert got == Counter((r.doc_id, r.source, s) for r in plan for s in r.shards)
    assert {r.mix_shard for r in made.collect()} == {"own"}
    spread = mixing.shuffled(docs, shards=8, blocks_per_source=64)
    assert spread.columns == docs.columns and spread.count() == sum(draws.values())
