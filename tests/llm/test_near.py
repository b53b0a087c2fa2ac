import random

import pytest

from ferrolith.llm import near, simhash


def jaccard(a, b):
    def cut(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def groups(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_near_copies_of_similarity_08_are_one(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 200]))]
        texts.append(" ".join(base))
        for edits in (1, 2, 4, 8):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(w))
    texts += ["", "  ", "one two", "One  two", "three four"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    root = groups(texts)
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    assert near.keep_one(docs.limit(0)).count() == 0


def test_a_large_group_of_near_copies_is_one(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(300):  # up to four words changed: many pairs of copies are below 0.8, all are near the base
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(150)] = f"x{rng.randrange(5000)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near.keep_one(docs).count() == len(set(groups(texts)))


def boilerplate_pairs(n, seed=11):
    """``n`` pairs of similarity 0.9 around one passage that makes different pairs alike, but below 0.8."""
    rng = random.Random(seed)
    shared = [f"s{i}" for i in range(340)]
    texts = []
    for i in range(n):
        own = [f"p{i}x{k}" for k in range(60)]
        base = shared + own
        other = list(base)
        for k in rng.sample(range(len(base)), 4):
            other[k] = f"y{i}x{k}"
        texts += [" ".join(base), " ".join(other)]
    return texts


@pytest.mark.parametrize(("nodes", "width"), [(512, 8192), (20, 64)])
def test_pairs_around_one_passage_are_all_found(spark, monkeypatch, nodes, width):
    monkeypatch.setattr(near, "TILE_NODES", nodes)
    monkeypatch.setattr(near, "WIDTH", width)
    texts = boilerplate_pairs(120)
    assert 0.6 < jaccard(texts[0], texts[2]) < 0.8 < jaccard(texts[0], texts[1])
    got = near.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    roots = {r.doc_id: r.root for r in got}
    want = groups(texts)
    assert len(set(roots.values())) == len(set(want)) and all(roots[i] == roots[w] for i, w in enumerate(want))


def test_a_row_of_each_text_of_an_id_and_null_ids_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = spark.createDataFrame([(5, a), (5, b), (3, b), (None, c), (None, c), (7, a.replace("a0 ", "z "))], "doc_id long, text string")
    assert sorted(map(repr, map(tuple, near.keep_one(docs).collect()))) == sorted(map(repr, [(5, a), (3, b), (None, c)]))


def test_simhash_keeps_a_row_of_each_component(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = spark.createDataFrame([(5, a), (5, b), (3, b), (3, b)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == [(3, b), (5, a)]
    docs = spark.createDataFrame([(5, a), (5, b)], "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 2


def test_what_the_bands_miss_fingerprints_find(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(near, "band_keys", lambda found: [hash(tuple(found.tolist())) >> 1])  # no two nodes meet
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(1500)) for _ in range(6)]
    texts = base + [t + " end" for t in base]
    roots = {r.doc_id: r.root for r in near.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(set(roots.values())) == 6 and all(roots[i] == roots[i + 6] for i in range(6))


def test_jobs_and_tasks_are_bounded(spark):
    texts = boilerplate_pairs(60)
    for seed in range(30):  # chains: neighbours alike, ends not
        rng = random.Random(seed)
        w = [f"c{seed}x{i}" for i in range(200)]
        for k in range(12):
            w[rng.randrange(200)] = f"d{seed}x{k}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("near", "near")
    got = {r.doc_id: r.root for r in near.near_duplicates(docs).collect()}
    jobs = tracker.getJobIdsForGroup("near")
    spark.sparkContext.setJobGroup("", "")
    print("jobs", len(jobs))
    assert len(jobs) < 200
    want = groups(texts)
    assert len(set(got.values())) == len(set(want)) and all(got[i] == got[w] for i, w in enumerate(want))
