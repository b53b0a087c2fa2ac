"""The registered queries against their SQL, and the pipeline against its stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ferrolith.llm import queries
from tests.llm import brute
from tests.test_oracle import TABLES, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("sf", [brute.SF, "/root/testdata/sf0.01"])
def test_same_as_sql(spark, name, sf):
    import duckdb

    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_every_operator_has_its_query():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 14)] == [1] * 13
    assert len(corpus_pipeline.STAGES) == 5 and "pipeline" in queries.QUERIES


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stage_rows = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        stage_rows.append([(r.doc_id, r.text) for r in docs.collect()])
    good, apart, clean, mixed = stage_rows
    poor = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    assert len({d for d, _ in good} & poor) <= 0.1 * len(poor)
    assert sorted(d for d, _ in apart) == sorted(brute.near_copies(good))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(d for d, _ in clean) == sorted(r[0] for r in brute.decontaminated(apart, items) if not r[5])
    times = {d: sum(1 for x, _ in mixed if x == d) for d, _ in mixed}
    assert set(times) <= {d for d, _ in clean} and max(times.values()) <= 2
    words = {d: len(brute.tokens(t)) for d, t in clean}
    assert abs(sum(words[d] for d, _ in mixed) - 1.5 * sum(words.values())) < 0.05 * sum(words.values())
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in mixed)


def test_pipeline_odd(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    long = " ".join(f"word{i}" for i in range(80))
    odd = [(None, long, "en", None, 1), (None, None, None, None, None), (1, long, "en", "a", 1), (1, long, "en", "a", 1), (1, "another text of few words", "en", "a", 1), (2, "", "fr", "b", 0), (3, long.replace("word7 ", "other "), "en", "b", 2)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for name in ("mix_shard", "mix_order", "row", "hash", "kept_id", "bad_id", "shards", "block", "__row"):
        docs = docs.withColumn(name, F.lit(name))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert "__row" in docs.columns and docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and {r.mix_shard for r in docs.select("mix_shard").collect()} == {"mix_shard"}
    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == docs.count()
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none_after = stage(spark, none, str(tmp_path))
        assert none_after.count() == 0
