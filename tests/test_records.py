import pytest

from ferrolith.operators import drift, ordered, quality, records, selection


def test_ids_fall_back_to_the_index(spark):
    both = spark.createDataFrame([("a", "s", 0), (None, "t", 1)], "jid string, source_id string, i int")
    assert [r.id for r in both.select("i", records.sample_id(both, "i").alias("id")).orderBy("i").collect()] == ["a", "idx:1"]
    one = both.drop("jid")
    assert [r.id for r in one.select("i", records.sample_id(one, "i").alias("id")).orderBy("i").collect()] == ["s", "t"]


def test_names_and_shares(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([" a", "b", "", "a "],), ([" "],)], "n array<string>")
    got = df.select(records.clean_names(F.col("n")).alias("c"), records.element_shares(F.col("n")).alias("s")).collect()
    assert got[0].c == ["a", "b"] and got[0].s == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3)}
    assert got[1].c == [] and got[1].s is None


def test_canonical_takes_the_source_column(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (float("nan"), 4.0)], "gap double, optb88vdw_bandgap double")
    assert [r.v for r in df.select(records.canonical(df, "gap", "optb88vdw_bandgap").alias("v")).collect()] == [1.0, 3.0, None]
    assert [r.v for r in df.select(records.canonical(df, "none").alias("v")).distinct().collect()] == [None]


def test_lookup_refuses_empty_and_unknown_ids(spark):
    df = spark.createDataFrame([(" M1 ",), ("M2",)], "jid string")
    assert records.find_record(df, "M1").count() == 1
    for wanted in ("", "  ", "M3"):
        with pytest.raises(ValueError):
            records.find_record(df, wanted)


def test_subset_strategies(spark):
    df = spark.createDataFrame([(i, float(i), [float(i), 0.0]) for i in range(20)], "id long, s double, v array<double>")
    assert records.subset(df, "id", 5).count() == 5
    assert {r.id for r in records.subset(df, "id", 3, "kcenter", vector="v").collect()} == {0, 19, 9}
    assert {r.id for r in records.subset(df, "id", 4, "hybrid", score="s", vector="v").collect()} == {19, 18, 0, 17}


def test_stats_fall_back_to_all_records(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    split = lambda *rows: spark.createDataFrame(list(rows), "id string, split string")
    assert records.stats_records(df, split(("a", "train")), "id")[1] == "train_split"
    assert records.stats_records(df, split(("z", "train")), "id")[1] == "all_records_fallback"
    assert records.stats_records(df, split(("a", "val")), "id")[1] == "all_records"
    assert records.stats_records(df.where("false"), None, "id")[1] == "empty"


def test_products_have_no_cap_and_keep_types(spark):
    df = spark.createDataFrame([(1, list(range(20)), list(range(20)), list(range(20))), (2, [], [1], [1])], "k long, a array<int>, b array<int>, c array<int>")
    got = selection.option_products(df, "k", ["a", "b", "c"])
    rows = got.collect()
    assert len(rows) == 8000 and {r.k for r in rows} == {1}
    assert all(r.ordinal == (r.choice[0] * 20 + r.choice[1]) * 20 + r.choice[2] for r in rows)


def test_tied_values_are_drawn_by_their_share(spark):
    # half of each side is 0: a sample of few values would hold it in its share, so both sides look alike
    make = lambda low: spark.range(low, low + 4000).selectExpr("'p' property", "if(id % 2 = 0, 0D, cast(id % 97 as double)) value", "id key")
    sampled = drift._sample(make(0), 512)
    zero = sampled.where("value = 0").count()
    assert sampled.count() == 512 and 180 < zero < 330
    assert drift.mmd(make(0), make(10**6)).first().mmd2 < 0.01


def test_running_sums_read_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    values = spark.range(1000).selectExpr("'p' property", "cast(id % 100 as double) value", "cast(id as string) jid").mapInPandas(count, "property string, value double, jid string")
    ordered.average_ranks(values, "value").count()
    assert seen.value <= 2 * 1000
    before = seen.value
    quality.outliers(values, "jid").count()
    assert seen.value - before <= 3 * 1000
