import numpy as np

from ferrolith.operators import pareto, pathways


def test_fronts_rank_every_row(spark):
    x = np.random.default_rng(5).integers(0, 12, (20_001, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x.tolist())], "id long, a double, b double")
    left, rank, level = {tuple(p) for p in x.tolist()}, {}, 0
    while left:
        best = {p for p in left if not any(q != p and q[0] >= p[0] and q[1] >= p[1] for q in left)}
        rank.update(dict.fromkeys(best, level))
        left, level = left - best, level + 1
    assert level > 8
    got = {r.id: r.front for r in pareto.fronts(df, ["a", "b"], "id").collect()}
    assert got == {i: rank[tuple(p)] for i, p in enumerate(x.tolist())}


def test_diverse_rows_come_from_the_whole_table(spark):
    rows = [(i, 1.0, [1.0, 0.0]) for i in range(2500)] + [(2500, 0.9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, s double, v array<double>")
    assert [r.id for r in pareto.select_diverse(df, "s", "id", "v", 3).orderBy("pick").collect()] == [0, 2500, 1]


def test_paths_keep_all_that_none_dominates(spark):
    edges = [("e", "s", f"m{i:02}", 20.0 - i, 1.0 + i) for i in range(20)] + [("e", f"m{i:02}", "g", 0.0, 0.0) for i in range(20)]
    edges += [("e", "s", "bad", 30.0, 40.0), ("e", "bad", "g", 0.0, 0.0)]
    edges = spark.createDataFrame(edges, "entity string, src string, dst string, delta_g double, activation double")
    start, goal = (spark.createDataFrame([("e", n)], "entity string, node string") for n in "sg")
    got = pathways.paths(edges, start, goal, most_steps=2).collect()
    assert sorted(r.path[1] for r in got) == [f"m{i:02}" for i in range(20)]


def test_local_fronts_run_in_all_tasks(spark):
    df = spark.range(100, numPartitions=4).selectExpr("id", "cast(id as double) a", "cast(-id as double) b")
    plan = pareto.pareto_front(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce 1" not in plan and "Exchange" in plan
    assert pareto.pareto_front(df, ["a", "b"]).count() == 100


def test_rounds_dont_grow_with_the_fronts(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 7 == 0), float(i // 2)) for i in range(400)] + [(400, 5.0, None, 1.0)], "id long, a double, b double, c double")
    rows = {i: (i, i % 7 == 0, i // 2) for i in range(400)}
    rank = {}
    for i in sorted(rows, reverse=True):  # who dominates has a greater id
        rank[i] = max((rank[j] + 1 for j in range(i + 1, 400) if all(x >= y for x, y in zip(rows[j], rows[i], strict=True))), default=0)
    assert max(rank.values()) > 100
    spark.sparkContext.setJobGroup("fronts", "fronts")
    got = {r.id: r.front for r in pareto.fronts(df, ["a", "b", "c"], "id").collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fronts")
    spark.sparkContext.setJobGroup("", "")
    assert got == rank | {400: max(rank.values()) + 1}
    assert len(jobs) < 60
    some = df.where("id < 60")
    assert {tuple(r) for r in pareto.fronts(some, ["a", "b", "c"], "id", most_merged=20).collect()} == {tuple(r) for r in pareto.fronts(some, ["a", "b", "c"], "id").collect()}
