"""Approximate neighbours against the exact graph; bounded, near linear work."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quizspark.operators import clustering as C
from quizspark.operators import neighbours as N


def _frame(spark, n, dim=12, groups=20, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] * 3 + rng.normal(size=(n, dim))
    if copies:
        x[:copies] = x[0]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(8)


def _recall(exact, got, key=()):
    """Share of exact neighbours found; one as near as the k-th counts."""
    far = exact.groupBy(*key, "id").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("k"))
    hit = got.join(far, [*key, "id"]).where(F.col("dist") <= F.col("far") + 1e-9).count()
    return hit / exact.count()


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_recall_against_the_exact_graph(spark, metric):
    df = _frame(spark, 3000).cache()
    exact, got = C.knn_graph(df, 10, metric=metric).cache(), N.approximate_knn(df, 10, metric=metric, cell_rows=64).cache()
    assert _recall(exact, got) >= 0.95
    assert got.groupBy("id").count().where("count <> 10").count() == 0 and got.where("id = nbr").count() == 0
    # its distances are exact
    both = got.join(exact.select("id", "nbr", F.col("dist").alias("true")), ["id", "nbr"])
    assert both.where(F.abs(F.col("dist") - F.col("true")) > 1e-9).count() == 0


def test_large_groups_of_copies_stay_bounded(spark):
    df = _frame(spark, 1500, copies=600).cache()
    exact, got = C.knn_graph(df, 8, metric="euclidean"), N.approximate_knn(df, 8, metric="euclidean", cell_rows=32)
    sizes = N.cells(df.select("id", F.col("vec").alias("v")), 1500, 12, 32, 0, 1).groupBy("cell", "part").count()
    assert sizes.agg(F.max("count")).first()[0] <= 4 * 32
    assert _recall(exact, got) >= 0.9


def test_work_in_cells_is_near_linear(spark):
    def pairs(n):
        df = _frame(spark, n, groups=50).select("id", F.col("vec").alias("v"))
        return N.cells(df, n, 12, 64, 0, 1).groupBy("cell", "part").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert pairs(8000) < 6 * pairs(2000)


def test_nested_dimensions_and_switch(spark):
    df = _frame(spark, 600)
    exact = C.neighbour_graph(df, 6, metric="euclidean", prefix_dims=[4, 9])
    got = C.neighbour_graph(df, 6, metric="euclidean", prefix_dims=[4, 9], exact_rows=100)
    assert exact.columns == got.columns
    assert _recall(exact, got, ("dims",)) >= 0.9


def test_empty_and_tiny(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert N.approximate_knn(none, 3).count() == 0
    assert N.approximate_knn(_frame(spark, 3), 5, metric="euclidean").groupBy("id").count().where("count <> 2").count() == 0


@pytest.mark.parametrize("apart", [True, False])
def test_nearest_is_a_full_sort_with_ties_to_the_lower_id(apart):
    rng = np.random.default_rng(3)
    for m, n, k in ((7, 300, 5), (40, 3, 5), (1, 1, 2), (50, 64, 10)):
        ids, others = rng.permutation(m), rng.permutation(n) + (100 if apart else 0)
        d = rng.integers(0, 6, (m, n)) / 4.0  # many ties
        d[rng.random((m, n)) < 0.1] = np.nan
        want = [(i, o, x) for i, row in zip(ids, d) for x, o in sorted((x, o) for x, o in zip(row, others) if x == x and o != i)[:k]]
        for axis, side in ((1, d), (0, np.ascontiguousarray(d.T))):
            assert list(zip(*(x.tolist() for x in N.nearest(ids, others, side, k, apart, axis)))) == want


def test_vectors_shuffled_by_the_exact_graph_grow_as_the_rows(spark):
    """Blocks grow with the rows, so a vector goes to a bounded number of them."""
    df = _frame(spark, 1200, dim=4)
    graph = C.knn_graph(df, 3, block_size=8)  # 150 blocks before
    plan = graph._jdf.queryExecution().optimizedPlan().toString()
    assert f"% {C.MANY_BLOCKS})" in plan and "% 150)" not in plan
    best = np.array([r["v"] for r in df.select(F.col("vec").alias("v")).orderBy("id").collect()])
    unit = best / np.linalg.norm(best, axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    got = {(r["id"], r["rank"]): r["nbr"] for r in graph.collect()}
    assert all(got[i, j + 1] == o for i, row in enumerate(np.argsort(d, axis=1)[:, :3]) for j, o in enumerate(row))


def test_settled_neighbourhoods_do_not_meet_again(spark):
    df = _frame(spark, 400)
    exact = C.knn_graph(df, 5, metric="euclidean").withColumn("dims", F.lit(-1))
    v = df.select("id", F.col("vec").alias("v"))
    assert N._meetings(exact.withColumn("new", F.lit(False)), v, 5, "euclidean", 4).count() == 0
    assert N._meetings(exact.withColumn("new", F.col("id") < 3), v, 5, "euclidean", 4).count() > 0


@pytest.mark.parametrize("candidate_bytes", [1 << 25, 40_000])
def test_nested_lists_are_exact_beyond_the_rows_of_one_graph(spark, monkeypatch, candidate_bytes):
    """Graphs over nested dimensions stay exact for ``exact_rows`` rows each; equal
    vectors are at distance 0, copies of an id share a list."""
    from quizspark.operators import neighbours as N
    monkeypatch.setattr(N, "CANDIDATE_BYTES", candidate_bytes)
    monkeypatch.setattr(C, "approximate_knn", None)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(900, 7)), 1)
    x[600:640] = x[:40]
    ids = list(range(899)) + [5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id long, vec array<double>")
    rows = C.neighbour_graph(df, 6, metric="euclidean", prefix_dims=[2, 5, 7], exact_rows=400).collect()
    assert len({(r["dims"], r["id"], r["rank"]) for r in rows}) == len(rows) == 3 * 899 * 6
    for dims in (2, 5, 7):
        got = {}
        for r in sorted((r for r in rows if r["dims"] == dims), key=lambda r: r["rank"]):
            got.setdefault(r["id"], []).append((r["nbr"], r["dist"]))
        for i in (0, 7, 333, 610, 898):
            d = np.sqrt(((x[:, :dims] - x[i, :dims]) ** 2).sum(1))
            want = sorted((a, n) for a, n in zip(d, ids) if n != i)[:6]
            assert np.allclose([a for _, a in got[i]], [a for a, _ in want])
        assert got[610][0][1] == 0.0


def test_nested_graphs_in_a_task_each_shuffle_nothing(spark):
    from quizspark.session import saved
    df = _frame(spark, 2500, copies=300).select("id", F.col("vec").alias("v")).transform(saved)
    lists = N.descent_lists(df, 9, [3, 12], cell_rows=32)
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()
    got = C._graph_rows(lists).cache()
    exact = C._graph_rows(N.nested_lists(df, 9, [3, 12])).cache()
    assert _recall(exact, got, ("dims",)) >= 0.98
    assert got.groupBy("dims", "id").count().where("count <> 9").count() == 0 and got.where("id = nbr").count() == 0
    both = got.join(exact.select("dims", "id", "nbr", F.col("dist").alias("true")), ["dims", "id", "nbr"])
    assert both.count() and both.where(F.abs(F.col("dist") - F.col("true")) > 1e-9).count() == 0
    # rows of one id share a list and are not neighbours of each other
    twice = df.union(df.where("id < 50")).transform(saved)
    rows = N.descent_lists(twice, 9, [3]).collect()
    assert len(rows) == 2500 and all(r["id"] not in r["nbrs"] and len(set(r["nbrs"])) == len(r["nbrs"]) for r in rows)
    assert N.descent_lists(df.limit(0), 3, [2]).count() == 0


def test_what_a_saved_table_shuffled_is_freed(spark):
    import time

    from quizspark.session import saved

    def files():
        found = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.length()) if found.apply(i).getName().startswith("shuffle_")}
    before, conf = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(conf)
    df = spark.range(200_000).groupBy((F.col("id") % 50_000).alias("k")).agg(F.max("id").alias("m"))
    out = df.transform(saved)
    for _ in range(20):
        if not (left := files() - before):
            break
        time.sleep(0.5)
    assert not left and out.count() == 50_000 and spark.conf.get(conf) == was
