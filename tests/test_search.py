"""Search that learns, on planted losses and on planted groups."""
import random

import numpy as np
from pyspark.ml.functions import array_to_vector

from quizspark.operators import clustering as C
from quizspark.operators import search as S


def _loss(t):
    """Least at (17, 4, 27), with a penalty far from it like the label count's."""
    far = sum(((x - y) / w) ** 2 for x, y, w in zip(t, (17, 4, 27), (6, 4, 4)))
    return far + (0.2 if far > 1 else 0.0)


def test_beats_the_random_draw_at_equal_trials():
    wins, gains = 0, []
    for seed in range(20):
        learnt = min(x for _, x in S.minimise(C.SPACES, lambda ts: [_loss(t) for t in ts], 60, seed))
        drawn = min(_loss(t) for t in S.random_draw(C.SPACES, 60, random.Random(seed)))
        wins += learnt <= drawn
        gains.append(drawn - learnt)
    assert wins >= 16 and np.mean(gains) > 0
    assert S.minimise(C.SPACES, lambda ts: [_loss(t) for t in ts], 30, 5) == S.minimise(C.SPACES, lambda ts: [_loss(t) for t in ts], 30, 5)


def test_trials_are_distinct_in_range_and_bounded():
    made = S.minimise(C.SPACES, lambda ts: [0.5] * len(ts), 100, 42)
    assert len(made) == 100 and len({t for t, _ in made}) == 100
    assert all(5 <= a < 20 and 3 <= b < 15 and 25 <= c < 35 for (a, b, c), _ in made)
    small = S.minimise([range(2), range(3)], lambda ts: [float(sum(t)) for t in ts], 50, 1)
    assert len(small) == 6


def _planted(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 20))
    rows = [(g * 60 + i, (centres[g] + rng.normal(size=20) * (0.08 if g % 2 else 0.3)).tolist()) for g in range(8) for i in range(60)]
    rows += [(1000 + i, x.tolist()) for i, x in enumerate(rng.normal(size=(150, 20)) * 0.9)]  # noise
    return spark.createDataFrame(rows, "id long, e array<double>").withColumn("features", array_to_vector("e"))


def test_cluster_search_finds_planted_groups_and_learns(spark):
    df = _planted(spark)
    trials, best = C.cluster_search(df, "id", "features", n_trials=24, seed=3, rounds=3)
    rows = sorted(trials.collect(), key=lambda r: r["trial"])
    assert len(rows) == 24 and len({(r["n_neighbors"], r["n_components"], r["min_cluster_size"]) for r in rows}) == 24
    assert len({round(r["loss"], 6) for r in rows}) > 3
    learnt = np.mean([r["loss"] for r in rows[8:]])
    assert learnt <= np.mean([r["loss"] for r in rows[:8]])
    found = {r["id"]: r["cluster"] for r in best.collect()}
    groups = [[found[g * 60 + i] for i in range(60)] for g in range(8)]
    common = [max(set(g) - {-1}, key=g.count) for g in groups]
    assert len(set(common)) == 8 and all(g.count(c) >= 45 for g, c in zip(groups, common))


def test_trials_of_many_edges_are_read_as_forests(spark, monkeypatch):
    """A trial's graph of more than max_edges edges, whose points are fewer, is
    not walked through in rounds: its forest is enough, and gives the same."""
    from quizspark.operators import hierarchy as H
    rng = np.random.default_rng(8)
    n = 120
    rows = [(t, int(a), int(b), float(w)) for t in (3, 4) for a, b, w in zip(rng.integers(0, n, 2000), rng.integers(0, n, 2000), np.round(rng.random(2000), 2)) if a != b]
    e = spark.createDataFrame(rows, "trial int, src long, dst long, mr double")
    v = spark.createDataFrame([(t, i) for t in (3, 4) for i in range(n + 3)], "trial int, id long")
    sizes = spark.createDataFrame([(3, 5), (4, 9)], "trial int, min_cluster_size int")
    want = {(r["trial"], r["id"]): (r["cluster"], r["probability"]) for r in H.hierarchical_clusters(e, v, sizes, ["trial"]).collect()}

    def never(*_):
        raise AssertionError("a graph whose forest is small was walked through in rounds")
    monkeypatch.setattr(H, "_large_graph", never)
    monkeypatch.setattr(H, "PART_EDGES", 700)
    got = H.hierarchical_clusters(e, v, sizes, ["trial"], max_edges=200).collect()
    assert {(r["trial"], r["id"]): (r["cluster"], r["probability"]) for r in got} == want and len(got) == len(want)


def test_least_forest_is_kruskals():
    from quizspark.operators.hierarchy import least_forest
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (30, 20), (40, 300), (200, 3000)):
        u, v, w = rng.integers(0, n, m), rng.integers(0, n, m), np.round(rng.random(m), 1)
        u, v = np.minimum(u, v), np.maximum(u, v)
        up, want = list(range(n)), []

        def top(i):
            while up[i] != i:
                i = up[i]
            return i
        for i in np.lexsort((v, u, w)):
            if top(u[i]) != top(v[i]):
                up[top(u[i])] = top(v[i])
                want.append((w[i], u[i], v[i]))
        assert [(w[i], u[i], v[i]) for i in least_forest(u, v, w)] == want


def test_a_trial_in_a_task_of_its_own_is_the_distributed_one(spark, monkeypatch):
    """Trials on neighbour lists, with copies and a neighbour that has no list: one
    task each, without a shuffle, and the same clusters as by forests of parts."""
    from quizspark.operators.neighbours import nested_lists
    from quizspark.session import saved
    df = _planted(spark).select("id", "e")
    df = df.union(df.where("id < 40").selectExpr("id + 5000", "e"))
    lists = nested_lists(df, 19, [3, 8], vec_col="e").where("id <> 7").withColumnRenamed("dims", "n_components").transform(lambda x: saved(x, by="n_components"))
    trials = [(6, 3, 25), (19, 8, 30), (11, 8, 26)]
    got = C.evaluate_trials(lists, trials, 4)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    got = {(r["trial"], r["id"]): (r["cluster"], round(r["probability"], 9)) for r in got.collect()}
    monkeypatch.setattr(C, "PART_EDGES", 300)  # edges are read in parts
    assert {(r["trial"], r["id"]): (r["cluster"], round(r["probability"], 9)) for r in C.evaluate_trials(lists, trials, 4).collect()} == got
    monkeypatch.setattr(C, "MAX_EDGES", 0)
    want = {(r["trial"], r["id"]): (r["cluster"], round(r["probability"], 9)) for r in C.evaluate_trials(lists, trials, 4).collect()}
    assert got == want and len(want) == 3 * 669 and len({c for c, _ in want.values()}) > 3
