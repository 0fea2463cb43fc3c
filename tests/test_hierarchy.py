"""Hierarchical density clusters against a tree cut from the top on one machine,
and planted groups of different density."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quizspark.operators import clustering as C
from quizspark.operators import hierarchy as H


def _forest(edges):
    """Kruskal in the order (w, u, v)."""
    up, out = {}, []

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for w, u, v in sorted((w, min(a, b), max(a, b)) for a, b, w in edges):
        if find(u) != find(v):
            up[find(u)] = find(v)
            out.append((w, u, v))
    return out


def _parts(points, edges):
    near = {p: [] for p in points}
    for _, u, v in edges:
        near[u].append(v)
        near[v].append(u)
    left, out = set(points), []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            p = todo.pop()
            seen.add(p)
            left.discard(p)
            todo += [x for x in near[p] if x not in seen]
        out.append(seen)
    return out


def brute(points, edges, m, allow_single=False):
    """{point: (cluster as a frozenset of its points or None, lambda)}."""
    forest = _forest(edges)

    def within(part, es):
        return [e for e in es if e[1] in part]

    def tree(part, es, birth):
        """(best, [(chosen points, {point: lambda})], {point: lambda}) of a cluster."""
        lam_of, stability, children, here = {}, 0.0, None, set(part)
        es = sorted(es)
        while True:
            w, u, v = es.pop()
            lam = 1 / max(w, H.LEAST)
            a, b = sorted(_parts(here, es), key=len)
            if len(a) >= m:
                stability += len(here) * lam
                children = [tree(x, within(x, es), lam) for x in (a, b)]
                break
            leave = a if len(b) >= m else here
            for p in leave:
                lam_of[p] = lam
                stability += lam
            if len(b) < m:
                break
            here, es = b, within(b, es)
        stability -= len(part) * birth
        best = sum(c[0] for c in children) if children else 0.0
        every = dict(lam_of)
        for c in children or []:
            every |= c[2]
        below = [x for c in children or [] for x in c[1]]
        return max(best, stability), ([(part, every)] if stability >= best else below), every, bool(children), below
    end = 1 / max(H.LEAST, max((w for _, _, w in edges), default=1))
    roots = [tree(x, within(x, forest), end) for x in _parts(points, forest) if len(x) >= m]
    out = {p: (None, 0.0) for p in points}
    for r in roots:
        picked = r[4] if len(roots) == 1 and not allow_single and r[4] else r[1]
        for part, lam in picked:
            most = max(lam[p] for p in part)
            for p in part:
                out[p] = (frozenset(part), lam[p] / most)
    return out


def _check(got, want):
    members = {}
    for r in got:
        members.setdefault(r["cluster"], set()).add(r["id"])
    assert len(got) == len(want)
    for r in got:
        part, probability = want[r["id"]]
        if part is None:
            assert r["cluster"] == -1 and r["probability"] == 0.0
        else:
            assert members[r["cluster"]] == part and abs(r["probability"] - probability) < 1e-9
    firsts = [min(members[c]) for c in sorted(members) if c >= 0]
    assert firsts == sorted(firsts) and sorted(c for c in members if c >= 0) == list(range(len(firsts)))


def _random_graph(seed, n, ties):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(size=(n // 5, 2)) * s + c for s, c in ((0.3, (0, 0)), (0.3, (3, 0)), (2, (20, 0)), (2, (0, 25)), (9, (5, 5)))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    if ties:
        d = np.round(d)
    edges = []
    for i in range(len(x)):
        for j in np.argsort(d[i], kind="stable")[1:7]:
            edges.append((i, int(j), float(d[i, j])))
    return list(range(len(x))), edges


@pytest.mark.parametrize("seed,n,ties,m,max_edges", [(0, 500, False, 12, 1 << 20), (0, 500, False, 12, 200), (1, 150, True, 6, 60)])
def test_equals_the_tree_cut_from_the_top(spark, seed, n, ties, m, max_edges):
    points, edges = _random_graph(seed, n, ties)
    e = spark.createDataFrame(edges, "src long, dst long, mr double").repartition(5)
    v = spark.createDataFrame([(p,) for p in points], "id long")
    got = H.hierarchical_clusters(e, v, m, max_edges=max_edges).collect()
    if not ties:  # equal distances split a cluster one edge at a time, in either order of the two
        _check(got, brute(points, edges, m))
    else:
        again = H.hierarchical_clusters(e.repartition(3), v, m, max_edges=1 << 20).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_spanning_forest_is_kruskals(spark):
    _, edges = _random_graph(3, 200, True)
    e = spark.createDataFrame(edges, "src long, dst long, mr double")
    assert sorted((r.w, r.u, r.v) for r in H.spanning_forest(e).collect()) == sorted(_forest(edges))


def _two_densities(spark):
    """Two tight groups near each other, two loose ones far apart, and noise."""
    rng = np.random.default_rng(7)
    groups = [rng.normal(size=(60, 2)) * s + c for s, c in ((0.05, (0, 0)), (0.05, (1, 0)), (3, (60, 0)), (3, (60, 40)))]
    bridge = np.column_stack([np.linspace(0.1, 0.9, 16), rng.normal(size=16) * 0.01])  # between the tight ones
    noise = rng.uniform(-100, 150, size=(25, 2))
    x = np.vstack([*groups, bridge, noise])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, vec array<double>")
    return df, [set(range(60 * g, 60 * g + 60)) for g in range(4)]


def _found(rows, groups):
    """How many groups are a cluster of their own (nine tenths of it, no other's points)."""
    members = {}
    for r in rows:
        if r["cluster"] >= 0:
            members.setdefault(r["cluster"], set()).add(r["id"])
    return sum(any(len(c & g) >= 54 and not any(c & o for o in groups if o is not g) for c in members.values()) for g in groups)


def test_groups_of_different_density_where_every_flat_cut_fails(spark):
    df, groups = _two_densities(spark)
    g = C.knn_graph(df, 15, "id", "vec", metric="euclidean").cache()
    assert _found(C.density_clusters(g, 5, 25).collect(), groups) == 4
    assert all(_found(C.density_clusters(g, 5, 25, eps_quantile=q / 20).collect(), groups) < 4 for q in (8, 12, 16, 19))
    g.unpersist()


def test_keyed_graphs_are_clustered_apart(spark):
    parts = []
    for k in (1, 2):
        points, edges = _random_graph(k, 150, False)
        parts.append((k, points, edges, 5 + 4 * k))
    e = spark.createDataFrame([(k, *x) for k, _, es, _ in parts for x in es], "trial int, src long, dst long, mr double")
    v = spark.createDataFrame([(k, p) for k, ps, _, _ in parts for p in ps], "trial int, id long")
    sizes = spark.createDataFrame([(k, m) for k, _, _, m in parts], "trial int, min_cluster_size int")
    rows = H.hierarchical_clusters(e, v, sizes, ["trial"]).collect()
    for k, points, edges, m in parts:
        _check([r for r in rows if r["trial"] == k], brute(points, edges, m))


def test_edge_cases(spark):
    empty_e, empty_v = spark.createDataFrame([], "src long, dst long, mr double"), spark.createDataFrame([], "id long")
    assert H.hierarchical_clusters(empty_e, empty_v, 3).count() == 0
    v = spark.createDataFrame([(i,) for i in range(6)], "id long")
    assert {r["cluster"] for r in H.hierarchical_clusters(empty_e, v, 3).collect()} == {-1}
    # equal points, one tree that never splits: one cluster
    e = spark.createDataFrame([(i, i + 1, 0.0) for i in range(4)], "src long, dst long, mr double")
    got = {r["id"]: (r["cluster"], r["probability"]) for r in H.hierarchical_clusters(e, v, 3).collect()}
    assert got == {**{i: (0, 1.0) for i in range(5)}, 5: (-1, 0.0)}
    # a graph too large for one task in rounds, empty rest
    assert {r["id"]: (r["cluster"], r["probability"]) for r in H.hierarchical_clusters(e, v, 3, max_edges=2).collect()} == got


def test_queries(spark):
    from quizspark.plans.catalog import QUERIES
    # the vectors of this table are noise (no nearer to their own label's): one tree that never splits
    rows = QUERIES["density_clusters"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 500 and all(0 <= r["probability"] <= 1 for r in rows)
    labels = QUERIES["prompt_categories"](spark, "/root/testdata/sf0.001").collect()
    assert len({r["cluster_label"] for r in labels if r["cluster_label"] >= 0}) > 1
