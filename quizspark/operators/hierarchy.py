"""Density clusters from a hierarchy: spanning forest of mutual reachability,
condensed by a smallest cluster size, clusters chosen by excess of mass.

Read from the densest edge on, an edge joins two components. While a component
has fewer than ``min_cluster_size`` points it is only a list of points. When it
reaches that size a cluster is born; a small component that joins later is
points that leave the cluster at this level (lambda = 1 / distance); two clusters
that join are the children of a new one. A child's stability is settled the
moment it joins - the sum over its points of (lambda where they leave it) minus
(lambda where it joins) - and so is the choice between it and its descendants,
whichever has the greater sum. Trees that no edge connects join at the longest
edge of the graph; the root of an only tree is chosen if nothing below it is a
cluster (or, with ``allow_single``, if it is the most stable). So one pass over the edges in order gives the
condensed tree and the choice, holding less than ``min_cluster_size`` points a
component. A point's label is the topmost chosen cluster above it.

* Graphs of at most ``max_edges`` edges a key: a group is a graph, read in one
  task (many keys, as in the parameter search, run side by side).
* More edges are first dealt into parts, of which only the least spanning forests
  stay: an edge that no forest of a part needs, the whole graph's does not need
  either, and it would join nothing. Then they may be few enough.
* Larger ones: a distributed spanning forest (each component's least edge,
  components contracted, least edge of each pair of components kept), then the
  pass in rounds of ``max_edges`` edges, whose components are the points of the
  next round. The pass itself is a few microseconds an edge; what grows with the
  graph, the forest and the relabelling of its edges, is distributed. The result
  is the same.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizspark.operators.position import global_position, join_small
from quizspark.session import saved

#: Distances are at least this, so that lambda is finite for equal points.
LEAST = 1e-9
MAX_EDGES = 1 << 20
#: Edges of a part, of which only the spanning forest stays; numbers in arrays, so more than ``MAX_EDGES``.
PART_EDGES = 1 << 21


class Condenser:
    """Components by their name: [size, cluster, sum of lambda, sum of the best
    of its children, points]; grows as edges come in order."""

    def __init__(self, min_size: int):
        self.min_size = min_size
        self.state: dict = {}
        self.up: dict = {}
        self.points: list[tuple] = []    # (point, cluster, lambda)
        self.clusters: list[tuple] = []  # (cluster, parent, stability, chosen)

    def add(self, name, size: int, cluster, total: float, best: float, points) -> None:
        self.state[name] = [size, cluster, total, best, points]
        self.up[name] = name

    def find(self, name):
        top = name
        while self.up[top] != top:
            top = self.up[top]
        while self.up[name] != top:
            self.up[name], name = top, self.up[name]
        return top

    def settle(self, s: list, parent, lam: float) -> float:
        """Close a cluster that joins others at ``lam``; the best of its subtree."""
        stability = s[2] - s[0] * lam
        chosen = stability >= s[3] or s[3] <= 0  # without children it is
        self.clusters.append((s[1], parent, stability, chosen))
        return stability if chosen else s[3]

    def join(self, a, b, distance: float, number) -> None:
        a, b = self.find(a), self.find(b)
        if a == b:
            return
        lam = 1.0 / max(distance, LEAST)
        x, y = self.state[a], self.state[b]
        if x[0] < y[0]:
            a, b, x, y = b, a, y, x
        self.up[b] = a
        del self.state[b]
        size = x[0] + y[0]
        if y[1] is not None and x[1] is not None:  # two clusters: children of a new one
            best = self.settle(x, number, lam) + self.settle(y, number, lam)
            self.state[a] = [size, number, size * lam, best, []]
        elif x[1] is not None or y[1] is not None:
            big, small = (x, y) if x[1] is not None else (y, x)
            self.points.extend((p, big[1], lam) for p in small[4])
            self.state[a] = [size, big[1], big[2] + small[0] * lam, big[3], []]
        elif size >= self.min_size:
            self.points.extend((p, number, lam) for p in (*x[4], *y[4]))
            self.state[a] = [size, number, size * lam, 0.0, []]
        else:
            self.state[a] = [size, None, 0.0, 0.0, [*x[4], *y[4]]]

    def finish(self, allow_single: bool, lam: float) -> None:
        """What remains are trees of their own, which join at ``lam``."""
        roots = [s for s in self.state.values() if s[1] is not None]
        for s in roots:
            self.settle(s, None, lam)
            if len(roots) == 1 and not allow_single and s[3] > 0:
                self.clusters[-1] = (*self.clusters[-1][:3], False)
        for s in self.state.values():
            if s[1] is None:
                self.points.extend((p, None, 0.0) for p in s[4])

    def top_chosen(self) -> dict:
        """The topmost chosen cluster at or above each; parents are closed later."""
        top: dict = {}
        for c, parent, _, chosen in reversed(self.clusters):
            above = top.get(parent) if parent is not None else None
            top[c] = above if above is not None else (c if chosen else None)
        return top


# --- spanning forests of parts of a graph ---------------------------------------

def least_forest(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges of the least spanning forest, ordered by (w, u, v); every
    round each component takes its first edge."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    place = np.lexsort((v, u, w))
    a, b = at[:len(u)][place], at[len(u):][place]
    found, size = [], len(names)
    while True:
        apart = a != b
        a, b, place = a[apart], b[apart], place[apart]
        if not len(a):
            break
        first, other = np.full(size, len(a)), np.full(size, len(a))
        first[a[::-1]] = other[b[::-1]] = np.arange(len(a))[::-1]  # the last one written stays
        first = np.minimum(first, other)
        own = np.flatnonzero(first < len(a))
        taken = first[own]
        taken_once = np.zeros(len(a), bool)
        taken_once[taken] = True
        found.append(place[taken_once])
        to = np.arange(size)
        to[own] = a[taken] + b[taken] - own
        each_other = own[(to[to[own]] == own) & (own < to[own])]
        to[each_other] = each_other
        while not np.array_equal(to, ahead := to[to]):
            to = ahead
        a, b = to[a], to[b]
    kept = np.concatenate(found) if found else place
    return kept[np.lexsort((v[kept], u[kept], w[kept]))]


def forest_table(keys: dict, src: np.ndarray, dst: np.ndarray, w: np.ndarray, longest: float) -> pa.Table:
    """(keys, src, dst, mr, longest) of the least spanning forest of edges, of which ``longest`` is the longest."""
    u, v = np.minimum(src, dst), np.maximum(src, dst)
    kept = least_forest(u, v, w)
    return pa.table({**{k: pa.repeat(value, len(kept)) for k, value in keys.items()},
                     "src": u[kept], "dst": v[kept], "mr": w[kept], "longest": np.full(len(kept), longest)})


FOREST = "src long, dst long, mr double, longest double"


def part_forests(edges: DataFrame, keys: list, parts: int) -> DataFrame:
    """(keys, src, dst, mr, longest): of each key's edges, dealt into ``parts``, the
    least spanning forest of every part, and the longest edge of the part."""
    longest = F.col("longest") if "longest" in edges.columns else F.col("mr")
    ends = F.least("src", "dst"), F.greatest("src", "dst")
    dealt = edges.where("src <> dst").select(*keys, "src", "dst", "mr", longest.alias("longest"), F.pmod(F.xxhash64(*ends), F.lit(parts)).cast("int").alias("_part"))

    def run(t: pa.Table) -> pa.Table:
        src, dst, mr, longest = (t[c].to_numpy() for c in ("src", "dst", "mr", "longest"))
        return forest_table({k: t[k][0] for k in keys}, src, dst, mr, longest.max())
    types = "".join(f"{k} {edges.schema[k].dataType.simpleString()}, " for k in keys)
    return dealt.groupBy(*keys, "_part").applyInArrow(run, types + FOREST)


_POINTS = "id long, cluster_raw long, lambda double"


def whole_tree(ids: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, longest: float, min_size: int,
               allow_single: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, probability) of each point, as :func:`hierarchical_clusters` gives
    them, from the edges of the least spanning forest in order; ``u`` and ``v`` are
    places in ``ids``, ``longest`` is the longest edge of the graph."""
    c = Condenser(min_size)
    for i in range(len(ids)):
        c.add(i, 1, None, 0.0, 0.0, [i])
    for n, (a, b, x) in enumerate(zip(u.tolist(), v.tolist(), w.tolist())):
        c.join(a, b, x, n)
    c.finish(allow_single, 1.0 / max(longest, LEAST) if len(w) else 0.0)
    top = c.top_chosen()
    raw, lam = np.full(len(ids), -1), np.zeros(len(ids))
    for point, cluster, x in c.points:
        label = top.get(cluster)
        if label is not None:
            raw[point], lam[point] = label, x
    cluster, probability = np.full(len(ids), -1, np.int32), np.zeros(len(ids))
    own = np.flatnonzero(raw >= 0)
    names, at = np.unique(raw[own], return_inverse=True)
    first, most = np.full(len(names), np.iinfo(np.int64).max), np.zeros(len(names))
    np.minimum.at(first, at, ids[own])
    np.maximum.at(most, at, lam[own])
    cluster[own] = np.argsort(np.argsort(first))[at]
    probability[own] = lam[own] / most[at]
    return cluster, probability


def _whole_graphs(edges: DataFrame, verts: DataFrame, keys: list, min_size: DataFrame | int, allow_single: bool) -> DataFrame:
    """Each key's graph in one task; ``longest`` of a row is the longest edge that it stands for."""
    sized = edges.select(*keys, "src", "dst", "mr", "longest")
    points = verts.select(*keys, "id")
    if keys:
        points = points.join(F.broadcast(min_size), keys)  # a row per key
    else:
        points = points.withColumn("min_cluster_size", F.lit(min_size))
        sized, points = sized.withColumn("_one", F.lit(0)), points.withColumn("_one", F.lit(0))
    group = keys or ["_one"]
    points = points.select(*[F.col(k).alias(f"_of_{k}") for k in group], "id", "min_cluster_size")

    def run(key, e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if v.empty:
            return pd.DataFrame({"id": [], "cluster_raw": [], "lambda": []})
        c = Condenser(int(v["min_cluster_size"].iloc[0]))
        for i in v["id"].tolist():
            c.add(i, 1, None, 0.0, 0.0, [i])
        u, w = np.minimum(e["src"], e["dst"]).to_numpy(), np.maximum(e["src"], e["dst"]).to_numpy()
        d = e["mr"].to_numpy()
        order = np.lexsort((w, u, d))
        for n, (a, b, x) in enumerate(zip(u[order].tolist(), w[order].tolist(), d[order].tolist())):
            c.join(a, b, x, n)
        c.finish(allow_single, 1.0 / max(e["longest"].max(), LEAST) if len(d) else 0.0)
        top = c.top_chosen()
        rows = [(p, top.get(k), lam) for p, k, lam in c.points]
        out = pd.DataFrame(rows, columns=["id", "cluster_raw", "lambda"])
        out["cluster_raw"] = out["cluster_raw"].astype("Int64")
        for k, value in zip(keys, key):
            out[k] = value
        return out[[*keys, "id", "cluster_raw", "lambda"]]
    types = "".join(f"{k} {verts.schema[k].dataType.simpleString()}, " for k in keys)
    return sized.groupBy(*group).cogroup(points.groupBy(*[f"_of_{k}" for k in group])).applyInPandas(run, types + _POINTS)


# --- spanning forest of a large graph -------------------------------------------

def spanning_forest(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest (u, v, w) of undirected edges (src, dst, mr); ties
    by (u, v), so it is unique. Every round each component takes its least edge
    and the components so joined become one."""
    least = F.min(F.struct("w", "u", "v"))
    cur = (edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("mr").alias("w"))
           .groupBy("a", "b").agg(F.min("w").alias("w")).select("a", "b", "w", F.col("a").alias("u"), F.col("b").alias("v")).transform(saved))
    found = []
    while not cur.isEmpty():
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "u", "v"))
        best = both.groupBy("a").agg(F.min(F.struct("w", "u", "v", "b")).alias("m")).transform(saved)
        found.append(best.select("m.u", "m.v", "m.w").distinct().transform(saved))
        # pointers to the neighbour over the least edge; a pair that points at each other has its lesser as root
        ptr = best.select("a", F.col("m.b").alias("p"))
        back = ptr.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        ptr = ptr.join(back, "p").select("a", F.when((F.col("pp") == F.col("a")) & (F.col("a") < F.col("p")), F.col("a")).otherwise(F.col("p")).alias("p")).transform(saved)
        while True:
            ahead = ptr.select(F.col("a").alias("p"), F.col("p").alias("far"))
            jumped = ptr.join(ahead, "p").select("a", F.col("far").alias("p"), (F.col("far") != F.col("p")).alias("moved")).transform(saved)
            moved = not jumped.where("moved").isEmpty()
            ptr = jumped.drop("moved")
            if not moved:
                break
        to_a, to_b = ptr.toDF("a", "ra"), ptr.toDF("b", "rb")
        cur = (cur.join(to_a, "a").join(to_b, "b").where("ra <> rb")
               .groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(least.alias("m"))
               .select("a", "b", "m.w", "m.u", "m.v").transform(saved))
    if not found:
        return cur.select("u", "v", "w")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


_STATE = "name long, size long, cluster long, total double, best double, points array<long>"
_EVENTS = "kind int, name long, size long, cluster long, parent long, total double, best double, chosen boolean, points array<long>, now long"


def _round(edges: DataFrame, states: DataFrame, min_size: int) -> DataFrame:
    """One pass over a round's edges (a, b, w, pos) and the components they touch.
    Rows of kind 0: the components; 1: points (name, cluster, lambda in
    ``total``); 2: closed clusters (cluster, parent, stability in ``total``,
    chosen); 3: which component (``now``) a former one (``name``) is in."""
    def run(e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        c = Condenser(min_size)
        for name, size, cluster, total, best, points in zip(*(v[x] for x in ("name", "size", "cluster", "total", "best", "points"))):
            c.add(name, int(size), None if pd.isna(cluster) else int(cluster), total, best, list(points) if points is not None else [])
        e = e.sort_values("pos")
        for a, b, w, pos in zip(e["a"].tolist(), e["b"].tolist(), e["w"].tolist(), e["pos"].tolist()):
            c.join(a, b, w, pos)
        rows = [(0, k, s[0], s[1], None, s[2], s[3], None, s[4], None) for k, s in c.state.items()]
        rows += [(1, p, None, k, None, lam, None, None, None, None) for p, k, lam in c.points]
        rows += [(2, None, None, k, parent, stability, None, chosen, None, None) for k, parent, stability, chosen in c.clusters]
        rows += [(3, k, None, None, None, None, None, None, None, c.find(k)) for k in list(c.up)]
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in _EVENTS.split(", ")])
        for col in ("name", "size", "cluster", "parent", "now"):
            out[col] = out[col].astype("Int64")
        out["chosen"] = out["chosen"].astype("boolean")
        return out
    left = edges.select("a", "b", "w", "pos", F.lit(0).alias("one_e"))
    right = states.select("name", "size", "cluster", "total", "best", "points", F.lit(0).alias("one_v"))
    return left.groupBy("one_e").cogroup(right.groupBy("one_v")).applyInPandas(run, _EVENTS)


def _large_graph(edges: DataFrame, verts: DataFrame, min_size: int, max_edges: int, allow_single: bool) -> DataFrame:
    longest = edges.agg(F.max("longest")).first()[0]
    forest = spanning_forest(edges)
    left = (global_position(forest, ["w", "u", "v"], "pos").select(F.col("u").alias("a"), F.col("v").alias("b"), "w", "pos").transform(saved))
    states = verts.select(F.col("id").alias("name"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("long").alias("cluster"),
                          F.lit(0.0).alias("total"), F.lit(0.0).alias("best"), F.array("id").alias("points")).transform(saved)
    points, clusters, done, n = [], [], 0, left.count()
    while done < n:
        done += max_edges
        take, rest = left.where(F.col("pos") < done), left.where(F.col("pos") >= done)
        names = take.select(F.col("a").alias("name")).union(take.select(F.col("b").alias("name"))).distinct()
        events = _round(take, states.join(names, "name", "left_semi"), min_size).transform(saved)
        points.append(events.where("kind = 1").select(F.col("name").alias("id"), "cluster", F.col("total").alias("lambda")))
        clusters.append(events.where("kind = 2").select("cluster", "parent", F.col("total").alias("stability"), "chosen"))
        kept = events.where("kind = 0").select("name", "size", "cluster", "total", "best", "points")
        to = events.where("kind = 3").select("name", "now")
        states = states.join(to.select("name"), "name", "left_anti").unionByName(kept).transform(saved)
        for end in ("a", "b"):
            rest = rest.join(to.withColumnsRenamed({"name": end, "now": "_now"}), end, "left").withColumn(end, F.coalesce("_now", end)).drop("_now")
        left = rest.transform(saved)
    roots = states.where("cluster is not null")
    single = not allow_single and len(roots.limit(2).collect()) == 1
    stability = F.col("total") - F.col("size") * F.lit(1.0 / max(longest, LEAST))
    last = roots.select("cluster", F.lit(None).cast("long").alias("parent"), stability.alias("stability"),
                        ((F.col("best") <= 0) | ((stability >= F.col("best")) & ~F.lit(single))).alias("chosen"))
    points.append(states.where("cluster is null").select(F.explode("points").alias("id"), F.lit(None).cast("long").alias("cluster"), F.lit(0.0).alias("lambda")))
    tree, all_points = last, points[0]
    for c in clusters:
        tree = tree.unionByName(c)
    for p in points[1:]:
        all_points = all_points.unionByName(p)
    top = topmost_chosen(tree.transform(saved))
    return all_points.join(top, "cluster", "left").select("id", F.col("top").alias("cluster_raw"), "lambda")


def topmost_chosen(tree: DataFrame) -> DataFrame:
    """(cluster, top): the topmost chosen cluster at or above each, by doubling
    the pointers to parents."""
    t = tree.select("cluster", F.col("parent").alias("ptr"), F.when(F.col("chosen"), F.col("cluster")).alias("top")).transform(saved)
    while not t.where("ptr is not null").isEmpty():
        above = t.select(F.col("cluster").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("top").alias("top2"))
        t = t.join(above, "ptr", "left").select("cluster", F.col("ptr2").alias("ptr"), F.coalesce("top2", "top").alias("top")).transform(saved)
    return t.select("cluster", "top")


def hierarchical_clusters(edges: DataFrame, verts: DataFrame, min_size: DataFrame | int, keys: list | None = None,
                          allow_single: bool = False, max_edges: int = MAX_EDGES) -> DataFrame:
    """(keys, id, cluster, probability) of the graph ``edges`` (keys, src, dst,
    mr; ``longest`` too if they stand for longer edges) over ``verts`` (keys, id). With keys, ``min_size`` is a table (keys,
    min_cluster_size). Clusters are numbered by their smallest member; a point's
    probability is its lambda by the greatest of its cluster; noise is -1 with 0."""
    keys = list(keys or [])

    def largest(e: DataFrame) -> int:
        return e.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    most = largest(edges)
    while most > max_edges:
        fewer = part_forests(edges, keys, -(-most // PART_EDGES)).transform(saved)
        before, edges, most = most, fewer, largest(fewer)
        if 2 * most > before:  # nearly a forest already
            break
    if "longest" not in edges.columns:
        edges = edges.withColumn("longest", F.col("mr"))
    if most <= max_edges:
        raw = _whole_graphs(edges, verts, keys, min_size, allow_single)
    elif keys:  # large graphs one after another; the caller made a row per key
        raw = None
        for r in min_size.collect():
            own = [F.col(k) == F.lit(r[k]) for k in keys]
            one = _large_graph(edges.where(reduce(Column.__and__, own)), verts.where(reduce(Column.__and__, own)), r["min_cluster_size"], max_edges, allow_single)
            one = one.select(*[F.lit(r[k]).alias(k) for k in keys], "*").transform(saved)
            raw = one if raw is None else raw.unionByName(one)
    else:
        raw = _large_graph(edges, verts, min_size, max_edges, allow_single)
    raw = raw.transform(saved)
    firsts = raw.where("cluster_raw is not null").groupBy(*keys, "cluster_raw").agg(F.min("id").alias("_first"), F.max("lambda").alias("_most"))
    firsts = global_position(firsts, [*[F.col(k) for k in keys], F.col("_first")], "_at")
    if keys:
        starts = firsts.groupBy(*keys).agg(F.min("_at").alias("_start"))
        firsts = join_small(firsts, starts, keys).withColumn("_at", F.col("_at") - F.col("_start"))
    firsts = firsts.select(*keys, "cluster_raw", F.col("_at").cast("int").alias("cluster"), "_most")
    out = join_small(raw, firsts, keys + ["cluster_raw"], "left")
    return out.select(*keys, "id", F.coalesce("cluster", F.lit(-1)).alias("cluster"),
                      F.when(F.col("cluster").isNotNull(), F.col("lambda") / F.col("_most")).otherwise(0.0).alias("probability"))
