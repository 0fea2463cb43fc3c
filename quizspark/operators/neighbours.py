"""k nearest neighbours of large tables with near linear work.

Every row falls into one cell in each of ``tables`` random partitions: the signs
of its projections on some random directions, as many as give cells of about
``cell_rows`` rows. Inside a cell all distances are computed, so each row starts
with the best of some hundred candidates. A cell with more than four times
``cell_rows`` rows (many equal or near rows) is dealt out evenly into smaller
ones, another deal in each partition; no row is left out of any.

Then rounds: a row's neighbours and those it is a neighbour of are likely
neighbours of each other. Around each row they meet, at most ``MEETING`` at a
time (a row that is neighbour of very many has several meetings), and their
distances are offered to the lists of both; where all have met before, they do
not meet again. Rounds go on until at most
``settled`` of all list entries change.

A graph of up to ``GRAPH_ROWS`` rows is made by one task in the same way, in arrays
(``descent_lists``): nothing of it is shuffled, and a dozen graphs are a dozen tasks.

Exact lists over nested leading dimensions (``nested_lists``) serve tables of
moderate size, where a graph for each of a dozen dimension counts would have its
own meetings: blocks of rows meet all others, a few numbers each, once for all
the graphs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizspark.session import saved

MEETING = 64
_EDGES = "dims int, id long, nbr long, dist double"


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
        b = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        d = a @ b.T
        return np.subtract(1.0, d, out=d)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0))


def nearest(ids: np.ndarray, others: np.ndarray, d: np.ndarray, k: int, apart: bool = False, axis: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, distance) of the k nearest others of each row of the
    distances ``d`` (``axis`` 0: of each column); ties to the lower id. ``apart``
    says that no id is on both sides. The others are dealt into more than k
    groups: the k-th least of their minima is at least the k-th least distance,
    so only the few entries up to it are sorted."""
    if not d.size:
        return ids[:0], others[:0], d.ravel()
    if not apart:
        same = ids[:, None] == others[None, :]
        d = np.where(same if axis else same.T, np.inf, d)
    n, width = d.shape[axis], d.shape[1]
    k = min(k, n)
    groups = max(k, min(n, max(4 * k, n // 16)))
    dealt = n // groups * groups
    least = d[:, :dealt].reshape(len(d), -1, groups).min(axis=1) if axis else d[:dealt].reshape(-1, groups, width).min(axis=0)
    if np.isnan(least).any():
        return nearest(ids, others, np.where(np.isnan(d), np.inf, d), k, apart, axis)
    bound = np.take(np.partition(least, k - 1, axis=axis), [k - 1], axis=axis)
    at = np.divmod(np.flatnonzero(d <= bound), width)
    dist, row, nbr = d[at], at[1 - axis], others[at[axis]]
    order = np.lexsort((nbr, dist, row))
    row = row[order]
    first = (np.arange(len(row)) - np.searchsorted(row, row) < k) & np.isfinite(dist[order])
    return ids[row[first]], nbr[order[first]], dist[order[first]]


def _best(ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, distance) of the k nearest others of each row."""
    return nearest(ids, ids, d, k)


#: Blocks of asking rows, rows of one at least and at most, bytes of a block of candidates, sides of a tile.
ASKING, ASKING_ROWS, CANDIDATE_BYTES, TILE = 48, (256, 1 << 14), 1 << 25, (128, 1024)


def _least(at: np.ndarray, nbr: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least offers of each row, by row and distance; ties to the lower id."""
    order = np.lexsort((nbr, d, at))
    at = at[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[first], nbr[order][first], d[order][first]


def _nested_tile(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int, prefixes: list[int]) -> list:
    """(row, neighbour, squared distance) of the k nearest of ``others`` (columns
    of ``y``) to each row of ``x``, for each number of leading dimensions. A
    dimension's part is added once for all; an entry is looked at again only if
    it is within the k-th least so far, which is settled anew as the entries
    seen have doubled."""
    bound = [np.full(len(x), np.inf) for _ in prefixes]
    hits: list[list] = [[] for _ in prefixes]

    def settle(n: int) -> tuple:
        kept = _least(*map(np.concatenate, zip(*hits[n])), k)
        hits[n] = [kept]
        count = np.bincount(kept[0], minlength=len(x))
        full = count >= k
        bound[n][full] = kept[2][np.cumsum(count)[full] - 1]
        return kept
    for t, j in enumerate(range(0, len(others), TILE[1])):
        own, part = others[j:j + TILE[1]], y[:, j:j + TILE[1]]
        d = np.where(ids[:, None] == own, np.inf, 0.0)
        step, dim = np.empty_like(d), 0
        for n, p in enumerate(prefixes):
            for dim in range(dim, min(p, len(part))):
                np.subtract(x[:, dim, None], part[dim], out=step)
                d += np.multiply(step, step, out=step)
            dim = min(p, len(part))
            if not t and len(own) > k:
                least = np.partition(d, k - 1, axis=1)[:, k - 1]
                bound[n] = np.where(np.isnan(least), np.inf, least)
            near = np.flatnonzero(d <= bound[n][:, None])
            row, col = np.divmod(near, len(own))
            hits[n].append((row, own[col], d.ravel()[near]))
        if t and not t & (t + 1):
            for n in range(len(prefixes)):
                settle(n)
    return [tuple(c[np.isfinite(kept[2])] for c in kept) for kept in map(settle, range(len(prefixes)))]


def nested_lists(df: DataFrame, k: int, prefix_dims, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """(dims, id, nbrs array<long>, dists array<double>): the exact k nearest
    neighbours of every row by Euclidean distance over each number of leading
    dimensions, nearest first (self excluded; ties to the lower id). Rows are
    dealt by id into blocks of asking rows and into blocks of candidates of at most
    ``CANDIDATE_BYTES``; each pair of blocks meets in one group, which returns k
    rows of each asking one."""
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    n, dim = v.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    prefixes = sorted(set(map(int, prefix_dims)))
    asking = max(1, min(ASKING, -(-n // ASKING_ROWS[0])), -(-n // ASKING_ROWS[1]))
    blocks = max(1, -(-n * 8 * max(1, dim or 1) // CANDIDATE_BYTES))
    asks, told = F.pmod(F.xxhash64("id"), F.lit(asking)).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    left = v.select("id", "v", asks.alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("told"))
    # other names than the left side's: both come from the same columns
    right = v.select(F.col("id").alias("told_id"), F.col("v").alias("told_v"), told.alias("of_told"), F.explode(F.sequence(F.lit(0), F.lit(asking - 1))).alias("of_asks"))

    def rows(t: pa.Table, id_col: str, vec_col: str) -> tuple[np.ndarray, np.ndarray]:
        at = t.column(vec_col).combine_chunks()
        values = at.flatten().to_numpy(zero_copy_only=False)
        if at.null_count or len(values) % len(at):
            raise ValueError("nested_lists: vectors must be there and of one length")
        return t.column(id_col).to_numpy(), values.reshape(len(at), -1)

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and c.num_rows:
            (qid, x), (cid, y) = rows(q, "id", "v"), rows(c, "told_id", "told_v")
            y = np.ascontiguousarray(y.T)
            own, at = np.unique(qid, return_inverse=True)  # copies of an id share a list
            found = [_nested_tile(qid[i:i + TILE[0]], x[i:i + TILE[0]], cid, y, k, prefixes) for i in range(0, len(qid), TILE[0])]
            for p, tiles in zip(prefixes, zip(*found)):
                row = np.concatenate([at[i * TILE[0] + t[0]] for i, t in enumerate(tiles)])
                row, nbr, d = _least(row, *(np.concatenate(x) for x in list(zip(*tiles))[1:]), k)
                there, count = np.unique(row, return_counts=True)
                ends = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
                out.append((np.full(len(there), p, np.int32), own[there], pa.ListArray.from_arrays(ends, pa.array(nbr, pa.int64())),
                            pa.ListArray.from_arrays(ends, pa.array(np.sqrt(d), pa.float64()))))
        schema = pa.schema([("dims", pa.int32()), ("id", pa.int64()), ("nbrs", pa.list_(pa.int64())), ("dists", pa.list_(pa.float64()))])
        return pa.concat_tables([pa.table(list(map(pa.array, x[:2])) + list(x[2:]), schema=schema) for x in out] or [schema.empty_table()])
    key, of, tasks = ["asks", "told"], ["of_asks", "of_told"], asking * blocks
    lists = (left.repartition(tasks, *key).groupBy(*key).cogroup(right.repartition(tasks, *of).groupBy(*of))
             .applyInArrow(run, _LISTS))
    if blocks == 1:
        return lists
    best = lists.groupBy("dims", "id").agg(F.slice(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("dists", "nbrs")))), 1, k).alias("b"))
    return best.select("dims", "id", F.col("b.nbrs").alias("nbrs"), F.col("b.dists").alias("dists"))


_LISTS = "dims int, id long, nbrs array<long>, dists array<double>"

#: Rows of a graph that a task makes, distances that it holds at a time, offers that wait for being merged.
GRAPH_ROWS, ROOM_CELLS, OFFERS = 1 << 20, 1 << 22, 1 << 22


def _distinct(x: np.ndarray) -> np.ndarray:
    """Different values of whole numbers, ascending; sorting them is faster than ``np.unique``."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[:len(x)]]


class _Descent:
    """Lists of the ``k`` nearest found so far of the rows of ``x``, whose order is
    that of their ids: places of neighbours (-1: none), squared distances, and
    whether they are new."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.norm = (x * x).sum(1)
        # what the product of matrices may be off by
        self.slack = 1e-12 * max(1e-300, self.norm.max(initial=0.0))
        self.nbr, self.dist = np.full((len(x), k), -1, np.int32), np.full((len(x), k), np.inf)
        self.new, self.changed = np.zeros((len(x), k), bool), 0
        self.offers: list[tuple] = []

    def meet(self, rooms: np.ndarray, first: bool = False) -> None:
        """Offer all distances within each row of ``rooms`` (places; -1: an empty seat) that may enter a list."""
        size, n = rooms.shape[1], len(self.x)
        for i in range(0, len(rooms), step := max(1, ROOM_CELLS // (size * size))):
            room = rooms[i:i + step]
            x = self.x[room]
            norm = np.where(room < 0, np.inf, self.norm[room])
            d = np.matmul(x, x.transpose(0, 2, 1))
            d *= -2
            d += norm[:, :, None]
            d += norm[:, None, :]
            d[:, np.arange(size), np.arange(size)] = np.inf
            bound = self.dist[room, -1] + self.slack
            if first and size > self.k:
                bound = np.minimum(bound, np.partition(d, self.k - 1, axis=2)[:, :, self.k - 1] + 2 * self.slack)
            at = np.flatnonzero((d <= bound[:, :, None]) & (d < np.inf))
            seat, other = np.divmod(at, size)
            a, b = room.ravel()[seat], room.ravel()[seat // size * size + other]
            apart = self.ids[a] != self.ids[b]
            self.offers.append(_distinct(a[apart].astype(np.int64) * n + b[apart]))
            if sum(map(len, self.offers)) > OFFERS:
                self.merge()

    def merge(self) -> None:
        """The offers that wait enter the lists that they are near enough for."""
        pairs = _distinct(np.concatenate(self.offers)) if self.offers else np.empty(0, np.int64)
        self.offers = []
        found: list[tuple] = []
        for i in range(0, len(pairs), step := 1 << 16):
            a, b = np.divmod(pairs[i:i + step], len(self.x))
            other = (self.nbr[a] != b[:, None]).all(1)
            a, b = a[other], b[other]
            d = np.square(self.x[a] - self.x[b]).sum(1)
            near = d < self.dist[a, -1]
            found.append((a[near], b[near], d[near]))
        if not found:
            return
        a, b, d = (np.concatenate(x) for x in zip(*found))
        start = np.flatnonzero(np.append(True, a[1:] != a[:-1])[:len(a)])
        count = np.diff(start, append=len(a))
        for width in 1 << np.arange(int(count.max(initial=0)).bit_length() + 1):
            of = np.flatnonzero((count <= width) & (count > width // 2))
            for i in range(0, len(of), step := max(1, (1 << 20) // (width + self.k))):
                own, seats = of[i:i + step], np.arange(width)
                at = np.minimum(start[own, None] + seats, len(a) - 1)
                row, there = a[start[own]], seats < count[own, None]
                dist = np.hstack([self.dist[row], np.where(there, d[at], np.inf)])
                nbr = np.hstack([self.nbr[row], np.where(there, b[at], -1)])
                new = np.hstack([self.new[row], there])
                best = dist.argsort(axis=1, kind="stable")[:, :self.k]
                self.dist[row], self.nbr[row], self.new[row] = (np.take_along_axis(x, best, axis=1) for x in (dist, nbr, new))
                self.changed += int((best >= self.k).sum())

    def halves(self, cell_rows: int, rng: np.random.Generator) -> np.ndarray:
        """Rows dealt into cells of at most ``cell_rows``, halved at the middle along random directions."""
        levels = max(0, math.ceil(math.log2(max(1, len(self.x) / cell_rows))))
        cells = np.full(-(-len(self.x) // (1 << levels)) << levels, -1)
        cells[:len(self.x)] = rng.permutation(len(self.x))
        for level in range(levels):
            along = np.append(self.x @ rng.normal(size=self.x.shape[1]), np.inf)
            cells = cells.reshape(1 << level, -1)
            cells = np.take_along_axis(cells, along[cells].argsort(axis=1), axis=1)
        return cells.reshape(1 << levels, -1)

    def around(self, rng: np.random.Generator) -> Iterator[np.ndarray]:
        """Rooms around every row with a new neighbour, or that is one: its neighbours and those it is a neighbour of."""
        n = len(self.x)
        there = self.nbr >= 0
        at, member, new = np.repeat(np.arange(n, dtype=np.int32), there.sum(1)), self.nbr[there], self.new[there]
        meets = np.zeros(n, bool)
        meets[at[new]] = meets[member[new]] = True
        own, back = meets[at], meets[member]
        both = np.concatenate([at[own].astype(np.int64) * n + member[own], member[back].astype(np.int64) * n + at[back]])
        del there, at, member, new, own, back
        both.sort()
        both = both[np.append(True, both[1:] != both[:-1])[:len(both)]]
        at, member = (both // n).astype(np.int32), (both % n).astype(np.int32)
        del both
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1])[:len(at)])
        guests = np.diff(start, append=len(at))
        rooms = -(-guests // MEETING)
        for i in np.flatnonzero(rooms > 1):  # dealt evenly to several rooms
            rng.shuffle(member[start[i]:start[i] + guests[i]])
        lead = np.concatenate([s + (g * np.arange(r) // r) for s, g, r in zip(start[rooms > 1], guests[rooms > 1], rooms[rooms > 1])] or [np.empty(0, int)])
        begins = np.sort(np.concatenate([start[rooms == 1], lead]))
        size = np.diff(begins, append=len(at))
        wide = -(-size // 8) * 8
        for w in np.unique(wide[size > 1]):
            of = np.flatnonzero((wide == w) & (size > 1))
            for i in range(0, len(of), step := max(1, (1 << 22) // w)):
                own = of[i:i + step]
                seat = begins[own, None] + np.arange(w)
                yield np.where(np.arange(w) < size[own, None], member[np.minimum(seat, len(member) - 1)], -1)


def _descent(ids: np.ndarray, x: np.ndarray, k: int, cell_rows: int, tables: int, settled: float, max_rounds: int, seed: int) -> _Descent:
    rng = np.random.default_rng(seed)
    lists = _Descent(ids, x, k)
    for _ in range(tables if len(x) else 0):
        lists.meet(lists.halves(cell_rows, rng), first=True)
        lists.merge()
    for _ in range(max_rounds if len(x) else 0):
        rooms = lists.around(rng)
        for i, some in enumerate(rooms):
            if not i:
                lists.new[:], lists.changed = False, 0
            lists.meet(some)
        lists.merge()
        if lists.changed <= settled * len(x) * k:
            break
    return lists


def descent_lists(df: DataFrame, k: int, prefix_dims, id_col: str = "id", vec_col: str = "v", cell_rows: int = 128,
                  tables: int = 3, settled: float = 0.001, max_rounds: int = 12, seed: int = 1) -> DataFrame:
    """(dims, id, nbrs, dists) as :func:`nested_lists` gives, nearly: distances are
    exact, a few neighbours may be missed. A task reads the whole table ``df``, which
    should be saved, and makes the graph over one number of leading dimensions."""
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))

    def graph(dims: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x = [], []
            for b in batches:
                if b.num_rows:
                    ids.append(b["id"].to_numpy())
                    x.append(b["v"].flatten().to_numpy().reshape(b.num_rows, -1)[:, :dims])
            if not ids:
                return
            ids, x = np.concatenate(ids), np.concatenate(x)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], np.ascontiguousarray(x[order])
            found = _descent(ids, x, k, cell_rows, tables, settled, max_rounds, seed)
            own, at = np.unique(ids, return_inverse=True)  # copies of an id share a list
            cuts = np.append(np.searchsorted(at, np.arange(0, len(own), 10_000)), len(at))
            for first, last in zip(cuts[:-1], cuts[1:]):
                there = found.nbr[first:last] >= 0
                row, nbr, d = np.repeat(at[first:last], there.sum(1)), ids[found.nbr[first:last][there]], found.dist[first:last][there]
                if last - first > at[last - 1] - at[first] + 1:
                    order = np.lexsort((d, nbr, row))
                    row, nbr, d = row[order], nbr[order], d[order]
                    other = np.append(True, (row[1:] != row[:-1]) | (nbr[1:] != nbr[:-1]))[:len(row)]
                    row, nbr, d = _least(row[other], nbr[other], d[other], k)
                some, count = np.unique(row, return_counts=True)
                ends = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), dims, np.int32)), pa.array(own[some]), pa.ListArray.from_arrays(ends, pa.array(nbr)),
                                                  pa.ListArray.from_arrays(ends, pa.array(np.sqrt(d)))], ["dims", "id", "nbrs", "dists"])
        return run
    graphs = [v.coalesce(1).mapInArrow(graph(p), _LISTS) for p in sorted(set(map(int, prefix_dims)))]
    return reduce(DataFrame.union, graphs)


def cells(vectors: DataFrame, n: int, dim: int, cell_rows: int, table: int, seed: int) -> DataFrame:
    """(id, v, cell) of one random partition; cells are bounded."""
    bits = max(0, math.ceil(math.log2(max(1, n / cell_rows))))
    planes = np.random.default_rng((seed, table)).normal(size=(dim, max(1, bits)))
    spread = vectors.select(*[F.avg(F.get("v", i)).alias(f"m{i}") for i in range(dim)]).first()
    mean = np.array([x if x is not None else 0.0 for x in spread])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.vstack(b["v"].to_numpy()) - mean
            signs = ((x @ planes) > 0)[:, :bits]
            b["cell"] = signs @ (1 << np.arange(bits, dtype=np.int64)) if bits else 0
            yield b
    coded = vectors.mapInPandas(run, "id long, v array<double>, cell long")
    sizes = coded.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    parts = F.when(F.col("rows") > 4 * cell_rows, F.ceil(F.col("rows") / (2 * cell_rows))).otherwise(1)
    return coded.join(sizes, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id", F.lit(seed * 1000 + table)), parts).alias("part"))


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The k best of all offers to each row, with their rank; ties to the lower id."""
    best = (lists.groupBy("dims", "id", "nbr").agg(F.min("dist").alias("dist")).groupBy("dims", "id")
            .agg(F.slice(F.sort_array(F.collect_list(F.struct("dist", "nbr"))), 1, k).alias("b")))
    return best.select("dims", "id", F.posexplode("b").alias("rank", "e")).select(
        "dims", "id", F.col("e.nbr").alias("nbr"), F.col("e.dist").alias("dist"), (F.col("rank") + 1).alias("rank"))


def _meetings(graph: DataFrame, vectors: DataFrame, k: int, metric: str, groups: int) -> DataFrame:
    """Offers from the meetings around every row."""
    to = graph.select("dims", F.col("id").alias("at"), F.col("nbr").alias("member"), "new")
    back = graph.select("dims", F.col("nbr").alias("at"), F.col("id").alias("member"), "new")
    guests = to.union(back).groupBy("dims", "at", "member").agg(F.max("new").alias("new"))
    # guests that all met in an earlier round have nothing new to offer
    many = guests.groupBy("dims", "at").agg(F.count(F.lit(1)).alias("guests"), F.max("new").alias("any")).where("any").drop("any")
    seats = F.ceil(F.col("guests") / MEETING)
    seated = (guests.drop("new").join(many, ["dims", "at"]).withColumn("room", F.pmod(F.xxhash64("member", "at"), seats))
              .join(vectors.select(F.col("id").alias("member"), "v"), "member")
              .withColumn("task", F.pmod(F.xxhash64("dims", "at", "room"), F.lit(groups))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (dims, _, _), g in pdf.groupby(["dims", "at", "room"], sort=False):
            ids, x = g["member"].to_numpy(), np.vstack(g["v"].to_numpy()).astype(np.float64)
            out.append((dims, *_best(ids, distances(x if dims < 0 else x[:, :dims], x if dims < 0 else x[:, :dims], metric), k)))
        return pd.concat([pd.DataFrame({"dims": np.full(len(i), dims, np.int32), "id": i, "nbr": n, "dist": d}) for dims, i, n, d in out],
                         ignore_index=True).groupby(["dims", "id", "nbr"], as_index=False).min()
    return seated.groupBy("task").applyInPandas(run, _EDGES)


def approximate_knn(df: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", metric: str = "cosine", prefix_dims=None,
                    cell_rows: int = 128, tables: int = 3, settled: float = 0.001, max_rounds: int = 12, seed: int = 1) -> DataFrame:
    """(id, nbr, dist, rank) as :func:`quizspark.operators.clustering.knn_graph`
    gives, nearly: distances are exact, a few neighbours may be missed.
    ``prefix_dims`` adds a graph for each number of leading dimensions (``dims``).
    An empty table gives an empty graph."""
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    if not isinstance(v.schema["v"].dataType, T.ArrayType):
        v = v.withColumn("v", vector_to_array("v"))
    if v.schema["v"].dataType.elementType != T.FloatType():  # floats are shuffled as they are
        v = v.withColumn("v", F.col("v").cast("array<double>"))
    v = v.transform(saved)
    n, dim = v.count(), v.agg(F.max(F.size("v"))).first()[0] or 0
    prefixes = list(prefix_dims) if prefix_dims else [None]
    if metric == "cosine":
        wide = F.col("v").cast("array<double>")
        norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
        coded = v.select("id", F.transform(wide, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0))).alias("v"))
    else:
        coded = v.select("id", F.col("v").cast("array<double>").alias("v"))

    def in_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x, out = pdf["id"].to_numpy(), np.vstack(pdf["v"].to_numpy()), []
        for p in prefixes:
            i, nbr, d = _best(ids, distances(x[:, :p], x[:, :p], metric), k)
            out.append(pd.DataFrame({"dims": np.full(len(i), -1 if p is None else p, np.int32), "id": i, "nbr": nbr, "dist": d}))
        return pd.concat(out, ignore_index=True)
    lists = None
    for t in range(tables if n else 0):
        offers = cells(coded, n, dim, cell_rows, t, seed).groupBy("cell", "part").applyInPandas(in_cell, _EDGES)
        lists = offers if lists is None else lists.unionByName(offers)
    if lists is None:
        lists = df.sparkSession.createDataFrame([], _EDGES)
    graph = _merged(lists, k).withColumn("new", F.lit(True)).transform(saved)
    groups = max(8, n * len(prefixes) * k // 50_000)
    for _ in range(max_rounds):
        offers = _meetings(graph, v, k, metric, groups)
        former = graph.select("dims", "id", "nbr", F.lit(False).alias("new"))
        graph = (_merged(graph.drop("rank", "new").unionByName(offers), k).join(former, ["dims", "id", "nbr"], "left")
                 .withColumn("new", F.coalesce("new", F.lit(True))).transform(saved))
        if graph.where("new").count() <= settled * n * k * len(prefixes):
            break
    return graph.select(*(["dims"] if prefix_dims else []), "id", "nbr", "dist", "rank")
