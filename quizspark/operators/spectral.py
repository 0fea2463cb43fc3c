"""Coordinates that keep neighbours together: leading eigenvectors of the
neighbour graph, by block power iteration.

Edges get the weight exp(-d^2 / (s_i s_j)), s the distance to a row's last
neighbour, so dense and sparse regions count alike. The matrix (I + D^-1/2 W
D^-1/2) / 2 is dealt by row into parts, which stay where they are. To multiply a
tall block of columns, each row of it goes once to every part that has a neighbour
of it, and a part returns whole rows of the product. The block is made orthonormal
again by its Gram matrix (a few hundred sums, factored on the driver), and the
iteration stops when the leading eigenvalues settle. The first eigenvector is constant on each connected part and
is left out. Each coordinate's largest entry is positive, and the start is a
hash of the id, so a rerun gives the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizspark.session import saved


#: Parts of the matrix: their number, if there are ``PART_ROWS[0]`` rows for each, and most rows of one.
PARTS, PART_ROWS = 16, (64, 1 << 18)


def _matrix(knn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges (src, dst, s) of the symmetric matrix with its diagonal, degrees (id, deg))."""
    scale = knn.groupBy("id").agg(F.max("dist").alias("s"))
    e = (knn.join(scale, "id").join(scale.withColumnsRenamed({"id": "nbr", "s": "t"}), "nbr")
         .select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b"),
                 F.exp(-F.col("dist") * F.col("dist") / F.greatest(F.col("s") * F.col("t"), F.lit(1e-300))).alias("w"))
         .groupBy("a", "b").agg(F.max("w").alias("w")).where("a <> b"))
    both = e.union(e.select("b", "a", "w")).toDF("src", "dst", "w").transform(saved)
    deg = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg")).transform(saved)
    s = (both.join(deg.toDF("src", "d1"), "src").join(deg.toDF("dst", "d2"), "dst")
         .select("src", "dst", (F.col("w") / F.sqrt(F.col("d1") * F.col("d2")) / 2).alias("s")))
    return s.union(deg.select("id", F.col("id").alias("dst"), F.lit(0.5))).transform(saved), deg


def _parts(s: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(part, id, targets, nbrs, weights) of the rows of the matrix, kept by part, and the number
    of parts; ``targets`` are the parts of a row's neighbours, itself among them."""
    parts = max(1, min(PARTS, n // PART_ROWS[0]), -(-n // PART_ROWS[1]))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    rows = (s.groupBy(F.col("src").alias("id")).agg(F.collect_set(part("dst")).alias("targets"), F.collect_list(F.struct("dst", "s")).alias("e"))
            .select(part("id").alias("part"), "id", "targets", F.col("e.dst").alias("nbrs"), F.col("e.s").alias("weights")))
    return rows.transform(saved).repartition(2 * parts, "part").persist(StorageLevel.MEMORY_AND_DISK), parts


def _times(rows: DataFrame, parts: int, x: DataFrame, cols: list[str], before: list[str] = []) -> DataFrame:
    """(id, targets, cols) of the matrix times the block ``x`` of that shape; ``before`` names columns for the block itself."""
    told = x.select(F.explode("targets").alias("to"), F.col("id").alias("told_id"), *cols).repartition(2 * parts, "to")

    def run(a: pa.Table, t: pa.Table) -> pa.Table:
        order = np.argsort(t["told_id"].to_numpy())
        ids, lists = t["told_id"].to_numpy()[order], a["nbrs"].combine_chunks()
        at, own = (order[np.searchsorted(ids, i)] for i in (lists.flatten().to_numpy(), a["id"].to_numpy()))
        weights = a["weights"].combine_chunks().flatten().to_numpy()
        starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        block = [t[c].to_numpy() for c in cols]
        return pa.table({"id": a["id"], "targets": a["targets"], **{c: np.add.reduceat(b[at] * weights, starts) for c, b in zip(cols, block)},
                         **{c: b[own] for c, b in zip(before, block)}})
    types = "id long, targets array<int>, " + ", ".join(f"{c} double" for c in [*cols, *before])
    return rows.groupBy("part").cogroup(told.groupBy("to")).applyInArrow(run, types)


def _dots(df: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """The symmetric matrix of products of two blocks; its upper half is summed."""
    at = np.triu_indices(len(left))
    row = df.agg(*[F.sum(F.col(left[i]) * F.col(right[j])) for i, j in zip(*at)]).first()
    out = np.zeros((len(left), len(left)))
    out[at] = [v or 0.0 for v in row]
    return out + np.triu(out, 1).T


def _combined(cols: list[str], m: np.ndarray) -> list[Column]:
    """Columns times a small matrix, under the same names."""
    return [sum((F.col(c) * float(m[i, j]) for i, c in enumerate(cols)), F.lit(0.0)).alias(cols[j]) for j in range(len(cols))]


def spectral_coordinates(knn: DataFrame, k: int, extra: int = 4, steps: int = 4, max_rounds: int = 40, tol: float = 1e-5) -> DataFrame:
    """(id, reduced array<double> of ``k``) from a neighbour graph (id, nbr,
    dist). Coordinates are nested: a smaller ``k`` gives the first ones. Rounds end
    when the leading eigenvalues move by less than ``tol``, at most ``max_rounds``.
    A graph of fewer than ``k`` + 2 rows pads with zeros; an empty one gives an
    empty result."""
    s, deg = _matrix(knn)
    n = deg.count()
    m = min(k + 1 + extra, n)
    cols = [f"x{i}" for i in range(m)]
    kept = cols[1:k + 1]
    if not m:
        return deg.select("id", F.array(*[F.lit(0.0)] * k).alias("reduced"))
    rows, parts = _parts(s, n)
    x = rows.select("id", "targets", *[(F.xxhash64("id", F.lit(i)) / F.lit(2.0 ** 63)).alias(c) for i, c in enumerate(cols)])
    last, before, made = None, [f"y{i}" for i in range(m)], 0
    for _ in range(max_rounds):
        for _ in range(steps - made):
            x = _times(rows, parts, x, cols)
        # the block ``before`` and its product, which the next round goes on from
        both = _times(rows, parts, x, cols, before).transform(saved)
        made = 1
        g = _dots(both, before, before)
        turn = np.linalg.inv(np.linalg.cholesky(g + np.eye(m) * 1e-14 * np.trace(g))).T
        t = turn.T @ _dots(both, before, cols) @ turn
        values, vectors = np.linalg.eigh((t + t.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        x = both.select("id", "targets", *_combined(cols, turn))
        top = values[:k + 1]
        if last is not None and np.abs(top - last).max() < tol:
            break
        last = top
    out = (both.select("id", *_combined(before, turn @ vectors)).toDF("id", *cols).join(deg, "id")
           .select("id", *[(F.col(c) / F.sqrt("deg")).alias(c) for c in kept]).transform(saved))
    rows.unpersist()
    if kept:
        peaks = out.agg(*[F.max_by(F.col(c), F.struct(F.round(F.abs(c), 12), -F.col("id"))).alias(c) for c in kept]).first()
        sizes = out.agg(*[F.sqrt(F.avg(F.col(c) * F.col(c))).alias(c) for c in kept]).first()
        out = out.select("id", *[(F.col(c) * F.lit((1.0 if (peaks[c] or 0) >= 0 else -1.0) / (sizes[c] or 1.0))).alias(c) for c in kept])
    return out.select("id", F.array(*[F.col(c) for c in kept], *[F.lit(0.0)] * (k - len(kept))).alias("reduced"))
