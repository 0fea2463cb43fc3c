"""Embeddings from wide sparse rows: leading singular directions by a randomised
range finder.

TF-IDF rows over 2^18 hashed words are sparse: (id, features, values). A block of
``k`` + ``extra`` random columns is pulled through the matrix and its transpose a
few times, both in one pass: a task multiplies its rows with the block and the
product with their transpose, and returns a row per feature that it met, so the
rows themselves are never shuffled again. The block, of at most ``BLOCK_BYTES``
whatever the number of rows, is broadcast; one of more features takes joins of
the entries with it and aggregates instead. It is made orthonormal by its Gram
matrix. What the driver computes with are those small Gram matrices. With Q the
orthonormal block and Z = A^T Q, the eigenvectors of Z^T Z turn Q into the left
singular vectors, so a row's coordinates are Q U S. The start is a hash of the
feature and the largest entry of each coordinate is positive: reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizspark.operators.spectral import _combined, _dots
from quizspark.session import saved

#: Bytes of a block that is broadcast; 2^18 features times 24 columns are 50 MB.
BLOCK_BYTES = 1 << 26
#: Entries that a task multiplies at least: each returns up to a whole block.
TASK_ENTRIES = 1 << 23


def _hashed_rows(df: DataFrame, id_col: str, text_col: str, num_features: int) -> DataFrame:
    """(id, copies, words array<int>): the hashed words of all texts of an id."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"(?U)\W+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(num_features)).cast("int"))
    return (df.select(F.col(id_col).alias("id"), hashed.alias("words")).groupBy("id")
            .agg(F.count(F.lit(1)).alias("copies"), F.flatten(F.collect_list("words")).alias("words")))


def _tfidf_rows(hashed: DataFrame, num_features: int) -> DataFrame:
    """(id, features array<int>, values array<double>) of the unit-length TF-IDF
    rows; a row without words, or without an id, is left out."""
    n = hashed.agg(F.sum("copies")).first()[0] or 0
    idf = (hashed.select(F.explode(F.array_distinct("words")).alias("feature"))
           .groupBy("feature").agg((F.log((F.lit(n) + 1) / (F.count(F.lit(1)) + 1)) + 1).alias("idf")))
    known = idf.toArrow()  # at most num_features rows
    weights = hashed.sparkSession.sparkContext.broadcast((known["feature"].to_numpy(), known["idf"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = np.zeros(num_features)
        idf[weights.value[0]] = weights.value[1]
        for b in batches:
            values, features = [], []
            for words in b["words"]:
                f, tf = np.unique(words.values.to_numpy(), return_counts=True)
                v = tf * idf[f]
                features.append(f)
                values.append(v / np.sqrt(v @ v))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(features, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))],
                                             ["id", "features", "values"])
    kind = hashed.schema["id"].dataType.simpleString()
    return (hashed.where("id is not null and size(words) > 0").select("id", "words")
            .mapInArrow(run, f"id {kind}, features array<int>, values array<double>"))


def tfidf_entries(df: DataFrame, id_col: str, text_col: str, num_features: int = 1 << 18) -> DataFrame:
    """(id, feature, value) of the unit-length TF-IDF rows (smooth idf)."""
    rows = _tfidf_rows(_hashed_rows(df, id_col, text_col, num_features).transform(saved), num_features)
    return rows.select("id", F.explode(F.arrays_zip("features", "values")).alias("e")).select(
        "id", F.col("e.features").cast("long").alias("feature"), F.col("e.values").alias("value"))


def _pull(entries: DataFrame, block: DataFrame, at: str, to: str, cols: list[str]) -> DataFrame:
    """Entries times a block keyed by ``at``: a block keyed by ``to``."""
    return (entries.join(block, at).groupBy(to).agg(*[F.sum(F.col("value") * F.col(c)).alias(c) for c in cols]))


def _unit(g: np.ndarray) -> np.ndarray:
    """What makes the columns of Gram matrix ``g`` orthonormal."""
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    keep = values > 1e-12 * max(values.max(), 1e-300)
    scale = np.where(keep, 1 / np.sqrt(np.where(keep, values, 1.0)), 0.0)  # a rank below the block's leaves zero columns
    return vectors * scale


def _orthonormal(block: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return block.select(key, *_combined(cols, _unit(_dots(block, cols, cols)))).transform(saved)


def _sparse(b: pa.RecordBatch, most: int = 1 << 16) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows of a batch, of about ``most`` entries: (rows, where each row's
    entries start, their features, their values)."""
    ends = np.concatenate([[0], np.cumsum(np.diff(b["features"].offsets.to_numpy()))])
    features, values = b["features"].flatten().to_numpy(), b["values"].flatten().to_numpy()
    first = 0
    while first < b.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, side="right")) - 1)
        yield slice(first, last), ends[first:last] - ends[first], features[ends[first]:ends[last]], values[ends[first]:ends[last]]
        first = last


def _broadcast(block: DataFrame, cols: list[str], turn: np.ndarray):
    """The block times the small matrix ``turn``, features ascending, for all tasks."""
    t = block.select("feature", *cols).toArrow()
    features, order = t["feature"].to_numpy(), np.argsort(t["feature"].to_numpy())
    x = np.column_stack([t[c].to_numpy() for c in cols]) @ turn
    return block.sparkSession.sparkContext.broadcast((features[order], x[order]))


def _there_and_back(rows: DataFrame, block: DataFrame, cols: list[str], turn: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """With Y the rows times the block times ``turn``: the transpose of the rows times Y, keyed by
    feature, and the Gram matrix of Y."""
    m, sent = len(cols), _broadcast(block, cols, turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, x = sent.value
        back, gram, met = np.zeros_like(x), np.zeros((m, m)), np.zeros(len(x), bool)
        for b in batches:
            for _, starts, feature, value in _sparse(b):
                at = np.searchsorted(features, feature)
                y = np.add.reduceat(x[at] * value[:, None], starts)
                gram += y.T @ y
                row, order = np.repeat(np.arange(len(y)), np.diff(starts, append=len(at))), np.argsort(at)
                own, first = np.unique(at[order], return_index=True)
                back[own] += np.add.reduceat(y[row[order]] * value[order, None], first)
                met[own] = True
        if met.any():  # the Gram matrix as rows of features below zero
            key, out = np.concatenate([-1 - np.arange(m), features[met]]), np.vstack([gram, back[met]])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *[pa.array(out[:, j]) for j in range(m)]], ["feature", *cols])
    parts = rows.select("features", "values").mapInArrow(run, "feature long, " + ", ".join(f"{c} double" for c in cols))
    sums = parts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in cols]).transform(saved)
    sent.unpersist()
    gram = np.zeros((m, m))
    for r in sums.where("feature < 0").collect():
        gram[-1 - r["feature"]] = [r[c] for c in cols]
    return sums.where("feature >= 0"), gram


def _coordinates(rows: DataFrame, block: DataFrame, cols: list[str], turn: np.ndarray) -> DataFrame:
    """(id, cols): the rows times the block times ``turn``."""
    sent = _broadcast(block, cols, turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, x = sent.value
        for b in batches:
            y = np.zeros((b.num_rows, len(cols)))
            for own, starts, feature, value in _sparse(b):
                y[own] = np.add.reduceat(x[np.searchsorted(features, feature)] * value[:, None], starts)
            yield pa.RecordBatch.from_arrays([b["id"], *[pa.array(y[:, j]) for j in range(len(cols))]], ["id", *cols])
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select("id", "features", "values").mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} double" for c in cols)).transform(saved)
    sent.unpersist()
    return out


def leading_directions(entries: DataFrame, ids: DataFrame, k: int, extra: int = 8, rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """(id, embedding array<double> of ``k``) for every row of ``ids``, and the
    singular values. Rows without entries are zero; a rank below ``k`` pads with
    zeros; no rows give an empty result."""
    rows = (entries.groupBy("id").agg(F.collect_list(F.struct(F.col("feature").cast("int").alias("feature"), "value")).alias("e"))
            .select("id", F.col("e.feature").alias("features"), F.col("e.value").alias("values")))
    return _directions(rows, ids, k, extra, rounds)


def _directions(rows: DataFrame, ids: DataFrame, k: int, extra: int = 8, rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """:func:`leading_directions` of sparse rows (id, features, values)."""
    m = k + extra
    cols = [f"x{i}" for i in range(m)]
    rows = rows.transform(saved)
    entries = rows.select("id", F.explode(F.arrays_zip("features", "values")).alias("e")).select(
        "id", F.col("e.features").cast("long").alias("feature"), F.col("e.values").alias("value"))
    features = entries.select("feature").distinct().transform(saved)
    z = features.select("feature", *[(F.xxhash64("feature", F.lit(i)) / F.lit(2.0 ** 63)).alias(c) for i, c in enumerate(cols)])
    if features.count() * (m + 1) * 8 <= BLOCK_BYTES:
        n = rows.agg(F.sum(F.size("features"))).first()[0] or 0
        rows = rows.coalesce(max(1, n // TASK_ENTRIES))
        turn = np.eye(m)
        for _ in range(rounds):
            before, first = z, turn
            z, g = _there_and_back(rows, z, cols, turn)
            turn = _unit(g)
        g = turn.T @ _dots(z, cols, cols) @ turn
    else:
        for _ in range(rounds):
            q = _orthonormal(_pull(entries, z, "feature", "id", cols).transform(saved), "id", cols)
            z = _pull(entries, q, "id", "feature", cols).transform(saved)
        before, g = None, _dots(z, cols, cols)
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    singular = np.sqrt(np.maximum(values[::-1], 0.0))
    last = vectors[:, ::-1] * singular
    turned = _coordinates(rows, before, cols, first @ turn @ last) if before is not None else q.select("id", *_combined(cols, last)).transform(saved)
    kept = cols[:k]
    peaks = turned.agg(*[F.max_by(F.col(c), F.struct(F.round(F.abs(c), 12), -F.col("id"))).alias(c) for c in kept]).first()
    signed = [F.col(c) * F.lit(1.0 if (peaks[c] or 0) >= 0 else -1.0) for c in kept]
    out = turned.select("id", F.array(*signed).alias("embedding"))
    zero = F.array(*[F.lit(0.0)] * k)
    return ids.select("id").join(out, "id", "left").select("id", F.coalesce("embedding", zero).alias("embedding")), singular[:k]


def embed_wide(df: DataFrame, id_col: str, text_col: str, k: int = 32, num_features: int = 1 << 18) -> DataFrame:
    """(id, embedding) of texts over ``num_features`` hashed words; the texts are
    read once."""
    hashed = _hashed_rows(df, id_col, text_col, num_features).transform(saved)
    ids = hashed.select("id", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("id")
    return _directions(_tfidf_rows(hashed, num_features), ids, k)[0]
