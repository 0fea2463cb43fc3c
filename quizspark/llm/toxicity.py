"""Toxicity scores from a factorization machine over hashed terms.

Terms of a text are its lower-cased words and their first 4, 5 and 6 letters
(stems keep their evidence under changing endings), hashed into
``2**hash_bits`` buckets; a feature says that a bucket occurs in the text. The
score is ``sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``: besides
the additive weights, pairs of terms that are harmless apart (an insult and
the mention of a group) get a weight of their own.

1. Bucket counts per class over *all* labelled training rows: one array per
   task, summed by a Spark aggregate.
2. Screening: buckets whose log-likelihood ratio G2 against the label exceeds
   ``min_g2``, at most ``max_features`` of them by G2 (the model's size).
3. Fit (Adam, logistic loss, L2) on at most ``max_rows`` labelled rows, taken
   by hash of the id; each travels as a bit per feature and candidate.
   Pairs of terms that are flat apart are then looked for in what this model
   leaves unexplained: all pairs of the terms that occur in ``pair_share`` of
   the labelled rows (at most ``max_pair_terms``, the most frequent) get a
   score test of their common occurrence, block by block in Spark tasks. Terms
   of pairs beyond ``min_z`` (6.5 standard errors, under 0.01 false pairs
   expected of 4,096 terms; rows alike count once; at most
   ``max_pair_features`` by strength) join the model, whose factors then start
   from the leading directions of the pairs' scores. The pairs stay only if a
   fit of four fifths of the distinct rows predicts the other fifth with a
   smaller loss, and loses no more clean rows of it (or one in a thousand).
4. Scoring: the model (under 250 kB) travels in the closure; each text is read
   whole, in pieces.

Defined results: null and empty texts score ``sigmoid(w0)``; with no usable
label every score is the smoothed base rate; a document labelled more than
once counts with its highest label, null labels do not count; a repeated id
or row is scored row by row; an empty table gives an empty result. Only the
columns ``doc_id`` and ``text`` are read, so others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizspark.llm.common import bounded_batches, held_out, pieces, small_enough, text_udf

_LETTERS = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 100_000
_BLOCK = 256          # terms of a block of pairs
_BLOCK_BEST = 4096    # pairs a block reports
_STEPS = 500          # least steps of a fit, so that a small sample gets more rounds
_PAIR_STEPS = 1500    # the same with pairs


def _word_buckets(word: str, mask: int) -> tuple[int, ...]:
    h = xxhash.xxh64_intdigest
    return (h("w" + word) & mask, *[h(word[:n]) & mask for n in (4, 5, 6) if len(word) >= n])


class _Terms:
    """Text -> set of hashed buckets; remembers a bounded number of words."""

    def __init__(self, hash_bits: int, wanted: dict[int, int] | None = None):
        self.mask, self.wanted, self.cache = (1 << hash_bits) - 1, wanted, {}

    def _of(self, word: str) -> tuple[int, ...]:
        b = _word_buckets(word, self.mask)
        if self.wanted is not None:
            b = tuple(self.wanted[x] for x in b if x in self.wanted)
        if len(self.cache) >= _CACHE_WORDS:
            self.cache.clear()
        self.cache[word] = b
        return b

    def __call__(self, text: str | None) -> set[int]:
        found: set[int] = set()
        for part in pieces(text or ""):
            get = self.cache.get
            for word in set(_LETTERS.findall(part.lower())):
                b = get(word)
                if b is None:
                    b = self._of(word)
                if b:
                    found.update(b)
        return found


@dataclass
class ToxicityModel:
    hash_bits: int
    buckets: np.ndarray   # bucket of each feature
    w0: float
    w: np.ndarray         # one weight per feature
    v: np.ndarray         # features x factors

    def logits(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        pair = 0.5 * ((s * s).sum(1) - (x * x) @ (self.v * self.v).sum(1))
        return self.w0 + x @ self.w + pair

    def score_rows(self, rows: list[set[int]]) -> np.ndarray:
        out = np.empty(len(rows))
        for i, r in enumerate(rows):
            f = np.fromiter(sorted(r), dtype=np.int64, count=len(r))
            v = self.v[f]
            s = v.sum(0)
            out[i] = self.w0 + self.w[f].sum() + 0.5 * float(s @ s - (v * v).sum())
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, max_broadcast: int = 2_000_000) -> DataFrame:
    """(doc_id, text, toxic 0/1) of the labelled documents that may be learnt from."""
    y = (labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
         .where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
         .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    # under 50 MB when broadcast; beyond that, an ordinary join
    return docs.select("doc_id", "text").join(F.broadcast(y) if small_enough(y, max_broadcast) else y, "doc_id")


def _class_counts(rows: DataFrame, hash_bits: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n = _Terms(hash_bits), np.zeros((2, 1 << hash_bits), dtype=np.int64)
        docs = [0, 0]
        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist()):
                t = terms(text.as_py())
                n[y, np.fromiter(t, dtype=np.int64, count=len(t))] += 1
                docs[y] += 1
            b = text = None  # before the next batch is read
        at = np.flatnonzero(n[0] + n[1])
        yield pa.RecordBatch.from_pydict({"bucket": np.append(at, -1), "n0": np.append(n[0][at], docs[0]),
                                          "n1": np.append(n[1][at], docs[1])})

    bounded_batches(rows.sparkSession)
    per_task = rows.select("text", "toxic").mapInArrow(count, "bucket long, n0 long, n1 long")
    return per_task.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _g2(a: np.ndarray, b: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Log-likelihood ratio of a bucket (in b toxic and a clean texts)."""
    n, t = n0 + n1, a + b

    def term(o, e):
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0.0)
    return 2 * (term(b, t * n1 / n) + term(a, t * n0 / n)
                + term(n1 - b, (n - t) * n1 / n) + term(n0 - a, (n - t) * n0 / n))


def _fit(x: np.ndarray, y: np.ndarray, factors: int, epochs: int, rate: float, l2: float,
         start: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """w0, w and v; the factors begin near ``start`` where it is given."""
    rng = np.random.default_rng(11)
    n, k = x.shape
    base = (y.sum() + 0.5) / (n + 1.0)
    p = {"w0": np.array([np.log(base / (1 - base))]), "w": np.zeros(k), "v": rng.normal(0, 0.02, (k, factors))}
    if start is not None:
        p["v"] += start
    m = {a: np.zeros_like(b) for a, b in p.items()}
    s2 = {a: np.zeros_like(b) for a, b in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            pick = order[at:at + 256]
            xb = x[pick].astype(np.float64)
            s = xb @ p["v"]
            z = p["w0"][0] + xb @ p["w"] + 0.5 * ((s * s).sum(1) - xb @ (p["v"] ** 2).sum(1))
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            xe = xb.T @ e
            g = {"w0": np.array([e.sum()]), "w": xe + l2 * p["w"],
                 "v": xb.T @ (e[:, None] * s) - xe[:, None] * p["v"] + l2 * p["v"]}
            step += 1
            for a in p:
                m[a] = 0.9 * m[a] + 0.1 * g[a]
                s2[a] = 0.999 * s2[a] + 0.001 * g[a] ** 2
                p[a] = p[a] - rate * (m[a] / (1 - 0.9 ** step)) / (np.sqrt(s2[a] / (1 - 0.999 ** step)) + 1e-8)
    return float(p["w0"][0]), p["w"], p["v"]


def _bits(packed: np.ndarray, first: int, last: int) -> np.ndarray:
    """Columns ``first`` (a multiple of 8) to ``last`` of packed 0/1 rows."""
    return np.unpackbits(packed[:, first // 8:(last + 7) // 8], axis=1)[:, :last - first]


def _pair_scores(spark: SparkSession, packed: np.ndarray, terms: int, y: np.ndarray, p: np.ndarray, min_z: float) -> pd.DataFrame:
    """Pairs i < j of the first ``terms`` columns whose common occurrence has a
    score statistic z of at least ``min_z`` either way, given the scores ``p``;
    the ``_BLOCK_BEST`` strongest of each block of pairs."""
    blocks = -(-terms // _BLOCK)
    todo = blocks * (blocks + 1) // 2
    e, var = (y - p).astype(np.float32), (p * (1 - p)).astype(np.float32)
    packed = packed[:, :(terms + 7) // 8]

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [(i, j) for i in range(blocks) for j in range(i, blocks)]
        for batch in batches:
            for b in batch.column(0).to_pylist():
                i, j = (k * _BLOCK for k in at[b])
                left = _bits(packed, i, min(i + _BLOCK, terms)).astype(np.float32)
                right = _bits(packed, j, min(j + _BLOCK, terms)).astype(np.float32)
                # one is added to the variance, so that a handful of rows is no evidence
                z = (left.T @ (right * e[:, None])) / np.sqrt(left.T @ (right * var[:, None]) + 1.0)
                if i == j:
                    z = np.triu(z, 1)
                r, c = np.nonzero(np.abs(z) >= min_z)
                best = np.argsort(-np.abs(z[r, c]), kind="stable")[:_BLOCK_BEST]
                yield pa.RecordBatch.from_pydict({"i": pa.array(r[best] + i, pa.int64()), "j": pa.array(c[best] + j, pa.int64()),
                                                  "z": pa.array(z[r, c][best], pa.float64())})

    tasks = min(todo, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, todo, 1, tasks).mapInArrow(test, "i long, j long, z double").toPandas()


def _pair_start(pairs: pd.DataFrame, at: dict[int, int], features: int, factors: int) -> np.ndarray:
    """Factors whose products follow the pairs' scores: leading directions of
    the score matrix, its free diagonal raised until no direction is negative."""
    terms = sorted(set(pairs["i"]) | set(pairs["j"]))
    row = {t: k for k, t in enumerate(terms)}
    m = np.zeros((len(terms), len(terms)))
    i, j = [row[t] for t in pairs["i"]], [row[t] for t in pairs["j"]]
    m[i, j] = m[j, i] = pairs["z"] / pairs["z"].abs().max()
    value, vector = np.linalg.eigh(m)
    take = np.arange(len(terms))[::-1][:factors]
    out = np.zeros((features, factors))
    out[[at[t] for t in terms], :len(take)] = vector[:, take] * np.sqrt(np.maximum(value[take] - value[0], 0.0))
    return out


def fit(docs: DataFrame, labels: DataFrame, hash_bits: int = 18, max_features: int = 2048, min_g2: float = 24.0,
        max_rows: int = 20_000, factors: int = 8, epochs: int = 12, rate: float = 0.02, l2: float = 2e-4,
        pair_share: float = 0.01, max_pair_terms: int = 4096, min_z: float = 6.5, max_pair_features: int = 512) -> ToxicityModel:
    rows = training_rows(docs, labels)
    counts = _class_counts(rows, hash_bits)
    n = counts.where("bucket = -1").first()
    n0, n1 = (n["n0"], n["n1"]) if n else (0, 0)
    none = np.zeros(0, dtype=np.int64)
    base = np.log((n1 + 0.5) / (n0 + 0.5))
    nothing = ToxicityModel(hash_bits, none, float(base), np.zeros(0), np.zeros((0, factors)))
    if not n0 or not n1:
        return nothing
    # at most 2**hash_bits rows, the fixed size of the hash space
    c = counts.where("bucket >= 0 and n0 + n1 >= 3").toPandas().sort_values("bucket")
    bucket, seen = c["bucket"].to_numpy(np.int64), (c["n0"] + c["n1"]).to_numpy()
    g = _g2(c["n0"].to_numpy(float), c["n1"].to_numpy(float), n0, n1)
    top = np.lexsort((bucket, -g))[:max_features]
    alone = np.sort(bucket[top[g[top] >= min_g2]])
    often = np.lexsort((bucket, -seen))[:max_pair_terms]
    often = bucket[often[seen[often] >= pair_share * (n0 + n1)]]
    # columns of a sampled row: the candidates for pairs first, then the other features
    columns = np.concatenate([often, np.setdiff1d(alone, often)])
    if not len(columns):
        return nothing
    wanted = {int(b): i for i, b in enumerate(columns)}

    def features():
        terms = _Terms(hash_bits, wanted)

        def of(text: str | None) -> bytes:
            x = np.zeros(len(wanted), dtype=np.uint8)
            x[list(terms(text))] = 1
            return np.packbits(x).tobytes()
        return of

    take = (rows.select("doc_id", "toxic", "text", F.xxhash64("doc_id", "text").alias("h"))
            .join(F.broadcast(_sample_bound(rows, max_rows)), "doc_id", "left_semi"))  # max_rows ids
    sample = (take.select("doc_id", "h", "toxic", text_udf(features, "binary", pa.binary())(F.col("text").cast("string")).alias("x"))
              .orderBy("h", "doc_id").limit(max_rows).toPandas())
    packed, y = np.frombuffer(b"".join(sample["x"]), np.uint8).reshape(len(sample), -1), sample["toxic"].to_numpy(float)
    del sample

    def chosen(buckets: np.ndarray, first: int = 0, last: int = len(y)) -> np.ndarray:
        at, out = [wanted[int(b)] for b in buckets], np.empty((last - first, len(buckets)), np.uint8)
        for k in range(first, last, 1000):  # a thousand rows at a time are unpacked
            out[k - first:k - first + 1000] = _bits(packed[k:min(k + 1000, last)], 0, len(columns))[:, at]
        return out

    def rounds(steps: int) -> int:
        return max(epochs, -(-steps * 256 // len(y)))

    model = nothing
    if len(alone):
        model = ToxicityModel(hash_bits, alone, *_fit(chosen(alone), y, factors, rounds(_STEPS), rate, l2))
    left = np.full(len(y), base)
    for k in range(0, len(y) if len(alone) else 0, 1000):
        left[k:k + 1000] = np.clip(model.logits(chosen(alone, k, min(k + 1000, len(y))).astype(float)), -30, 30)
    _, one = np.unique(packed, axis=0, return_index=True)  # copies of a text are one trial
    pairs = _pair_scores(docs.sparkSession, packed[one], len(often), y[one], 1 / (1 + np.exp(-left[one])), min_z)
    own = np.isin(often, alone)  # pairs of two features have their factors already
    pairs = pairs[~(own[pairs["i"].to_numpy(int)] & own[pairs["j"].to_numpy(int)])]
    pairs = pairs.iloc[np.lexsort((pairs["j"], pairs["i"], -pairs["z"].abs()))]
    joined = dict.fromkeys(int(t) for pair in zip(pairs["i"], pairs["j"]) for t in pair)
    joined = set(list(joined)[:max_pair_features])
    pairs = pairs[pairs["i"].isin(joined) & pairs["j"].isin(joined)]
    if not len(pairs):
        return model
    buckets = np.union1d(alone, often[sorted(joined)])
    place = {t: int(np.searchsorted(buckets, often[t])) for t in joined}
    start = _pair_start(pairs, place, len(buckets), factors)
    # the pairs stay if a fit of four fifths of the distinct rows predicts the other fifth better with them
    cut = len(one) * 4 // 5
    one = np.sort(one)
    train, rest = one[:cut], one[cut:]
    losses, wrong = [], []
    for use, steps, begin in ((alone, _STEPS, None), (buckets, _PAIR_STEPS, start)):
        x = chosen(use)
        part = ToxicityModel(hash_bits, use, *_fit(x[train], y[train], factors, rounds(steps), rate, l2, begin))
        z = np.concatenate([part.logits(x[rest[k:k + 1000]].astype(float)) for k in range(0, len(rest), 1000)] or [np.zeros(0)])
        losses.append(float(np.logaddexp(0.0, np.where(y[rest] > 0, -z, z)).sum()))
        wrong.append(int(((z >= 0) & (y[rest] == 0)).sum()))
        del x
    if losses[1] >= losses[0] or wrong[1] > max(wrong[0], 0.001 * len(rest)):
        return model
    return ToxicityModel(hash_bits, buckets, *_fit(chosen(buckets), y, factors, rounds(_PAIR_STEPS), rate, l2, start))


def _sample_bound(rows: DataFrame, max_rows: int) -> DataFrame:
    """Ids of the training rows with the ``max_rows`` smallest id hashes."""
    return (rows.select("doc_id", F.xxhash64("doc_id").alias("k")).distinct()
            .orderBy("k", "doc_id").limit(max_rows).select("doc_id"))


def score(model: ToxicityModel, text: Column) -> Column:
    """Score column (0 to 1) of a text column."""
    def start():
        terms = _Terms(model.hash_bits, {int(b): i for i, b in enumerate(model.buckets)})
        return lambda t: float(model.score_rows([terms(t)])[0])
    return text_udf(start, "double", pa.float64())(text.cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, **fit_options) -> DataFrame:
    """doc_id, held_out, score, predicted (score of at least one half) per document."""
    model = fit(docs, labels, **fit_options)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
