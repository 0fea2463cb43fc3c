"""Language identification with string kernels.

Kernel: two texts share the blended spectrum - letter n-grams of length 1 to
``max_n``, words set off by a space - and presence counts, not frequency: the
number of hashed n-grams present in both, divided by the root of the numbers
present in each. Nyström: ``landmarks`` training texts stand for the whole
feature space; with K the kernel among them, a text's features are its kernel
values against the landmarks times K^(-1/2). One-versus-rest ridge regression
on these features gives one score per language. Texts are scored in batches: a
presence matrix times the landmark matrix, times the folded weights.

The fit uses a bounded sample, ``per_language`` training documents of each of
at most ``max_languages`` languages (the most frequent first), by hash of the
id; each travels as ``2**hash_bits / 8`` bytes. Prediction reads whole texts.

Defined results: a text that is null or has no letter is ``und`` with score 0;
so is every text if nothing can be learnt; repeated rows are predicted row by
row; an empty table gives an empty result; only ``doc_id``, ``text`` and, to
learn, ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizspark.llm.common import held_out, pieces

UNDETERMINED = "und"
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> code point of its lower-case letter, or a space."""
    if not _TABLE:
        t = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x30000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(t)
    return _TABLE[0]


def presence(text: str | None, hash_bits: int, max_n: int) -> np.ndarray | None:
    """Boolean vector of the hashed n-grams of a whole text; None without letters."""
    out, table, any_letter = np.zeros(1 << hash_bits, dtype=bool), _letters(), False
    for part in pieces(text or ""):
        c = table[np.frombuffer((" " + part + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        keep = np.ones(len(c), dtype=bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32)   # runs of spaces to one
        c = c[keep].astype(np.uint64)
        if not (c != 32).any():
            continue
        any_letter = True
        h = np.zeros(len(c), dtype=np.uint64)
        for n in range(1, max_n + 1):
            if len(c) < n:
                break
            h = h[:len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1:] + np.uint64(n)
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out[mixed >> np.uint64(64 - hash_bits)] = True
    return out if any_letter else None


@dataclass
class LanguageModel:
    hash_bits: int
    max_n: int
    languages: list[str]
    landmarks: np.ndarray   # landmarks x buckets, 0/1, each divided by the root of its count
    weights: np.ndarray     # (landmarks + 1) x languages, the inverse root folded in

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return langs, scores
        for at in range(0, len(texts), 256):   # bounded batches
            rows, x = [], np.zeros((min(256, len(texts) - at), 1 << self.hash_bits), dtype=np.float32)
            for i, t in enumerate(texts[at:at + 256]):
                p = presence(t, self.hash_bits, self.max_n)
                if p is not None:
                    x[len(rows)] = p
                    x[len(rows)] /= np.sqrt(p.sum())
                    rows.append(at + i)
            k = x[:len(rows)] @ self.landmarks.T
            s = k @ self.weights[:-1] + self.weights[-1]
            e = np.exp(4.0 * (s - s.max(1, keepdims=True))) if len(rows) else s
            best = s.argmax(1) if len(rows) else []
            for r, b, ex in zip(rows, best, e):
                langs[r], scores[r] = self.languages[b], float(ex[b] / ex.sum())
        return langs, scores


def _sample(docs: DataFrame, per_language: int, max_languages: int) -> DataFrame:
    """At most about ``per_language`` rows of a language: those whose id hash
    falls under the share that this number is of the language's rows."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    counts = (rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), "lang").limit(max_languages))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(F.broadcast(counts), "lang").where(h < F.lit(float(per_language)) / F.col("n"))  # max_languages rows


def fit(docs: DataFrame, hash_bits: int = 13, max_n: int = 4, per_language: int = 800, max_languages: int = 200,
        landmarks: int = 256, ridge: float = 1.0) -> LanguageModel:
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            ps = [presence(t, hash_bits, max_n) for t in s]
            yield pd.Series([None if p is None else np.packbits(p).tobytes() for p in ps], dtype=object)

    found = (_sample(docs, per_language, max_languages)
             .select("doc_id", "lang", F.xxhash64("doc_id", "text").alias("h"), F.pandas_udf(vectors, "binary")("text").alias("x"))
             .where(F.col("x").isNotNull()).orderBy("h", "doc_id", "lang").limit(2 * per_language * max_languages).toPandas())
    nothing = LanguageModel(hash_bits, max_n, [], np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    if not len(found):
        return nothing
    languages = sorted(found["lang"].unique())
    y = found["lang"].map({a: i for i, a in enumerate(languages)}).to_numpy()
    turn = found.groupby("lang").cumcount().to_numpy()       # landmarks in turn from each language
    chosen = np.lexsort((y, turn))[:landmarks]

    def rows(at: np.ndarray) -> np.ndarray:
        x = np.unpackbits(np.frombuffer(b"".join(found["x"].iloc[at]), np.uint8).reshape(len(at), -1), axis=1).astype(np.float32)
        return x / np.sqrt(x.sum(1, keepdims=True))

    marks = rows(chosen)
    val, vec = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    ok = val > 1e-6 * val.max()
    root = vec[:, ok] / np.sqrt(val[ok])
    m = root.shape[1]
    gram, cross = np.zeros((m + 1, m + 1)), np.zeros((m + 1, len(languages)))
    for at in range(0, len(found), 1024):
        pick = np.arange(at, min(at + 1024, len(found)))
        phi = np.hstack([(rows(pick) @ marks.T).astype(np.float64) @ root, np.ones((len(pick), 1))])
        target = np.where(y[pick][:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
        gram += phi.T @ phi
        cross += phi.T @ target
    penalty = np.eye(m + 1) * ridge
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(gram + penalty, cross)
    return LanguageModel(hash_bits, max_n, languages, marks, np.vstack([root @ beta[:-1], beta[-1:]]).astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score per document. The model (landmarks as
    bits, under a megabyte) is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(
        (model.hash_bits, model.max_n, model.languages, np.packbits(model.landmarks > 0, axis=1), model.weights))

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bits, n, languages, packed, weights = sent.value
        marks = np.unpackbits(packed, axis=1).astype(np.float32)
        marks /= np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))
        m = LanguageModel(bits, n, languages, marks, weights)
        for s in texts:
            langs, scores = m.predict(list(s))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})
    out = F.pandas_udf(run, "lang_pred string, score double")(F.col("text").cast("string"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), out.alias("p")).select("doc_id", "held_out", "p.*")
