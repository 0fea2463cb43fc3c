"""Document fingerprints by consistent weighted sampling.

A text's terms are its shingles of ``SHINGLE_WORDS`` words (a shorter text is
one term), weighted by how often they stand in it. A word of over ``LONG_WORD``
characters counts as its overlapping pieces of ``PIECE`` characters, so that
texts without white space have terms too. For each of ``SAMPLES`` samples every
term draws, from its hash alone, r and c from Gamma(2, 1) and b from [0, 1);
with weight w it stands at t = floor(ln w / r + b), and the sample is the (term,
t) with the least ln c - r (t - b + 1). Two texts agree in a sample with
probability sum of min(w) / sum of max(w), the generalised Jaccard similarity,
so the share of samples in which two fingerprints agree estimates it with a
deviation of at most 0.5 / sqrt(``SAMPLES``). A sample is kept as 16 bits.

A document is compared with its edited text, whose last quarter is the
beginning of the next document by ``doc_id``. Documents are dealt into ranges of
(doc_id, hash of the text) whose bounds come from a table of keys; the first
document of a range goes to the range before as a guest too (the first of all
to the last), so each range is read as a stream and texts are shuffled once.
Rows alike in id and text that would fill a good part of a range are sent once a
task and dealt out again by their number.

Defined results: null texts count as empty; a text without words has no terms,
and its samples are all zero, so that two such texts are alike; null ids come
first, equal ids by the hash of their texts; the next of an only document is
itself; an empty table gives an empty result. Only ``doc_id`` and ``text`` are
read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizspark.llm.common import bounded_batches, shared_table
from quizspark.llm.perfect_hash import mix

SHINGLE_WORDS = 2
SAMPLES = 64
LONG_WORD = 24
PIECE = 8
CHUNK_TERMS = 512
OUT_ROWS = 500

_HALF = (np.arange(1 << 16) + 0.5) / (1 << 16)
#: -ln u of 16-bit uniforms; two of them add up to a Gamma(2, 1) number.
_LOG = (-np.log(_HALF)).astype(np.float32)
#: 1 - b of 16-bit uniforms.
_REST = 1 - (np.arange(1 << 16).astype(np.uint16) + np.float32(0.5)) * np.float32(1 / (1 << 16))


def _gamma_quantiles() -> np.ndarray:
    """Gamma(2, 1) at 65,536 even probabilities: 1 - (1 + x) exp(-x) inverted by
    bisection."""
    low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        under = 1 - (1 + x) * np.exp(-x) < _HALF
        low, high = np.where(under, x, low), np.where(under, high, x)
    return ((low + high) / 2).astype(np.float32)


_GAMMA = _gamma_quantiles()
_LOW = np.uint64(0xFFFF)
_STEP = mix(np.arange(SAMPLES, dtype=np.uint64), 7)


def _draws(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, 1 - b, ln c), a row per term and a column per sample."""
    h = mix(terms[:, None] ^ _STEP[None, :], 0)
    parts = h.view(np.uint16).reshape(*h.shape, 4)
    r = _GAMMA[parts[..., 0]]
    log_c = _LOG[parts[..., 2]]
    log_c += _LOG[parts[..., 3]]
    return r, _REST[parts[..., 1]], np.log(log_c, out=log_c)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, long ones as overlapping pieces."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not any(len(w) > LONG_WORD for w in words):
        return words
    out: list[bytes] = []
    for w in words:
        s = w.decode("utf-8", "surrogatepass") if len(w) > LONG_WORD else ""
        if len(s) > LONG_WORD:
            out.extend(s[i:i + PIECE].encode("utf-8", "surrogatepass") for i in range(len(s) - PIECE + 1))
        else:
            out.append(w)
    return out


def _hashes(words: list[bytes]) -> np.ndarray:
    """Hash of every shingle of ``SHINGLE_WORDS`` words."""
    n = max(0, len(words) - SHINGLE_WORDS + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS))))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), dtype=np.uint64, count=n)


def _terms(words: list[bytes]) -> np.ndarray:
    if 0 < len(words) < SHINGLE_WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    return _hashes(words)


def term_hashes(text: str) -> np.ndarray:
    """Hash of every term, repeats included."""
    return _terms(words_of(text))


def edited_hashes(text: str, new: str, head: int) -> list[np.ndarray]:
    """Term hashes of ``text`` and of ``new``, which has the same first ``head``
    characters: the terms of the whole words among these are hashed once."""
    at = max(map(text.rfind, " \n\t\r\v\f", [0] * 6, [head] * 6))
    whole = words_of(text[:at]) if at > 0 else []
    if len(whole) < SHINGLE_WORDS:
        return [term_hashes(text), term_hashes(new)]
    start, last = _hashes(whole), whole[1 - SHINGLE_WORDS:]
    return [np.concatenate([start, _hashes(last + words_of(t[at:]))]) for t in (text, new)]


def signatures(texts: list[str]) -> np.ndarray:
    """A row of samples (uint16) per text; draws that several texts need are
    made once."""
    return hashed_signatures([term_hashes(t) for t in texts])


def hashed_signatures(hashed: list[np.ndarray]) -> np.ndarray:
    """``signatures`` of the texts whose term hashes these are."""
    terms, at = np.unique(np.concatenate(hashed), return_inverse=True)
    out = np.zeros((len(hashed), SAMPLES), np.uint16)
    if not len(terms):
        return out
    cuts = np.cumsum([0] + [len(h) for h in hashed])
    weights = np.stack([np.bincount(at[s:e], minlength=len(terms)) for s, e in zip(cuts, cuts[1:])])
    least = np.full((len(hashed), SAMPLES), np.inf, np.float32)
    column = np.arange(SAMPLES)
    for s in range(0, len(terms), CHUNK_TERMS):
        part = terms[s:s + CHUNK_TERMS]
        r, rest, log_c = _draws(part)
        once = r * rest
        np.subtract(log_c, once, out=once)  # weight 1: t = 0
        for i, w in enumerate(weights[:, s:s + CHUNK_TERMS]):
            held, many = np.flatnonzero(w), np.flatnonzero(w > 1)
            if not len(held):
                continue
            value, t = once, None
            if len(many):
                t = np.floor(np.log(w[many])[:, None].astype(np.float32) / r[many] + (1 - rest[many]))
                value = once.copy()
                value[many] -= r[many] * t
            if len(held) < len(part):
                value = value[held]
            row = value.argmin(axis=0)
            best = value[row, column]
            better = best < least[i]
            if better.any():
                row = held[row[better]]
                level = np.zeros(len(row), np.uint64)
                if t is not None:
                    place = np.searchsorted(many, row)
                    hit = (place < len(many)) & (many[np.minimum(place, len(many) - 1)] == row)
                    level[hit] = t[place[hit], column[better][hit]].astype(np.uint64)
                least[i, better] = best[better]
                out[i, better] = (mix(part[row] + level, 3) & _LOW).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / SAMPLES


def written(signature: np.ndarray) -> str:
    """Four hex digits a sample."""
    return signature.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` whose last quarter is the first as many code points of the next."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


# --- neighbours by id ------------------------------------------------------------

def _key(doc_id, h) -> tuple:
    return (doc_id is not None, doc_id if doc_id is not None else 0, h)


def _ranges(keys: DataFrame, n: int) -> list[tuple]:
    """First key of each range, in order; at most ``n`` rows reach the driver."""
    ranged = keys.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h")
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h")).alias("k")
    rows = ranged.groupBy(F.spark_partition_id().alias("p")).agg(first).select("k.*").collect()
    return sorted(_key(r["doc_id"], r["h"]) for r in rows)


def _deal(docs: DataFrame, starts: list[tuple], hot: dict[tuple, int]) -> DataFrame:
    """doc_id, h, text and ``code`` = 2 * range, or 2 * range + 1 for a guest."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((starts, set(hot)))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        first, often = sent.value
        heads = {k: (i - 1) % len(first) for i, k in enumerate(first)}
        seen = set()
        for ids, hashes in batches:
            out = []
            for k in map(_key, ids.to_pylist(), hashes.to_pylist()):
                if k in often:
                    if k in seen:
                        out.append([])
                        continue
                    seen.add(k)
                at = [2 * (bisect_right(first, k) - 1)]
                if k in heads:
                    at.append(2 * heads[k] + 1)
                out.append(at)
            yield pa.array(out, pa.list_(pa.int32()))
    place = F.arrow_udf(run, "array<int>")
    return docs.select("doc_id", "text", "h", F.explode(place("doc_id", "h")).alias("code"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        code, doc_id, h, text = (batch.column(i) for i in range(4))
        for c, d, x, t in zip(code.to_pylist(), doc_id.to_pylist(), h.to_pylist(), text):
            yield c // 2, c % 2, d, x, t.as_py()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited (likeness to the edited text) and near_next (to the next document)."""
    from pyspark.sql.pandas.types import to_arrow_type
    spark = docs.sparkSession
    bounded_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = shared_table(d.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")))
    starts = _ranges(keys.select("doc_id", "h"), n)
    total = keys.agg(F.sum("n")).first()[0] or 0
    # alike rows that would fill a quarter of a range: at most 4 n of them
    hot = {_key(r["doc_id"], r["h"]): r["n"] for r in keys.where(F.col("n") > max(100, total / n / 4)).collect()}
    times = spark.sparkContext.broadcast(hot)

    def row(doc_id, text: str, following: str) -> tuple[tuple, np.ndarray]:
        """(all but near_next, signature); the draws serve both texts."""
        new = edited(text, following)
        sig, new_sig = hashed_signatures(edited_hashes(text, new, len(text) - len(text) // 4))
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc_id, len(text), sha, written(sig), written(new_sig), likeness(sig, new_sig)), sig

    def found(batches):
        last = None  # (range, doc_id, key, text): the document whose next is not read yet
        wait = None  # (row, signature) of the one before it, for near_next
        for at, guest, doc_id, h, text in _documents(batches):
            key = _key(doc_id, h)
            if not last or last[0] != at:
                last, wait = None if guest else (at, doc_id, key, text), None
                continue
            if not guest and key == last[2] and key in times.value:
                continue  # the same row from another task
            made, sig = row(last[1], last[3], text)
            if wait:
                yield (*wait[0], likeness(wait[1], sig), 1)
            if last[2] in times.value:  # its copies: each but the last is followed by a copy
                yield (*row(last[1], last[3], last[3])[0], 1.0, times.value[last[2]] - 1)
            if guest:
                yield (*made, likeness(sig, signatures([text])[0]), 1)
                last = wait = None
            else:
                last, wait = (at, doc_id, key, text), (made, sig)

    columns = [("n_chars", "long", pa.int64()), ("edited_sha256", "string", pa.string()), ("fingerprint", "string", pa.string()),
               ("edited_fingerprint", "string", pa.string()), ("near_edited", "double", pa.float64()), ("near_next", "double", pa.float64()),
               ("copies", "long", pa.int64())]
    id_type = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), *[(c, t) for c, _, t in columns]])

    def run(batches):
        held = []
        for r in found(batches):
            held.append(r)
            if len(held) >= OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    order = ["range", F.col("code") % 2, F.col("doc_id").asc_nulls_first(), "h"]
    dealt = (_deal(d, starts, hot).withColumn("range", F.floor(F.col("code") / 2).cast("int")).repartition(n, "range")
             .sortWithinPartitions(*order).select("code", "doc_id", "h", "text"))
    rows = dealt.mapInArrow(run, f"doc_id {id_type.simpleString()}, " + ", ".join(f"{c} {t}" for c, t, _ in columns))
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
