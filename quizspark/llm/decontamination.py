"""Benchmark decontamination with SimHash over item-sized windows.

Words are lower-cased runs of letters, digits and underscores; shingles have
five words (fewer where an item is shorter: then the item is one shingle).

1. Windows: a document is read through windows of exactly as many words as an
   item has, at every word; a text with fewer words than an item is one window for
   that item's length, the whole text. A window whose weighted shingle similarity (sum of
   minima over sum of maxima of the shingle counts) to an item reaches s must
   share at least 2 s / (1 + s) of its shingles with items of that length (for a
   whole text: s / (1 + s) of its own and the item's shingles together); windows
   with fewer such shingles can match nothing and get no fingerprint. The count
   uses hashes of the benchmark's shingles, so it can only let through too many.
2. Fingerprints: 64-bit SimHash of the window's shingles, each weighted by its
   count, and of each item's.
3. Candidates: multi-index Hamming blocks. The 64 bits are cut into ten blocks;
   two fingerprints within ``RADIUS`` = 19 bits agree in some block up to one
   bit. Items are indexed under each block's value and its one-bit neighbours,
   windows look up their own ten values (with the item's length): a join that finds
   all fingerprints within the radius, then the exact distance.
4. Verification: exact weighted shingle similarity of at least ``similarity``.

At similarity 0.8 the fingerprints differ in 9.7 bits on average (standard
deviation 2.9), so the radius lies over three deviations beyond the limit.

Equal windows of different documents are fingerprinted and compared once.
The benchmark is worked through in blocks of at most ``block_words`` words, so
what is broadcast has a fixed bound at any benchmark size.

Defined results: null or empty texts and items match nothing; repeated
documents match row by row under their id; an item that stands twice in the
benchmark matches under each id; empty tables give an empty result; only
``doc_id``, ``text`` and ``item_id``, ``text`` are read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizspark.llm.common import fresh, pieces, shared_table, small_enough, text_udf
from quizspark.llm.simhash import bit_counts, majority

SHINGLE = 5
_WORD = re.compile(r"\w+")
#: Widths of the blocks, 64 bits together.
_WIDTHS = (7, 7, 7, 7, 6, 6, 6, 6, 6, 6)
RADIUS = 2 * len(_WIDTHS) - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str]) -> list[str]:
    k = min(SHINGLE, len(words))
    return [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if words else []


def window_fingerprint(words: list[str]) -> int:
    s = shingles(words)
    h = np.fromiter((xxhash.xxh64_intdigest(x, seed=42) for x in s), dtype=np.uint64, count=len(s))
    x = majority(bit_counts(h), len(s))
    return x - (1 << 64) if x >> 63 else x


def weighted_similarity(a: list[str], b: list[str]) -> float:
    x, y = Counter(shingles(a)), Counter(shingles(b))
    top = sum((x | y).values())
    return sum((x & y).values()) / top if top else 0.0


def _codes(ids: np.ndarray, k: int) -> np.ndarray:
    """One number for each run of k word numbers."""
    h = np.zeros(len(ids) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = (h + ids[i:len(ids) - k + 1 + i].astype(np.uint64)) * _STEP
        h ^= h >> np.uint64(31)
    return h


class _Items:
    """What a worker needs of a block of items: word numbers, and for every
    shingle length k the sorted codes with the item lengths they occur at."""

    def __init__(self, texts: list[str], similarity: float):
        self.vocabulary: dict[str, int] = {}
        self.share = similarity / (1 + similarity)  # of the shingles of both together
        found: dict[int, set[tuple[int, int]]] = {}
        self.longest = 0
        for t in texts:
            words = words_of(t)
            if words:
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int64)
                k, self.longest = min(SHINGLE, len(ids)), max(self.longest, len(ids))
                found.setdefault(k, set()).update((int(c), len(ids)) for c in _codes(ids, k))
        self.codes, self.lengths = {}, {}
        for k, pairs in found.items():
            of: dict[int, list[int]] = {}
            for c, n in sorted(pairs):
                of.setdefault(c, []).append(n)
            self.codes[k] = np.array(sorted(of), dtype=np.uint64)
            self.lengths[k] = [of[c] for c in sorted(of)]

    def _places(self, ids: np.ndarray, k: int, codes: np.ndarray) -> dict[int, list[int]]:
        """By item length, where shingles of items of that length start."""
        places: dict[int, list[int]] = {}
        if len(ids) < k:
            return places
        known = np.lib.stride_tricks.sliding_window_view(ids > 0, k).all(1)
        at = np.flatnonzero(known)
        if not len(at):
            return places
        c = _codes(ids, k)[at]
        slot = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
        ok = codes[slot] == c
        for p, s in zip(at[ok].tolist(), slot[ok].tolist()):
            for n in self.lengths[k][s]:
                places.setdefault(n, []).append(p)
        return places

    def windows(self, text: str | None) -> set[tuple[int, str]]:
        """Distinct (item length, window) that may match, words joined by a space:
        item-sized windows, and a whole text that is shorter than the item."""
        out: set[tuple[int, str]] = set()
        carry: list[str] = []
        whole = True  # as long as carry holds all words read
        for part in pieces(text or ""):
            words = carry + _WORD.findall(part.lower())
            ids = self._numbers(words)
            for k, codes in self.codes.items():
                for n, ps in self._places(ids, k, codes).items():
                    need = self._least(n - k + 1, n - k + 1)
                    starts: set[int] = set()
                    for i in range(len(ps) - need + 1):
                        # windows that hold the places i .. i + need - 1
                        starts.update(range(max(0, ps[i + need - 1] + k - n), min(ps[i], len(words) - n) + 1))
                    out.update((n, " ".join(words[s:s + n])) for s in starts)
            whole = whole and len(words) < self.longest
            carry = words[max(0, len(words) - self.longest + 1):] if self.longest > 1 else []
        # with fewer words than a shingle of the item, nothing is in common
        if whole and len(carry) >= SHINGLE and SHINGLE in self.codes:
            k, m = SHINGLE, len(carry)
            for n, ps in self._places(self._numbers(carry), k, self.codes[k]).items():
                if n > m and len(ps) >= self._least(m - k + 1, n - k + 1):
                    out.add((n, " ".join(carry)))
        return out

    def _numbers(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))

    def _least(self, a: int, b: int) -> int:
        """Fewest common shingles of two texts with a and b shingles that match."""
        return max(1, int(np.ceil((a + b) * self.share - 1e-9)))


def _blocks(fp: Column) -> list[Column]:
    out, at = [], 0
    for width in _WIDTHS:
        out.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int"))
        at += width
    return out


def _index(items: DataFrame) -> DataFrame:
    """(n, block, value, item_text, item_fp): every item under its block values
    and those one bit away."""
    keys = [F.struct(F.lit(j).alias("block"), value.bitwiseXOR(F.lit(flip)).alias("value"))
            for j, (width, value) in enumerate(zip(_WIDTHS, _blocks(F.col("item_fp"))))
            for flip in [0, *(1 << b for b in range(width))]]
    return items.select("n", "item_text", "item_fp", F.explode(F.array(*keys)).alias("key")).select("n", "key.*", "item_text", "item_fp")


def _with_fingerprint(texts: DataFrame, text: str, name: str) -> DataFrame:
    return texts.withColumn(name, text_udf(lambda: lambda t: window_fingerprint(t.split(" ")), "long", pa.int64())(F.col(text)))


def _match_block(docs: DataFrame, texts: list[str], similarity: float) -> DataFrame:
    """(doc_id, window, item_text, similarity, distance) against some normalised item texts."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(_Items(texts, similarity))

    def cut():
        items = sent.value
        return lambda t: [{"n": n, "window": w} for n, w in sorted(items.windows(t))]
    pair = pa.list_(pa.struct([("n", pa.int32()), ("window", pa.string())]))
    found = docs.select("doc_id", text_udf(cut, "array<struct<n:int,window:string>>", pair)(F.col("text").cast("string")).alias("w"))
    found = shared_table(found.where(F.size("w") > 0).select("doc_id", F.inline("w")))

    n = lambda c: F.size(F.split(c, " "))
    items = spark.createDataFrame([(t,) for t in texts], "item_text string")
    items = _with_fingerprint(items, "item_text", "item_fp").withColumn("n", n("item_text"))
    windows = _with_fingerprint(found.select("n", "window").distinct(), "window", "fp")
    probes = windows.select("window", "fp", "n", F.posexplode(F.array(*_blocks(F.col("fp")))).alias("block", "value"))
    pairs = (probes.join(_index(items), ["n", "block", "value"])
             .withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).where(F.col("distance") <= RADIUS)
             .select("n", "window", "item_text", "distance").distinct())

    def verify(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([weighted_similarity(x.as_py().split(" "), y.as_py().split(" ")) for x, y in zip(a, b)], pa.float64())
    close = pairs.withColumn("similarity", F.arrow_udf(verify, "double")("window", "item_text")).where(F.col("similarity") >= similarity)
    return found.join(close, ["n", "window"]).select("doc_id", "window", "item_text", "similarity", "distance")


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block_words: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, similarity (of the best window), distance (in bits, least)
    and n_windows, for every document and item of which a window matches."""
    items = shared_table(benchmark.select("item_id", _normalised(F.col("text")).alias("item_text")).where("item_text <> ''"))
    each = shared_table(items.select("item_text", F.size(F.split("item_text", " ")).alias("n")).distinct())
    words = each.agg(F.sum("n")).first()[0] or 0
    blocks = -(-int(words) // block_words)
    part = F.pmod(F.xxhash64("item_text"), F.lit(max(1, 2 * blocks if blocks > 1 else 1)))
    out = None
    for b in range(2 * blocks if blocks > 1 else blocks):
        texts = [r["item_text"] for r in each.where(part == b).select("item_text").collect()]  # about block_words / 2 words
        if texts:
            found = _match_block(docs, sorted(texts), similarity)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.select("doc_id", F.lit("").alias("window"), F.lit("").alias("item_text"), F.lit(0.0).alias("similarity"), F.lit(0).alias("distance")).limit(0)
    return (out.join(items, "item_text").groupBy("doc_id", "item_id")
            .agg(F.max("similarity").alias("similarity"), F.min("distance").cast("int").alias("distance"), F.count(F.lit(1)).alias("n_windows")))


def _normalised(text: Column) -> Column:
    return text_udf(lambda: lambda t: " ".join(words_of(t)), "string", pa.string())(text.cast("string"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, broadcast_rows: int = 500_000) -> DataFrame:
    """Documents in which no window matches an item, with all their columns.
    The verdict hangs on the text alone, so it is carried by the text's md5."""
    key = fresh(docs, "text_md5")
    md5 = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    found = benchmark_matches(docs.select(md5.alias("doc_id"), "text"), benchmark, similarity)
    hit = shared_table(found.select(F.col("doc_id").alias(key)).distinct())
    hit = F.broadcast(hit) if small_enough(hit, broadcast_rows) else hit
    return docs.withColumn(key, md5).join(hit, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
