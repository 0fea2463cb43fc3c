"""SimHash near-duplicates with pivot distance tables.

Fingerprint: lower-case A-Z, words are runs of anything but ASCII white space,
shingles of ``shingle_words`` words joined by a space (a shorter text is one
shingle), XXH64 with seed 42 of each shingle, repeats included; a bit is set
if it is set in over half of the hashes. A text without words has zero.

Links join fingerprints at ``max_bits`` or fewer differing bits. Distinct
fingerprints only are compared (copies collapse in a map-side combined
aggregate), through distances to reference fingerprints ("pivots"):

* cell pivots: the zero fingerprint and masks of two neighbouring bits. The
  difference d(f, 0) - d(f, mask) is fixed by the bits under the mask, and the
  masks are disjoint, so two fingerprints within r bits differ in at most r of
  these coordinates. The coordinates are dealt into r + 3 groups; at least 3
  groups agree entirely, hence one of the C(r + 3, 3) tables keyed by three
  groups' coordinates brings every such pair together.
* filter pivots: sixteen more references. By the triangle inequality a pair
  whose distances to any of them differ by over r is discarded.
* Survivors are verified on the exact Hamming distance.

Cells with more than ``max_cell`` members (dense clouds of near copies) are
not paired up. Their members are linked exactly in another way: two
fingerprints differ in at most 2 bits if and only if the sets of points within
one bit of each meet, so each member is linked to the least member at each of
its 65 points. (For another radius r: points within ceil(r / 2) bits of one and
floor(r / 2) of the other.)

Defined results: null texts have fingerprint zero as empty ones do and link
with each other; repeated rows and ids keep one row each; a null doc_id takes
part, and the component id is the smallest id that is not null (null if there
is none); an empty table gives an empty result. Only ``doc_id`` and ``text``
are read, so other columns may have any name.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizspark.llm.common import fresh, pieces, shared_table, text_udf
from quizspark.llm.graph import components

_XX = partial(xxhash.xxh64_intdigest, seed=42)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_SHIFT = (np.arange(8) * 256)[None, :]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, bit 0 first."""
    by = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    seen = np.bincount((by + _SHIFT).ravel(), minlength=2048).reshape(8, 256)
    return (seen @ _BITS).ravel()


def majority(counts: np.ndarray, total: int) -> int:
    """The 64-bit number whose bits are set in over half."""
    on = (2 * counts > total).astype(np.uint8)
    return int.from_bytes(np.packbits(on, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text, read piece by piece."""
    counts, total, carry = np.zeros(64, dtype=np.int64), 0, []
    for part in pieces(text or ""):
        words = carry + part.encode("utf-8", "surrogatepass").lower().split()
        n = len(words) - shingle_words + 1
        if n > 0:
            if shingle_words == 1:
                grams = words
            else:
                grams = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
            counts += bit_counts(np.fromiter(map(_XX, grams), dtype=np.uint64, count=n))
            total += n
            carry = words[n:]
        else:
            carry = words
    if not total and carry:
        counts, total = bit_counts(np.array([_XX(b" ".join(carry))], dtype=np.uint64)), 1
    return majority(counts, total)


def fingerprint_column(text: Column, shingle_words: int = 3) -> Column:
    """Fingerprint as a signed long."""
    return text_udf(lambda: lambda t: _signed(fingerprint(t, shingle_words)), "long", pa.int64())(text.cast("string"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot)).cast("long")))


#: Filter pivots: hashes of their numbers.
_FILTERS = [xxhash.xxh64_intdigest(f"pivot {i}") for i in range(16)]


def pivot_tables(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, near0, near1, cell): a row per table for each fingerprint; near0 and
    near1 hold its sixteen filter distances, a byte each."""
    masks = [3 << i for i in range(0, 64, 2)]
    groups = [list(range(g, len(masks), max_bits + 3)) for g in range(max_bits + 3)]
    zero = _distance(F.col("fp"), 0)
    coords = fps.select("fp", *[
        sum((F.shiftleft(_distance(F.col("fp"), p).cast("long"), 8 * i) for i, p in enumerate(part)), F.lit(0).cast("long")).alias(f"near{k}")
        for k, part in enumerate((_FILTERS[:8], _FILTERS[8:]))],
        F.array(*[(zero - _distance(F.col("fp"), m)).cast("byte") for m in masks]).alias("c"))
    cells = [F.xxhash64(F.lit(t), *[F.col("c")[i] for g in chosen for i in groups[g]])
             for t, chosen in enumerate(combinations(range(len(groups)), 3))]
    return coords.select("fp", "near0", "near1", F.explode(F.array(*cells)).alias("cell"))


def _ball(fp: Column, bits: int) -> Column:
    """All numbers within ``bits`` of fp (itself included)."""
    flips = [0]
    for b in range(1, bits + 1):
        flips += [sum(1 << i for i in c) for c in combinations(range(64), b)]
    return F.transform(F.array(*[F.lit(_signed(x)).cast("long") for x in flips]), lambda m: fp.bitwiseXOR(m))


def _meeting_points(fps: DataFrame, max_bits: int) -> DataFrame:
    """Exact links through shared points, linear in the number of members."""
    far = fps.select("fp", F.explode(_ball(F.col("fp"), (max_bits + 1) // 2)).alias("point"))
    if max_bits % 2 == 0:
        least = far.groupBy("point").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        return far.join(least, "point").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct()
    # odd radius: one side's small ball against the other's large ball, the
    # least member of the large ball at the point stands for it
    near = fps.select(F.col("fp").alias("g"), F.explode(_ball(F.col("fp"), max_bits // 2)).alias("point"))
    return near.join(far, "point").where("g <> fp").select(F.col("g").alias("a"), F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, max_bits: int = 2, max_cell: int = 128) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints which chains of
    pairs within ``max_bits`` connect. ``fps`` has distinct values in ``fp``."""
    cells = pivot_tables(fps, max_bits)
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = shared_table(cells.join(sizes, "cell"))
    a = crowded.where(F.col("n") <= max_cell)
    b = a.select(F.col("cell"), F.col("fp").alias("g"), F.col("near0").alias("other0"), F.col("near1").alias("other1"))

    def byte(c: str, i: int) -> Column:
        return F.shiftright(F.col(c), 8 * i).bitwiseAND(F.lit(255))
    gap = F.greatest(*[F.abs(byte(f"near{k}", i) - byte(f"other{k}", i)) for k in (0, 1) for i in range(8)])
    paired = a.join(b, (a["cell"] == b["cell"]) & (F.col("fp") < F.col("g")) & (gap <= max_bits)
                    & (F.bit_count(F.col("fp").bitwiseXOR(F.col("g"))) <= max_bits))
    dense = crowded.where(F.col("n") > max_cell).select("fp").distinct()
    return paired.select(F.col("fp").alias("a"), F.col("g").alias("b")).union(_meeting_points(dense, max_bits)).distinct()


def simhash_components(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, and ``fp``/``root`` as
    signed longs (the component's least fingerprint), a row per document."""
    rows = shared_table(docs.select(F.col("doc_id"), fingerprint_column(F.col("text"), shingle_words).alias("fp")))
    # null ids: the least of all non-null ids in the component
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = components(links(fps.select("fp"), max_bits))
    joined = shared_table(fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
                          .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = joined.select("fp", "root").join(ids, "root")
    return rows.join(of, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp", "root")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """One document of each component, with all its columns: the one with the
    smallest id (a null id last; equal ids: by hash of the whole row)."""
    row = fresh(docs, "row_hash")
    same = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    # ids and hashes only; the texts are not written a second time
    rows = shared_table(docs.select(F.col("doc_id").alias("d"), fingerprint_column(F.col("text"), shingle_words).alias("fp"), same.alias("h")))
    comp = components(links(rows.select("fp").distinct(), max_bits)).withColumnRenamed("node", "fp")
    order = F.struct(F.col("d").isNull().alias("n"), F.col("d"), F.col("h"))
    best = (rows.groupBy("fp").agg(F.min(order).alias("best")).join(comp, "fp", "left")
            .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best")).select("best.d", "best.h"))
    pick = shared_table(rows.groupBy("d", "h").agg(F.count(F.lit(1)).alias("times"))
                        .join(best.withColumnsRenamed({"d": "d1", "h": "h1"}), F.col("d").eqNullSafe(F.col("d1")) & (F.col("h") == F.col("h1")), "left_semi"))
    hashed, d, h = docs.withColumn(row, same), fresh(docs, "picked_id"), fresh(docs, "picked_hash")
    pick = pick.withColumnsRenamed({"d": d, "h": h})
    on = hashed["doc_id"].eqNullSafe(F.col(d)) & (F.col(row) == F.col(h))
    once = hashed.join(pick.where("times = 1"), on, "left_semi")
    # rows that stand several times, alike in every column: one of them
    more = hashed.join(pick.where("times > 1"), on, "left_semi").dropDuplicates(["doc_id", row])
    return once.unionByName(more).select(*[F.col(f"`{c}`") for c in docs.columns])
