"""Mixing sources to target weights along a time-varying curriculum.

Targets: the mix has ``total_share`` times the words of the corpus; sources
share it by weight, none beyond ``max_repeats`` times its own words, the
excess reshared by weight. So target = min(max_repeats * size, level * weight)
for one level, found by repeated aggregates over the (small) source table.

Within a source the documents stand in order of the md5 of their id (then of
their text), one pass after the other; a copy is taken if its words begin
before the target is half a document away, so taken words come within about
half a document of the target and no document is taken more often than there
are passes. Word offsets are prefix sums over hash ranges: a table of range
totals per source, then a window inside each (source, range) of bounded size.

Curriculum: source s asks for words at the rate weight_s(t), t from 0 to 1,
a straight line between its ``start`` and ``end`` emphasis scaled so that its
integral is the target. The cumulative demand D_s(t) is a quadratic; a copy
whose middle stands at offset x gets the position t with D_s(t) = x, in closed
form, and ``mix`` range-sorts the copies by position.

Defined results: a null text has size 0; the null source is a source of its
own, last in order; a source without words has target 0; documents of size 0
and those the mix leaves out have taken 0 and no position; repeated rows are
documents of their own, ordered by id and text, equal ones in any order (they
are alike); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizspark.llm.common import WORD_PATTERN, fresh, shared_table, small_enough

WEIGHTS = (5, 2, 1)
#: Rate at the end over the rate at the start, for each weight in turn.
TILTS = (0.5, 1.0, 2.0)
_ROWS_PER_RANGE = 2_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: tuple[int, int] = (3, 2), max_repeats: int = 2) -> DataFrame:
    """(source, key, source_size, weight, tilt, target) from (source, size). The
    source's number in code point order picks its weight; ``share`` is a
    fraction, so that targets come from whole numbers."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    # one row per source, not per document: the only unpartitioned window
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = shared_table(per.withColumn("turn", turn.cast("int")))
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("turn") + 1)
    per = per.select("source", "source_size", pick(weights).cast("long").alias("weight"), pick(TILTS[:len(weights)] if len(weights) <= len(TILTS) else [1.0] * len(weights)).alias("tilt"))
    num, den = share
    total = per.agg(F.sum("source_size")).first()[0] or 0
    capped, free = 0, None     # words of the full sources, weight of the others
    cap = F.col("source_size") * max_repeats
    level_num = num * total    # level = level_num / (den * free)
    while True:
        if free is None:
            free = per.agg(F.sum("weight")).first()[0] or 0
        if not free:
            break
        over = (cap.cast("decimal(38,0)") * F.lit(den * free) < F.col("weight").cast("decimal(38,0)") * F.lit(str(level_num)).cast("decimal(38,0)"))
        s = per.agg(F.sum(F.when(over, cap)).alias("c"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        now, left = s["c"] or 0, s["w"] or 0
        if now == capped and left == free:
            break
        capped, free = now, left
        level_num = num * total - den * capped
    share_of = (F.col("weight") * F.lit(level_num).cast("long")).cast("double") / F.lit(float(den * max(free, 1)))
    return per.withColumn("target", F.least(cap.cast("double"), share_of) if free else cap.cast("double"))


def _range(ranges: int) -> Column:
    return F.floor(F.conv(F.substring("order1", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("long")


def _offsets(rows: DataFrame, sizes: DataFrame, ranges: int) -> DataFrame:
    """Adds ``start``: words of the source before the document, in md5 order."""
    totals = sizes.groupBy("source", _range(ranges).alias("range")).agg(F.sum("size").alias("in_range"))
    before = totals.select(F.col("source").alias("s2"), F.col("range").alias("r2"), F.coalesce(F.sum("in_range").over(
        Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    if small_enough(before, 200_000):
        before = F.broadcast(before)
    inside = Window.partitionBy("source", "range").orderBy("order1", "order2", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("range", _range(ranges)).withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return (local.join(before, F.col("source").eqNullSafe(F.col("s2")) & (F.col("range") == F.col("r2")))
            .withColumn("start", F.col("before") + F.col("local")).drop("s2", "r2", "before", "local", "range"))


def _position(x: Column, target: Column, tilt: Column) -> Column:
    """t in [0, 1] with D(t) = x for the rate r(t) = a (1 + (tilt - 1) t), whose
    integral over [0, 1] is the target."""
    share = x / target * (1 + tilt) / 2
    slope = tilt - 1
    return F.when(F.abs(slope) < 1e-9, share).otherwise(
        2 * share / (1 + F.sqrt(F.greatest(1 + 2 * slope * share, F.lit(0.0)))))


def plan_mix(docs: DataFrame, weights: tuple = WEIGHTS, share: tuple[int, int] = (3, 2), max_repeats: int = 2,
             keep: bool = False) -> DataFrame:
    """A row per document: doc_id, size, source, source_size, target, taken and
    ``positions`` (the curriculum position of each copy); with ``keep`` also
    ``document``, all columns of the document as a struct."""
    rows = docs.select(
        F.col("doc_id"), words_in(F.col("text")).alias("size"), F.col("source").cast("string").alias("source"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("order1"),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("order2"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")] if keep else []))
    # a first pass for the sizes; texts, if wanted, travel once, to their (source, range)
    sizes = shared_table(rows.select("source", "size", "order1"))
    targets = shared_table(source_targets(sizes, weights, share, max_repeats))
    ranges = max(1, sizes.count() // _ROWS_PER_RANGE)
    t = targets.select(F.col("source").alias("s3"), "source_size", "tilt", "target")
    if small_enough(targets, 10_000):
        t = F.broadcast(t)
    placed = _offsets(rows, sizes, ranges).join(t, F.col("source").eqNullSafe(F.col("s3"))).drop("s3")
    n = F.lit(max_repeats)
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("start") + i * F.col("source_size"))
    taken = F.filter(starts, lambda s: 2 * s + F.col("size") < 2 * F.col("target"))
    taken = F.when(F.col("size") > 0, taken).otherwise(F.slice(starts, 1, 0))
    return (placed.withColumn("starts", taken)
            .withColumn("taken", F.size("starts") * F.col("size"))
            .withColumn("positions", F.transform("starts", lambda s: _position(
                (s + F.col("size") / 2).cast("double"), F.col("target"), F.col("tilt"))))
            .drop("starts", "start", "order1", "order2", "tilt"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: tuple[int, int] = (3, 2), max_repeats: int = 2) -> DataFrame:
    """The training order: every taken copy with all columns of its document,
    ``mix_copy`` (from 0) and ``mix_position`` (0 to 1), range-sorted by position."""
    pos, copy = fresh(docs, "mix_position"), fresh(docs, "mix_copy")
    plan = plan_mix(docs, weights, share, max_repeats, keep=True)
    out = plan.select("document", F.posexplode("positions").alias(copy, pos)).select("document.*", copy, pos)
    return out.repartitionByRange(F.col(pos), F.col("doc_id")).sortWithinPartitions(pos, "doc_id", copy)
