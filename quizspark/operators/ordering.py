"""Training-set orderings: original, random, curriculum, blocked,
interleaved (the reference's ten data orders), plus batch / step plans.

Row order is the payload, so every ordering returns the input columns plus
an explicit 0-based ``position`` computed by :func:`global_position`
(range partitioning, no single-task window). Random orders use a keyed hash
``md5(seed || ':' || key)`` instead of a numpy permutation, so they are
deterministic, reproducible in SQL and independent of partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizspark.functions.arrays import nan_to_null
from quizspark.operators.position import _PERSISTED, global_position, group_bounds, join_small, running_sums


@dataclass(frozen=True)
class OrderingSpec:
    key: str = "question_index"
    category_col: str = "cluster_label"
    difficulty_col: str = "llm_difficulty"
    # The reference's easy / medium thresholds and seeds.
    easy_threshold: float = 0.66
    med_threshold: float = 0.80
    random_seed: int = 42
    blocked_seed: int = 1

    def with_(self, **kw) -> "OrderingSpec":
        return replace(self, **kw)


def shuffle_hash(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def difficulty_level(difficulty="llm_difficulty", easy: float = 0.66, med: float = 0.80) -> Column:
    """0 = easy (d <= easy), 1 = medium (easy < d <= med), 2 = hard (d > med);
    NULL for NULL/NaN (Spark orders NaN above every number, so it is nulled
    first)."""
    d = nan_to_null(F.col(difficulty) if isinstance(difficulty, str) else difficulty)
    return F.when(d <= easy, 0).when(d <= med, 1).when(d > med, 2)


def level_name(level: Column) -> Column:
    return F.element_at(F.array(F.lit("E"), F.lit("M"), F.lit("H")), level + 1)


def _level(spec: OrderingSpec) -> Column:
    return difficulty_level(spec.difficulty_col, spec.easy_threshold, spec.med_threshold)


def _diff_asc(spec: OrderingSpec) -> Column:
    return nan_to_null(F.col(spec.difficulty_col)).asc_nulls_last()


def order_original(df: DataFrame, spec: OrderingSpec = OrderingSpec()) -> DataFrame:
    return global_position(df, [F.col(spec.key)])


def order_random(df: DataFrame, spec: OrderingSpec = OrderingSpec()) -> DataFrame:
    return global_position(df, [shuffle_hash(spec.random_seed, spec.key), F.col(spec.key)])


def order_curriculum_strict(df: DataFrame, spec: OrderingSpec = OrderingSpec()) -> DataFrame:
    return global_position(df, [_diff_asc(spec), F.col(spec.key)])


def order_curriculum_emh(df: DataFrame, spec: OrderingSpec = OrderingSpec()) -> DataFrame:
    """Easy, then medium, then hard; shuffled inside each level; rows without
    difficulty are dropped (they match no level)."""
    lv = df.withColumn("_level", _level(spec)).where(F.col("_level").isNotNull())
    out = global_position(lv, [F.col("_level"), shuffle_hash(spec.random_seed, spec.key), F.col(spec.key)])
    return out.drop("_level")


def _with_category(df: DataFrame, spec: OrderingSpec) -> DataFrame:
    # pandas groupby drops NULL keys
    return df.where(F.col(spec.category_col).isNotNull())


def order_blocked(df: DataFrame, spec: OrderingSpec = OrderingSpec()) -> DataFrame:
    """Categories in ascending order (pandas groupby sorts them), shuffled
    inside each category."""
    return global_position(_with_category(df, spec),
                           [F.col(spec.category_col), shuffle_hash(spec.blocked_seed, spec.key), F.col(spec.key)])


def order_blocked_strict(df: DataFrame, spec: OrderingSpec = OrderingSpec()) -> DataFrame:
    return global_position(_with_category(df, spec), [F.col(spec.category_col), _diff_asc(spec), F.col(spec.key)])


def order_blocked_emh(df: DataFrame, spec: OrderingSpec = OrderingSpec()) -> DataFrame:
    lv = _with_category(df, spec).withColumn("_level", _level(spec)).where(F.col("_level").isNotNull())
    out = global_position(lv, [F.col(spec.category_col), F.col("_level"),
                               shuffle_hash(spec.blocked_seed, spec.key), F.col(spec.key)])
    return out.drop("_level")


def third_of(rank: Column, size: Column) -> Column:
    """Part (0, 1, 2) of a 0-based rank when a run of ``size`` rows is split
    into three near-equal consecutive parts, the first size % 3 parts one
    row longer (numpy ``array_split``)."""
    q = F.floor(size / 3)
    s0 = q + F.when(size % 3 > 0, 1).otherwise(0)
    s1 = q + F.when(size % 3 > 1, 1).otherwise(0)
    return F.when(rank < s0, 0).when(rank < s0 + s1, 1).otherwise(2)


def with_thirds(blocked: DataFrame, spec: OrderingSpec, position_col: str = "position") -> DataFrame:
    """Adds ``_rank`` (rank inside the category block) and ``_third`` to a
    blocked ordering, using per-category first position and size."""
    cat = spec.category_col
    b = join_small(blocked, group_bounds(blocked, [cat], position_col), cat)
    b = b.withColumn("_rank", F.col(position_col) - F.col("_gstart"))
    return b.withColumn("_third", third_of(F.col("_rank"), F.col("_gsize"))).drop("_gstart", "_gsize")


def _interleave(blocked: DataFrame, spec: OrderingSpec) -> DataFrame:
    """Interleaved position from the blocked one, by arithmetic: every
    (third, category) run is contiguous in the blocked order, so

        position = rows in earlier thirds (all categories)
                 + rows of this third in earlier categories
                 + offset inside the run.

    The table of a row per category (sizes, part sizes, running sums over
    categories) is summed by ranges of categories and joined to the rows."""
    cat = spec.category_col
    n = F.col("_gsize")
    q = F.floor(n / 3)
    parts = [q + F.when(n % 3 > 0, 1).otherwise(0), q + F.when(n % 3 > 1, 1).otherwise(0), q]
    sizes = group_bounds(blocked, [cat], "position").select(
        cat, "_gstart", "_gsize", *[p.cast("long").alias(f"_s{i}") for i, p in enumerate(parts)])
    table = running_sums(sizes, [cat], {f"_s{i}": f"_cum{i}" for i in range(3)})
    totals = table.agg(F.sum("_s0"), F.sum("_s1")).first()
    table = table.withColumns({f"_tot{i}": F.lit(t or 0) for i, t in enumerate(totals)})
    b = join_small(blocked, table, cat)
    rank = F.col("position") - F.col("_gstart")
    third = third_of(rank, n)
    start_in_cat = F.when(third == 0, 0).when(third == 1, F.col("_s0")).otherwise(F.col("_s0") + F.col("_s1"))
    base = F.when(third == 0, 0).when(third == 1, F.col("_tot0")).otherwise(F.col("_tot0") + F.col("_tot1"))
    cum = F.when(third == 0, F.col("_cum0")).when(third == 1, F.col("_cum1")).otherwise(F.col("_cum2"))
    pos = (base + cum + rank - start_in_cat).cast("long")
    return b.withColumn("position", pos).drop(*[c for c in table.columns if c != cat])


def order_interleaved(df: DataFrame, spec: OrderingSpec = OrderingSpec()) -> DataFrame:
    """First third of every category block (categories in order), then the
    second thirds, then the last thirds, over the blocked (shuffled) order."""
    return _interleave(order_blocked(df, spec), spec)


def order_interleaved_strict(df: DataFrame, spec: OrderingSpec = OrderingSpec()) -> DataFrame:
    return _interleave(order_blocked_strict(df, spec), spec)


def order_interleaved_emh(df: DataFrame, spec: OrderingSpec = OrderingSpec()) -> DataFrame:
    """Easy questions of every category (category order, blocked order
    inside), then medium, then hard."""
    lv = _with_category(df, spec).withColumn("_level", _level(spec)).where(F.col("_level").isNotNull())
    out = global_position(lv, [F.col("_level"), F.col(spec.category_col),
                               shuffle_hash(spec.blocked_seed, spec.key), F.col(spec.key)])
    return out.drop("_level")


def reorder_runs(positioned: DataFrame, run_cols, position_col: str = "position") -> DataFrame:
    """Re-order contiguous runs without re-sorting the rows: the runs keyed by
    ``run_cols`` are contiguous in the current order; the result orders runs
    by ``run_cols`` (in that column order, ascending) and keeps the current
    order inside each run. One row per run is aggregated, offset by a
    running sum over that table, and joined back."""
    runs = positioned.groupBy(*run_cols).agg(F.min(position_col).alias("_rstart"),
                                              F.count(F.lit(1)).alias("_rsize"))
    runs = running_sums(runs, list(run_cols), {"_rsize": "_roff"})
    out = join_small(positioned, runs, list(run_cols))
    return out.withColumn(position_col, (F.col("_roff") + F.col(position_col) - F.col("_rstart")).cast("long")) \
        .drop("_rstart", "_rsize", "_roff")


ORDERINGS = {
    "original": order_original,
    "random_shuffle": order_random,
    "curriculum_strict": order_curriculum_strict,
    "curriculum_emh": order_curriculum_emh,
    "blocked": order_blocked,
    "blocked_curriculum_strict": order_blocked_strict,
    "blocked_emh": order_blocked_emh,
    "interleaved": order_interleaved,
    "interleaved_curriculum_strict": order_interleaved_strict,
    "interleaved_emh": order_interleaved_emh,
}


def all_orderings(df: DataFrame, spec: OrderingSpec = OrderingSpec(), names=None,
                  columns=None) -> DataFrame:
    """Every ordering of ``df`` as one table with an ``ordering`` column.
    The base table is persisted once (memory, spilling to disk): the ten
    orderings and their size checks all read it instead of recomputing the
    upstream scoring and joins. Released with ``release_positions()``."""
    names = list(names or ORDERINGS)
    columns = list(columns or df.columns)
    # a cache blocks column pruning: keep only what the orderings read
    needed = list(dict.fromkeys(columns + [spec.key, spec.category_col, spec.difficulty_col]))
    df = df.select(*needed).persist(StorageLevel.MEMORY_AND_DISK)
    _PERSISTED.append(df)
    done: dict[str, DataFrame] = {}

    def get(n: str) -> DataFrame:
        # interleaved orders reuse the blocked orders already positioned
        if n not in done:
            if n == "interleaved":
                done[n] = _interleave(get("blocked"), spec)
            elif n == "interleaved_curriculum_strict":
                done[n] = _interleave(get("blocked_curriculum_strict"), spec)
            elif n == "interleaved_emh":
                # (level, category) runs are contiguous in the blocked EMH order
                be = get("blocked_emh").withColumn("_level", _level(spec))
                done[n] = reorder_runs(be, ["_level", spec.category_col]).drop("_level")
            else:
                done[n] = ORDERINGS[n](df, spec)
        return done[n]

    parts = [get(n).select(F.lit(n).alias("ordering"), *columns, "position") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def batch_assignment(positioned: DataFrame, batch_size: int = 8, position_col: str = "position") -> DataFrame:
    """Consecutive chunks of ``batch_size`` rows."""
    return positioned.withColumn("batch", F.floor(F.col(position_col) / batch_size).cast("long"))


def step_plan(positioned: DataFrame, per_device_batch: int = 4, grad_accum: int = 2, devices: int = 1,
              position_col: str = "position") -> DataFrame:
    """Optimizer step of each row under a sequential sampler."""
    per_step = per_device_batch * grad_accum * devices
    return positioned.withColumn("step", F.floor(F.col(position_col) / per_step).cast("long"))
