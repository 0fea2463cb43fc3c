"""Global row positions without a single-task window.

``row_number() over (order by ...)`` with no partition pulls the whole table
into one task. Instead:

1. range-partition on the full sort key (Spark samples the key to pick the
   bounds, so a hot value of the leading column is still split: the key
   always ends with a unique column) and sort inside each partition;
2. number rows inside each partition (``monotonically_increasing_id`` minus
   the partition's base id: the sort order of the partition);
3. count rows per partition — exactly ``n_partitions`` numbers, a proven
   bound, collected like ``RDD.zipWithIndex`` does — into running offsets;
4. position = offset[partition] + local index (a literal array lookup, no
   join, no window).

The range-partitioned frame is persisted (memory, spilling to disk) so the
count branch and the main branch read the *same* partitions: range bounds
come from sampling, and when the input arrives in shuffle-fetch order two
separate exchanges could sample different bounds. A lost cached block is
recomputed from the same shuffle dependency (fixed partitioner) and sorted
on a total key, so positions survive executor loss unchanged.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PERSISTED: list[DataFrame] = []
#: Rows that the driver may sum by itself.
SMALL_ROWS = 5_000


def keep(df: DataFrame) -> DataFrame:
    """Persist a derived table read by several jobs (range sampling, the
    shuffle, size checks) so its upstream runs once; released together with
    the position frames by :func:`release_positions`."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _PERSISTED.append(df)
    return df


def release_positions() -> None:
    """Unpersist the range-partitioned frames kept by global_position."""
    while _PERSISTED:
        _PERSISTED.pop().unpersist()


def _n_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_position(df: DataFrame, order_by: list, position_col: str = "position",
                    n_partitions: int | None = None) -> DataFrame:
    """Add a 0-based ``position`` following ``order_by`` (Columns with
    asc/desc/nulls ordering, or names). The last sort column should be
    unique so that positions are deterministic. The frame is persisted after
    the range shuffle, and a cache stops column pruning: project ``df`` to
    the columns you need first."""
    n = _n_partitions(df, n_partitions)
    cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    ranged = (df.repartitionByRange(n, *cols)
              .sortWithinPartitions(*cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_rid", F.monotonically_increasing_id())
              .persist(StorageLevel.MEMORY_AND_DISK))
    _PERSISTED.append(ranged)
    # n_partitions counts (a proven bound, as RDD.zipWithIndex collects);
    # this action also materialises the persisted partitions
    counts = dict(ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).collect())
    offsets, run = [], 0
    for pid in range(n):
        offsets.append(run)
        run += counts.get(pid, 0)
    local = F.col("_rid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    if len(offsets) <= 512:
        offset = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_pid") + 1)
        return ranged.withColumn(position_col, (offset + local).cast("long")).drop("_pid", "_rid")
    # a literal per partition would be slow to plan; the table has a row for each
    table = df.sparkSession.createDataFrame(list(enumerate(offsets)), "_pid int, _offset long")
    return (ranged.join(F.broadcast(table), "_pid")
            .withColumn(position_col, (F.col("_offset") + local).cast("long")).drop("_pid", "_rid", "_offset"))


def group_bounds(positioned: DataFrame, group_cols, position_col: str = "position") -> DataFrame:
    """Per group: first global position ``_gstart`` and size ``_gsize``.
    Groups are contiguous in the global order, so rank-in-group is
    ``position - _gstart`` — no per-group window (a hot group would be one
    task)."""
    return positioned.groupBy(*group_cols).agg(
        F.min(position_col).alias("_gstart"), F.count(F.lit(1)).alias("_gsize"))


def table_bytes(df: DataFrame) -> int:
    """Bytes of the values of ``df``: lengths of the strings, 16 for any other
    column and for each string's header."""
    wide = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)).cast("long") for f in df.schema.fields
            if isinstance(f.dataType, T.StringType)]
    fixed = F.lit(16 * len(df.columns)).cast("long")
    return df.agg(F.coalesce(F.sum(sum(wide, fixed)), F.lit(0))).first()[0]


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", max_bytes: int = 32 << 20) -> DataFrame:
    """Join a table of a row per group: broadcast if its measured size is at
    most ``max_bytes``, beyond that an ordinary join, whose hot groups Spark's
    adaptive skew join splits. Rows and positions are the same either way."""
    return big.join(F.broadcast(small) if table_bytes(small) <= max_bytes else small, on, how)


def running_sums(table: DataFrame, order_by: list, sums: dict[str, str], n_partitions: int | None = None) -> DataFrame:
    """For each column -> name in ``sums``: sum of the column over all earlier
    rows in the order of ``order_by`` (which ends with a unique column). A table of
    at most ``SMALL_ROWS`` rows is summed by the driver, in the one job that makes
    it; of a larger one range partitions are summed apart and the driver adds up one
    row for each. The sums are the same."""
    n = _n_partitions(table, n_partitions)
    cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    rows = table.orderBy(*cols).limit(SMALL_ROWS + 1).collect()
    if len(rows) <= SMALL_ROWS:
        out, run = [], [0] * len(sums)
        for r in rows:
            out.append((*r, *run))
            run = [a + (r[c] or 0) for a, c in zip(run, sums)]
        schema = T.StructType([*table.schema.fields, *[T.StructField(name, T.LongType()) for name in sums.values()]])
        return table.sparkSession.createDataFrame(out, schema)
    ranged = table.repartitionByRange(n, *cols).withColumn("_pid", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    _PERSISTED.append(ranged)
    totals = {r["_pid"]: r for r in ranged.groupBy("_pid").agg(*[F.sum(c).alias(c) for c in sums]).collect()}
    offsets, run = [], [0] * len(sums)
    for pid in range(n):
        offsets.append((pid, *run))
        if pid in totals:
            run = [a + (totals[pid][c] or 0) for a, c in zip(run, sums)]
    base = table.sparkSession.createDataFrame(offsets, "_pid int, " + ", ".join(f"_base{i} long" for i in range(len(sums))))
    inside = Window.partitionBy("_pid").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(base), "_pid").select(  # a row per partition
        *table.columns, *[(F.col(f"_base{i}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(name)
                          for i, (c, name) in enumerate(sums.items())])
