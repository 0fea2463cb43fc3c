"""Sinks: difficulty table, ordered training sets, responses, metrics,
predictions. Every write is a distributed Spark write (no single-file
funnel); partitioned outputs use dynamic partition overwrite, so re-running
one (dataset, ordering) or (dataset, model) replaces only that partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizspark.operators.position import global_position


def _dynamic(writer):
    return writer.option("partitionOverwriteMode", "dynamic")


def difficulty_index(difficulty: DataFrame, key: str = "question_index") -> DataFrame:
    return global_position(difficulty.select(key, "llm_difficulty"), [F.col(key)], "Index").select("Index", "llm_difficulty", key)


def write_difficulty(difficulty: DataFrame, path: str, fmt: str = "csv", key: str = "question_index") -> DataFrame:
    """Columns ``Index, llm_difficulty`` and the key. Index is the row position
    in question order (0..n-1); the key makes the file joinable where keys
    have gaps. The positions' range partitions are written as they are."""
    out = difficulty_index(difficulty, key)
    w = out.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))
    return out


def write_ordering(ordered: DataFrame, base: str, dataset: str, ordering: str, fmt: str = "parquet") -> None:
    """One output per (dataset, ordering); files are range-partitioned and
    sorted by ``position`` so part order follows the training order."""
    out = (ordered.withColumn("dataset", F.lit(dataset)).withColumn("ordering", F.lit(ordering))
           .repartitionByRange("position").sortWithinPartitions("position"))
    w = _dynamic(out.write.mode("overwrite").partitionBy("dataset", "ordering"))
    (w.option("header", True).csv(base) if fmt == "csv" else w.parquet(base))


def write_all_orderings(orderings: DataFrame, base: str, dataset: str) -> None:
    """All orderings (``ordering`` column) in one job."""
    out = (orderings.withColumn("dataset", F.lit(dataset))
           .repartitionByRange("ordering", "position").sortWithinPartitions("ordering", "position"))
    _dynamic(out.write.mode("overwrite").partitionBy("dataset", "ordering")).parquet(base)


def read_ordering(spark, base: str, dataset: str, ordering: str) -> DataFrame:
    return (spark.read.parquet(base).where((F.col("dataset") == dataset) & (F.col("ordering") == ordering))
            .orderBy("position"))


def write_responses(responses: DataFrame, path: str) -> None:
    """Responses as Parquet partitioned by dataset and model; re-running a
    model replaces only its partition (idempotent, unlike rewriting the
    whole JSON file)."""
    _dynamic(responses.write.mode("overwrite").partitionBy("dataset", "model")).parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append one metrics row per run (header in every part file; read with
    header=True)."""
    metrics.coalesce(1).write.mode("append").option("header", True).csv(path)


def write_predictions(predictions: DataFrame, path: str, fmt: str = "csv") -> None:
    w = predictions.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))
