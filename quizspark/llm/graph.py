"""Connected components of a link table, by alternating large and small stars.

Every round is two aggregates (the least neighbour of each node) joined back
to the links; nodes of very many links are split by Spark's adaptive skew
join, and the aggregate combines on the map side. Rounds are checkpointed in
the shared folder and run until the link table stops changing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizspark.llm.common import shared_table


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b"), F.col("a")).toDF("a", "b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` have a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("x"), F.col("m").alias("y"))
    return (moved.union(least.select(F.col("a"), F.col("m")))
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long; either order);
    root is the least node reachable. Nulls and loops are left out."""
    cur = shared_table(links.toDF("a", "b").where("a <> b")
                       .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        cur = shared_table(_small_star(_large_star(cur)))
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return (cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
