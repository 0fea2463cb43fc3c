"""Shared inputs of the registered queries: MCQ tables derived from the
driver tables (see ``quizspark.sources.fixtures``) and the derived
difficulty / cluster / training tables built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizspark.operators.joins import training_table
from quizspark.operators.scoring import llm_difficulty
from quizspark.sources import fixtures as fx

MODELS = fx.MODEL_NAMES


def responses(spark: SparkSession, sf: str) -> DataFrame:
    return fx.responses(spark, sf)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return fx.questions(fx.table(spark, sf, "orders"))


def master_questions(spark: SparkSession, sf: str) -> DataFrame:
    return fx.master_questions(spark, sf)


def difficulty(spark: SparkSession, sf: str) -> DataFrame:
    return llm_difficulty(responses(spark, sf), keys=("question_index", "Category"))


def prompt_clusters(q: DataFrame) -> DataFrame:
    """Fixture cluster assignment per distinct prompt (stands in for the
    clustering output, which the reference never joins back)."""
    return q.select("prompt").distinct().select(
        "prompt", (F.ascii(F.substr(F.md5("prompt"), F.lit(1), F.lit(1))) % 8).alias("cluster_label"))


def training(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark, sf).select("question_index", "prompt", "Category", "Answer")
    return training_table(q, difficulty(spark, sf), prompt_clusters(q))
