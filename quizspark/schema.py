"""Declared schemas and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values that must equal the reference's: option letters, in order.
LETTERS = ["A", "B", "C", "D", "E"]
FOUR_LETTERS = ["A", "B", "C", "D"]

# One model response to one question (one row per question per model run).
RESPONSE_SCHEMA = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("correct_answer", T.StringType()),
    T.StructField("question_index", T.LongType()),
    T.StructField("shuffle", T.ArrayType(T.IntegerType())),
    T.StructField("response", T.StringType()),
    T.StructField("top3", T.ArrayType(T.StringType())),
    T.StructField("clls", T.ArrayType(T.DoubleType())),
])

# A response document: {"questions": [ ...responses... ]}
RESPONSE_FILE_SCHEMA = T.StructType([
    T.StructField("questions", T.ArrayType(RESPONSE_SCHEMA)),
])

# Master question table (CSV with an unnamed first index column).
QUESTION_SCHEMA = T.StructType(
    [T.StructField("question_index", T.LongType()),
     T.StructField("prompt", T.StringType())]
    + [T.StructField(x, T.StringType()) for x in LETTERS]
    + [T.StructField("Answer", T.StringType()),
       T.StructField("Category", T.StringType()),
       T.StructField("IOD", T.DoubleType()),
       T.StructField("MD", T.DoubleType())]
    + [T.StructField(f"%{x}", T.DoubleType()) for x in LETTERS]
)

DIFFICULTY_SCHEMA = T.StructType([
    T.StructField("Index", T.LongType()),
    T.StructField("llm_difficulty", T.DoubleType()),
])

METRICS_SCHEMA = T.StructType([
    T.StructField("Accuracy", T.DoubleType()),
    T.StructField("F1 Score", T.DoubleType()),
])


def require_columns(df: DataFrame, columns) -> DataFrame:
    """Refuse a frame that lacks any of ``columns`` (raises ValueError)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")
    return df
