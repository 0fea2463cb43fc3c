"""Equi-joins between responses, questions, predictions, difficulty and
cluster tables. Spark picks broadcast or sort-merge at runtime (AQE); none
of these sides has a size bound, so no broadcast is forced here. Responses and
their questions are always merged: Spark judges a side by the size of the files
and columns it reads, and those of a few bytes a row can unfold into hundreds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizspark.operators.position import global_position


def join_on_index(responses: DataFrame, questions: DataFrame, key: str = "question_index",
                  how: str = "inner") -> DataFrame:
    """Responses joined to the master questions by question index. The
    questions' own ``question`` text is dropped first; other shared columns
    are taken from the questions table."""
    q = questions.drop("question")
    shared = [c for c in responses.columns if c in q.columns and c != key]
    return responses.drop(*shared).join(q.hint("merge"), key, how)


def join_on_text(responses: DataFrame, questions: DataFrame, text_col: str = "question",
                 null_safe: bool = False, duplicates: str = "count", by: tuple[str, ...] = ("model",),
                 warn_if_empty: bool = False) -> DataFrame:
    """Fallback when responses lack ``question_index``: join on the rendered
    question text, through its SHA-256 (the text itself is not shuffled twice).

    Every question with a matching text gets its rows, copies included.
    ``duplicates="count"`` (default) loses no response: every copy gets each distinct
    response (all its columns) once, with ``n_responses``, how often it was given, so
    k distinct responses give c x k rows however many there are.
    ``duplicates="all"`` reduces the responses to one per (text, ``by``) - the least
    by its columns - so a text that stands c times gives c rows per model; other
    responses to the text are lost. ``duplicates="multiply"`` keeps
    every response x copy, as a plain merge does. ``warn_if_empty`` runs a one-row
    probe and warns when nothing matches (e.g. responses rendered with another
    prompt template)."""
    if duplicates not in ("all", "count", "multiply"):
        raise ValueError("duplicates is 'all', 'count' or 'multiply'")
    if duplicates == "count" and "n_responses" in (*responses.columns, *questions.columns):
        raise ValueError("duplicates='count' adds the column n_responses, which is there already")
    text = F.col(text_col)
    key = F.sha2((F.coalesce(F.concat(F.lit("t"), text), F.lit("null")) if null_safe else text).cast("binary"), 256)
    q = questions.withColumn("_text_key", key).drop(text_col)
    r = responses.drop(*[c for c in responses.columns if c in questions.columns and c != text_col])
    r = r.withColumn("_text_key", key)
    if duplicates == "all":
        groups = [c for c in by if c in r.columns]
        rest = [c for c in r.columns if c not in (*groups, "_text_key")]
        r = r.groupBy("_text_key", *groups).agg(F.min(F.struct(*rest)).alias("_r")).select("_text_key", *groups, "_r.*")
    elif duplicates == "count":
        r = r.groupBy(*r.columns).agg(F.count(F.lit(1)).alias("n_responses"))
    out = r.join(q, "_text_key").drop("_text_key")
    if warn_if_empty and out.isEmpty():
        import warnings
        warnings.warn("join_on_text matched no question: were the responses rendered with another prompt "
                      "template?", stacklevel=2)
    return out


def attach_predictions(test: DataFrame, predictions: DataFrame, key: str = "question_index") -> DataFrame:
    """Test set + Prediction column (left join: unanswered questions keep a
    NULL prediction)."""
    return test.join(predictions, key, "left")


def training_table(questions: DataFrame, difficulty: DataFrame, clusters: DataFrame,
                   key: str = "question_index", prompt_col: str = "prompt",
                   difficulty_digits: int | None = 12) -> DataFrame:
    """Questions with ``llm_difficulty`` (by ``key``) and ``cluster_label`` (by
    prompt text); left joins keep every question. A difficulty table that has
    only ``Index`` is joined by row position in key order, which is what that
    column means. Difficulty is rounded to 12 digits so level thresholds and
    sort ties do not depend on the last bits of exp/ln."""
    value = F.col("llm_difficulty")
    if difficulty_digits is not None:
        value = F.round(value, difficulty_digits)
    if key in difficulty.columns:
        d = difficulty.select(key, value.alias("llm_difficulty"))
    else:
        at = global_position(questions.select(key), [F.col(key)], "_at")
        d = at.join(difficulty.select(F.col("Index").alias("_at"), value.alias("llm_difficulty")), "_at").drop("_at")
    c = clusters.select(prompt_col, "cluster_label")
    return questions.join(d, key, "left").join(c, prompt_col, "left")
