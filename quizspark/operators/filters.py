"""Row selections: category, correctness, question limit, distinct prompts,
model exclusion, and MCQ normalisation from nested / flat layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizspark.functions.arrays import correct_flag
from quizspark.schema import FOUR_LETTERS, LETTERS, require_columns


def category_filter(df: DataFrame, category: str, col: str = "Category") -> DataFrame:
    return df.where(F.col(col) == category)


def correct_filter(df: DataFrame, incorrect: bool = False) -> DataFrame:
    """Rows where the response is right (or wrong with ``incorrect``);
    a NULL response counts as wrong."""
    ok = correct_flag("correct_answer", "response")
    return df.where(~ok if incorrect else ok)


def limit_questions(df: DataFrame, n: int, key: str = "question_index", slots: int = 512, last: int = 10_000) -> DataFrame:
    """First ``n`` questions by a whole-number key (null keys first). Counts per
    key range narrow down the bound: rows under it are a filter that reaches
    the scan, and only the at most ``last`` rows around it are sorted."""
    k = F.col(key)
    nulls = df.where(k.isNull())
    n_null = nulls.count()
    if n_null >= n:
        return nulls.limit(n)
    lo, hi = df.agg(F.min(k), F.max(k)).first()
    if lo is None:
        return df
    hi, below = hi + 1, n_null          # rows with keys under lo
    while True:
        width = -(-(hi - lo) // slots)
        slot = F.floor((k - F.lit(lo)) / width)
        counts = {r[0]: r[1] for r in df.where((k >= lo) & (k < hi)).groupBy(slot.alias("s")).count().collect()}
        for s in sorted(counts):
            if below + counts[s] >= n:
                break
            below += counts[s]
        else:
            return df                    # the limit is not reached
        lo, hi = lo + s * width, min(hi, lo + (s + 1) * width)
        if counts[s] <= last or hi - lo == 1:
            break
    rest = df.where((k >= lo) & (k < hi))
    return df.where(k.isNull() | (k < lo)).unionByName(rest if below + counts[s] == n else rest.orderBy(key).limit(n - below))


def distinct_prompts(df: DataFrame, prompt_col: str = "prompt", key: str = "question_index") -> DataFrame:
    """Unique non-null prompts with the index of their first appearance and
    copy count (partial aggregation on the full text)."""
    require_columns(df, [prompt_col])
    return (df.where(F.col(prompt_col).isNotNull())
            .groupBy(prompt_col)
            .agg(F.min(key).alias("first_index"), F.count(F.lit(1)).alias("n_copies")))


def drop_models(df: DataFrame, models, cols=("model",)) -> DataFrame:
    """Exclude listed models from every model column (e.g. both axes of a
    pairwise table)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & ~F.col(c).isin(list(models))
    return df.where(cond)


def normalise_nested(df: DataFrame, n: int = 5) -> DataFrame:
    """question / answer_idx / options[{key, value}] -> prompt, A.., Answer."""
    letters = LETTERS[:n]
    cols = {x: F.get(F.col("options"), i)["value"] for i, x in enumerate(letters)}
    return (df.withColumnsRenamed({"question": "prompt", "answer_idx": "Answer"})
              .withColumns(cols).drop("options"))


def normalise_flat(df: DataFrame) -> DataFrame:
    """question, opa..opd, cop (0-based) -> prompt, A..D, Answer."""
    answer = F.get(F.array(*[F.lit(x) for x in FOUR_LETTERS]), F.col("cop").cast("int"))
    return (df.withColumn("Answer", answer)
              .withColumnsRenamed({"question": "prompt", "opa": "A", "opb": "B", "opc": "C", "opd": "D"})
              .drop("cop"))
