"""Scoring of model responses: accuracy, expected accuracy, difficulty,
per-category tables, weight distributions, evaluation metrics.

Input ``responses`` is one row per (question, model) with at least
``question_index, model, correct_answer, response, clls``. Every operator
is a single grouped aggregate (partial aggregation before the shuffle);
conditional subsets (category, correct / incorrect, model columns) are
computed in the same pass with ``when`` instead of one scan per subset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizspark.functions.arrays import (
    correct_flag, nan_to_null, p_correct, sorted_desc, letter_index, letters_array,
)
from quizspark.schema import LETTERS


def with_scores(responses: DataFrame, letters=LETTERS) -> DataFrame:
    """Adds ``correct`` (NULL counts as wrong) and ``p_correct`` (probability
    of the right option, NaN kept)."""
    return responses.withColumns({
        "correct": correct_flag("correct_answer", "response"),
        "p_correct": p_correct("clls", "correct_answer", letters),
    })


def accuracy_by_model(responses: DataFrame) -> DataFrame:
    """n_correct and raw_accuracy (= n_correct / rows) per model."""
    s = with_scores(responses)
    return s.groupBy("model").agg(
        F.count_if("correct").alias("n_correct"),
        (F.count_if("correct") / F.count(F.lit(1))).alias("raw_accuracy"))


def expected_accuracy_by_model(responses: DataFrame) -> DataFrame:
    """expected_correct = sum of p_correct (NaN skipped);
    expected_accuracy divides by *all* rows."""
    s = with_scores(responses)
    p = nan_to_null("p_correct")
    return s.groupBy("model").agg(
        F.coalesce(F.sum(p), F.lit(0.0)).alias("expected_correct"),
        (F.coalesce(F.sum(p), F.lit(0.0)) / F.count(F.lit(1))).alias("expected_accuracy"))


def expected_by_question(responses: DataFrame, keys=("question_index",)) -> DataFrame:
    """Per-question probability of the right answer for every model."""
    s = with_scores(responses)
    return s.select(*keys, "model", "p_correct")


def llm_difficulty(responses: DataFrame, keys=("question_index",), require_all_models: bool = False) -> DataFrame:
    """1 - mean over models of p_correct, per question.

    NaN is skipped by default (the reference's per-question table);
    ``require_all_models`` propagates it (the reference's array form), giving
    NULL when any model lacks a probability."""
    s = with_scores(responses)
    p = nan_to_null("p_correct")
    diff = F.lit(1.0) - F.avg(p)
    if require_all_models:
        diff = F.when(F.count(p) == F.count(F.lit(1)), diff)
    return s.groupBy(*keys).agg(diff.alias("llm_difficulty"))


def expected_by_model(responses: DataFrame, models, keys=("question_index",)) -> DataFrame:
    """Questions x models matrix of p_correct (pivot on an explicit model
    list, so no extra job discovers the values)."""
    s = with_scores(responses).select(*keys, "model", nan_to_null("p_correct").alias("_p"))
    # conditional aggregation over the explicit list: one partial-aggregated
    # shuffle on the question key (a pivot may plan a two-level aggregate)
    return s.groupBy(*keys).agg(*[F.max(F.when(F.col("model") == m, F.col("_p"))).alias(m) for m in models])


def model_means(responses: DataFrame, models, keys=("question_index",)) -> DataFrame:
    """Column means of the questions x models table plus its two derived
    columns (mean_expected_accuracy, llm_difficulty); long form."""
    wide = expected_by_model(responses, models, keys)
    per_q = wide.select("*", F.expr(" + ".join(f"coalesce(`{m}`, 0)" for m in models)).alias("_s"),
                        F.expr(" + ".join(f"cast(`{m}` is not null as int)" for m in models)).alias("_n"))
    mea = F.col("_s") / F.when(F.col("_n") > 0, F.col("_n"))
    per_q = per_q.withColumn("mean_expected_accuracy", mea).withColumn("llm_difficulty", F.lit(1.0) - mea)
    cols = list(models) + ["mean_expected_accuracy", "llm_difficulty"]
    one = per_q.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return one.select(F.expr(f"stack({len(cols)}, {stack}) as (column, mean)"))


def difficulty_histogram(difficulty: DataFrame, col: str = "llm_difficulty", bins: int = 10) -> DataFrame:
    """Counts in ``bins`` equal-width bins between min and max (last bin
    closed), every bin listed. min/max are one aggregate row collected as
    two literals (a fixed bound); the counts are one partial aggregate."""
    x = F.col(col)
    clean = difficulty.select(nan_to_null(col).alias(col)).where(x.isNotNull())
    lo, hi = clean.agg(F.min(col), F.max(col)).first()
    spark = clean.sparkSession
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if lo is None:
        return all_bins.select("bin", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                               F.lit(0).cast("long").alias("count"))
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    b = F.least(F.lit(bins - 1), F.floor((x - F.lit(lo)) * bins / F.lit(hi - lo))).cast("int")
    counts = clean.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    width = (hi - lo) / bins
    return (all_bins.join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def _category_key(category: str) -> Column:
    # used after rollup(...).agg(grouping(category).alias("_g"), ...)
    return F.when(F.col("_g") == 1, F.lit("All")).otherwise(F.col(category))


def category_metric_table(joined: DataFrame, questions: DataFrame, models, metric: str = "raw",
                          category: str = "Category", with_human: bool = False, letters=LETTERS) -> DataFrame:
    """Category x model table with an ``All`` row and ``Count`` column.

    ``joined`` = responses joined to questions (J1). ``metric`` is ``raw``
    (accuracy), ``expected`` (expected accuracy) or ``gap`` (raw - expected).
    Count and ``Human`` come from the questions table, accuracies from the
    responses: one aggregate by category over each, joined null-safely; the
    ``All`` row sums those few rows, so a category that is itself called All,
    or NULL, keeps its own row.
    """
    s = with_scores(joined)
    p = nan_to_null("p_correct")
    sums = []
    for i, m in enumerate(models):
        is_m = F.col("model") == m
        sums += [F.count(F.when(is_m, F.lit(1))).alias(f"_n{i}"), F.count(F.when(is_m & F.col("correct"), F.lit(1))).alias(f"_c{i}"),
                 F.sum(F.when(is_m, p)).alias(f"_e{i}")]
    per = s.groupBy(F.col(category).alias("_category")).agg(*sums)
    share = nan_to_null(F.get(F.array(*[F.col(f"`%{x}`") for x in letters]), letter_index("Answer", letters))) / 100 if with_human else F.lit(0.0)
    base = questions.groupBy(category).agg(F.count(F.lit(1)).alias("_rows"), F.sum(share).alias("_human"))
    cells = []
    for i, m in enumerate(models):
        n = F.sum(f"_n{i}")
        raw = F.try_divide(F.sum(f"_c{i}"), n)
        expected = F.try_divide(F.coalesce(F.sum(f"_e{i}"), F.lit(0.0)), n)
        cells.append({"raw": raw, "expected": expected, "gap": raw - expected}[metric].alias(m))
    # raw - expected cell by cell; Count - Count would be 0, so gap has no Count
    first = [] if metric == "gap" else [F.sum("_rows").alias("Count")]
    last = [F.try_divide(F.coalesce(F.sum("_human"), F.lit(0.0)), F.sum("_rows")).alias("Human")] if with_human else []
    both = base.join(per, F.col(category).eqNullSafe(F.col("_category")), "left")
    out = both.rollup(category).agg(F.grouping(category).alias("_g"), *first, *cells, *last)
    return out.select(_category_key(category).alias(category), *out.columns[2:])


def human_baseline(questions: DataFrame, category: str = "Category", letters=LETTERS) -> DataFrame:
    """Human n_correct = sum of %<Answer> / 100; raw_accuracy divides by rows.
    Expected equals raw for humans. Per category plus an ``All`` row."""
    pct = F.get(F.array(*[F.col(f"`%{x}`") for x in letters]), letter_index("Answer", letters))
    share = nan_to_null(pct) / 100
    return questions.rollup(category).agg(
        F.grouping(category).alias("_g"),
        F.coalesce(F.sum(share), F.lit(0.0)).alias("n_correct"),
        (F.coalesce(F.sum(share), F.lit(0.0)) / F.count(F.lit(1))).alias("raw_accuracy"),
    ).select(_category_key(category).alias(category), "n_correct", "raw_accuracy",
             F.col("n_correct").alias("expected_correct"), F.col("raw_accuracy").alias("expected_accuracy"))


def weight_distribution(responses: DataFrame, n: int = 5) -> DataFrame:
    """Mean of exp(sorted-descending clls) per rank, for all / correct /
    incorrect responses, divided by the subset's row count; one pass."""
    s = with_scores(responses).select("model", "correct", sorted_desc("clls", n).alias("_sorted"))
    subsets = {"all": F.lit(True), "correct": F.col("correct"), "incorrect": ~F.col("correct")}
    aggs = []
    for name, cond in subsets.items():
        rows = F.count(F.when(cond, F.lit(1)))
        for r in range(n):
            w = F.sum(F.when(cond, F.exp(F.get("_sorted", r)))) / rows
            aggs.append(w.alias(f"{name}_{r + 1}"))
    wide = s.groupBy("model").agg(*aggs)
    parts = ", ".join(f"'{name}', {r + 1}, `{name}_{r + 1}`" for name in subsets for r in range(n))
    return wide.select("model", F.expr(f"stack({len(subsets) * n}, {parts}) as (subset, rank, weight)"))


def option_perplexity(token_logprobs: DataFrame, keys=("question_index",)) -> DataFrame:
    """Mean negative log-prob of an option continuation (first token has no
    prediction and is NULL; padding is absent). Named mean_nll: it is not
    exponentiated, as in the reference."""
    return token_logprobs.groupBy(*keys, "option").agg((-F.avg("logprob")).alias("mean_nll"))


def min_perplexity_choice(token_logprobs: DataFrame, keys=("question_index",), letters=LETTERS,
                          tie_digits: int | None = 12) -> DataFrame:
    """Predicted letter = option with the lowest mean NLL (ties to the lowest
    letter); one aggregation per question computes all options at once.
    ``n_tied`` reports exact ties at the minimum (e.g. truncated prompts)."""
    def mean_nll(x):
        v = -F.avg(F.when(F.col("option") == x, F.col("logprob")))
        # equal means computed in a different order differ in the last bits
        return (F.round(v, tie_digits) if tie_digits is not None else v).alias(x)
    per = [mean_nll(x) for x in letters]
    wide = token_logprobs.groupBy(*keys).agg(*per)
    structs = [F.struct(F.col(x).alias("v"), F.lit(i).alias("i")) for i, x in enumerate(letters)]
    # least() ignores NULL structs only when the struct itself is NULL: make
    # missing options NULL structs so they never win.
    structs = [F.when(F.col(x).isNotNull(), s) for s, x in zip(structs, letters)]
    best = F.least(*structs)
    pred = F.get(letters_array(letters), best["i"])
    ties = sum(F.when(F.col(x) == best["v"], 1).otherwise(0) for x in letters)
    return wide.select(*keys, pred.alias("Prediction"), ties.cast("int").alias("n_tied"))


def eval_metrics(df: DataFrame, true_col: str = "Answer", pred_col: str = "Prediction") -> DataFrame:
    """Accuracy and support-weighted F1 (sklearn ``average='weighted'``).

    Rows are counted by (true, predicted) first - at most #labels^2 rows per
    partition shuffled - and each count stands once under its true and once
    under its predicted label. F1_L = 2TP / (support_L + predicted_L)."""
    pairs = df.groupBy(F.col(true_col).alias("t"), F.col(pred_col).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    t, p, n, none = F.col("t"), F.col("p"), F.col("n"), F.lit(0).cast("long")
    hit = F.when(t == p, n).otherwise(none)
    side = F.explode(F.array(
        F.struct(t.alias("label"), n.alias("is_true"), none.alias("is_pred"), hit.alias("tp")),
        F.struct(p.alias("label"), none.alias("is_true"), n.alias("is_pred"), none.alias("tp")),
    )).alias("e")
    per_label = pairs.select(side).select("e.*").groupBy("label").agg(
        F.sum("is_true").alias("support"), F.sum("is_pred").alias("predicted"), F.sum("tp").alias("tp"))
    f1 = F.when(F.col("support") + F.col("predicted") > 0,
                2.0 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    return per_label.agg(
        (F.sum("tp") / F.sum("support")).alias("Accuracy"),
        (F.sum(F.col("support") * f1) / F.sum("support")).alias("F1 Score"))


def top3_options(responses: DataFrame) -> DataFrame:
    from quizspark.functions.arrays import argmax_letter, top_k_letters
    return responses.select("question_index", "model", argmax_letter("clls").alias("response"),
                            top_k_letters("clls", 3).alias("top3"))


def context_cap(questions: DataFrame, registry: DataFrame, text_col: str = "question") -> DataFrame:
    """Per model: min(longest question in characters, model context)."""
    longest = questions.select(F.max(F.length(text_col))).scalar()
    return registry.select("*", F.least(longest, F.col("context")).cast("long").alias("max_length"))
