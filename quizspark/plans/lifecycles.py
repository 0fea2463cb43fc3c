"""End-to-end plans a user runs, composed from the
operators: each reads tables, builds one lazy plan per output and writes it
with a distributed writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizspark.operators import clustering as C
from quizspark.operators import joins as J
from quizspark.operators import ordering as O
from quizspark.operators import scoring as S
from quizspark.operators import stats as St
from quizspark.operators.filters import distinct_prompts, drop_models
from quizspark.operators.position import join_small
from quizspark.schema import require_columns
from quizspark.session import saved
from quizspark.sources import writers as W


# A. responses -> difficulty table (+ score tables)

def difficulty_from_responses(responses: DataFrame, dataset: str | None = None, models=None,
                              exclude_models=(), require_all_models: bool = False,
                              out_path: str | None = None) -> DataFrame:
    """``Index, llm_difficulty`` from a response table (one row per question
    per model); optionally written as the reference's difficulty file."""
    r = responses
    if dataset is not None and "dataset" in r.columns:
        r = r.where(F.col("dataset") == dataset)
    if models is not None:
        r = r.where(F.col("model").isin(list(models)))
    if exclude_models:
        r = drop_models(r, exclude_models)
    d = S.llm_difficulty(r, ("question_index",), require_all_models)
    if out_path is not None:
        return W.write_difficulty(d, out_path)
    return d


def score_report(responses: DataFrame, questions: DataFrame, models) -> dict[str, DataFrame]:
    """The scoring notebook's tables, each one grouped aggregate over the
    joined responses (nothing is reloaded per category or per model)."""
    joined = J.join_on_index(responses, questions)
    human = S.human_baseline(questions)
    pairs = St.pairwise_correlations(responses, models, with_p=True)
    return {
        "accuracy_by_model": S.accuracy_by_model(responses),
        "expected_accuracy_by_model": S.expected_accuracy_by_model(responses),
        "accuracy_by_category": S.category_metric_table(joined, questions, models, "raw", with_human=True),
        "expected_by_category": S.category_metric_table(joined, questions, models, "expected", with_human=True),
        "accuracy_gap": S.category_metric_table(joined, questions, models, "gap"),
        "human_baseline": human,
        "difficulty_corr": St.difficulty_correlations(joined, with_p=True),
        "pairwise_corr": pairs,
        "best_peer": St.best_peer(pairs),
        "calibration": St.calibration(responses, with_p=True),
        "weight_distribution": S.weight_distribution(responses),
    }


# B. training table -> ordered training sets

def write_curriculum(training: DataFrame, base: str, dataset: str, spec: O.OrderingSpec = O.OrderingSpec(),
                     names=None, columns=None) -> DataFrame:
    """All orderings of ``training`` written under base/dataset=<d>/ordering=<o>
    (range-partitioned and sorted by position)."""
    require_columns(training, [spec.key, spec.category_col, spec.difficulty_col])
    out = O.all_orderings(training, spec, names, columns)
    W.write_all_orderings(out, base, dataset)
    return out


# C. test set + option token log-probs -> predictions + metrics

def evaluate(test: DataFrame, token_logprobs: DataFrame, predictions_path: str | None = None,
             metrics_path: str | None = None, n_options: int = 5) -> tuple[DataFrame, DataFrame]:
    """Prediction = option with the lowest mean NLL; accuracy and weighted
    F1 against ``Answer``; predictions overwritten, metrics appended."""
    from quizspark.schema import LETTERS
    preds = S.min_perplexity_choice(token_logprobs, letters=LETTERS[:n_options]).select("question_index", "Prediction")
    attached = J.attach_predictions(test, preds)
    metrics = S.eval_metrics(attached, "Answer", "Prediction")
    if predictions_path:
        W.write_predictions(attached, predictions_path)
    if metrics_path:
        W.append_metrics(metrics, metrics_path)
    return attached, metrics


# D. prompts -> categories

def prompt_categories(spark: SparkSession, questions: DataFrame, n_trials: int = 100, seed: int = 42,
                      encoder=None, label_lower: int = 6, label_upper: int = 20) -> tuple[DataFrame, DataFrame]:
    """Distinct prompts -> embeddings -> trial search -> (prompt,
    cluster_label) for the best trial, plus the trials table."""
    require_columns(questions, ["prompt"])
    key = "question_index" if "question_index" in questions.columns else None
    q = questions if key else questions.withColumn("question_index", F.monotonically_increasing_id())
    # saved, as the texts would be shuffled anew for each that reads them
    d = distinct_prompts(q, "prompt", "question_index").transform(saved)
    e = C.embed_prompts(d, "prompt", "features", encoder=encoder)
    trials, best = C.cluster_search(e, "first_index", "features", n_trials=n_trials, seed=seed,
                                    label_lower=label_lower, label_upper=label_upper)
    labels = join_small(d, best.withColumnRenamed("id", "first_index"), ["first_index"]).select(
        "prompt", F.col("cluster").alias("cluster_label"))
    return labels, trials
