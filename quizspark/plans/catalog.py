"""Registered queries: one per operator of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables. Doubles are rounded to 9 digits at the very end (engines
differ in the last bits of exp/ln/sum); the matching DuckDB SQL lives in
``quizspark.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizspark.operators import joins as J
from quizspark.operators import ordering as O
from quizspark.operators import scoring as S
from quizspark.operators.position import keep
from quizspark.plans import inputs as I
from quizspark.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    cols = [F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(*cols)


# --- scoring ---------------------------------------------------------------

@query("llm_difficulty")
def q_llm_difficulty(spark, sf):
    return rounded(I.difficulty(spark, sf))


@query("expected_by_question")
def q_expected_by_question(spark, sf):
    return rounded(S.expected_by_question(I.responses(spark, sf)))


@query("accuracy_by_model")
def q_accuracy_by_model(spark, sf):
    return rounded(S.accuracy_by_model(I.responses(spark, sf)))


@query("expected_accuracy_by_model")
def q_expected_accuracy_by_model(spark, sf):
    return rounded(S.expected_accuracy_by_model(I.responses(spark, sf)))


@query("model_means")
def q_model_means(spark, sf):
    return rounded(S.model_means(I.responses(spark, sf), I.MODELS))


@query("difficulty_histogram")
def q_difficulty_histogram(spark, sf):
    return rounded(S.difficulty_histogram(I.difficulty(spark, sf)))


def _category_table(spark, sf, metric):
    q = I.master_questions(spark, sf)
    joined = J.join_on_index(I.responses(spark, sf), q)
    return rounded(S.category_metric_table(joined, q, I.MODELS, metric, with_human=metric != "gap"))


@query("accuracy_by_category")
def q_accuracy_by_category(spark, sf):
    return _category_table(spark, sf, "raw")


@query("expected_by_category")
def q_expected_by_category(spark, sf):
    return _category_table(spark, sf, "expected")


@query("accuracy_gap")
def q_accuracy_gap(spark, sf):
    return _category_table(spark, sf, "gap")


@query("human_baseline")
def q_human_baseline(spark, sf):
    return rounded(S.human_baseline(I.master_questions(spark, sf)))


@query("weight_distribution")
def q_weight_distribution(spark, sf):
    return rounded(S.weight_distribution(I.responses(spark, sf)))


@query("top3_options")
def q_top3_options(spark, sf):
    t = S.top3_options(I.responses(spark, sf))
    return t.select("question_index", "model", "response", F.array_join("top3", ",").alias("top3"))


@query("choice_log_likelihood")
def q_choice_log_likelihood(spark, sf):
    r = I.responses(spark, sf)
    # posexplode_outer + a filter on its output: the non-outer generator makes
    # Spark infer size(clls) > 0 and push it below the projection that builds
    # clls, inlining the whole log-softmax into one oversized filter
    e = r.select("question_index", "model", F.posexplode_outer("clls").alias("k", "cll")).where(F.col("k").isNotNull())
    letters = F.array(*[F.lit(x) for x in "ABCDE"])
    return rounded(e.select("question_index", "model", F.get(letters, F.col("k")).alias("option"), "cll"))


# --- joins -----------------------------------------------------------------

@query("join_on_index")
def q_join_on_index(spark, sf):
    j = J.join_on_index(I.responses(spark, sf), I.master_questions(spark, sf))
    return j.select("question_index", "model", "Category", "Answer", "response")


@query("expected_by_model")
def q_expected_by_model(spark, sf):
    return rounded(S.expected_by_model(I.responses(spark, sf), I.MODELS))


@query("training_table")
def q_training_table(spark, sf):
    return rounded(I.training(spark, sf), 12)


# --- orderings -------------------------------------------------------------

def _ordering(name):
    def run(spark, sf):
        t = keep(I.training(spark, sf).select("question_index", "cluster_label", "llm_difficulty"))
        return O.ORDERINGS[name](t, O.OrderingSpec()).select("question_index", "position")
    return run


for _key, _name in [("order_original", "original"), ("order_random", "random_shuffle"),
                    ("order_curriculum_strict", "curriculum_strict"), ("order_curriculum_emh", "curriculum_emh"),
                    ("order_blocked", "blocked"), ("order_blocked_strict", "blocked_curriculum_strict"),
                    ("order_blocked_emh", "blocked_emh"), ("order_interleaved", "interleaved"),
                    ("order_interleaved_strict", "interleaved_curriculum_strict"),
                    ("order_interleaved_emh", "interleaved_emh")]:
    QUERIES[_key] = _ordering(_name)


@query("all_orderings")
def q_all_orderings(spark, sf):
    return O.all_orderings(I.training(spark, sf), O.OrderingSpec(), columns=["question_index"])


@query("difficulty_levels")
def q_difficulty_levels(spark, sf):
    t = I.training(spark, sf)
    return t.select("question_index", O.level_name(O.difficulty_level("llm_difficulty")).alias("level"))


@query("split_three")
def q_split_three(spark, sf):
    spec = O.OrderingSpec()
    b = O.with_thirds(O.order_blocked(I.training(spark, sf), spec), spec)
    return b.select("question_index", "cluster_label", F.col("_third").cast("int").alias("third"))


@query("batch_assignment")
def q_batch_assignment(spark, sf):
    o = O.order_original(I.training(spark, sf))
    return O.batch_assignment(o, 8).select("question_index", "batch")


@query("step_plan")
def q_step_plan(spark, sf):
    o = O.order_blocked(I.training(spark, sf))
    return O.step_plan(o, 4, 2).select("question_index", "position", "step")


# --- prompts ---------------------------------------------------------------

from quizspark.functions import prompts as P  # noqa: E402
from quizspark.functions.text import STOP_WORDS, format_stat, word_count  # noqa: E402
from quizspark.operators import filters as Fl  # noqa: E402
from quizspark.operators import stats as St  # noqa: E402


@query("format_baseline_prompt")
def q_format_baseline_prompt(spark, sf):
    q = I.questions(spark, sf)
    return q.select("question_index", P.baseline_prompt().alias("question"), P.shuffled_answer().alias("answer"))


@query("shuffle_options")
def q_shuffle_options(spark, sf):
    q = I.questions(spark, sf).withColumn("shuffle", P.hash_shuffle("question_index", seed=0))
    return q.select("question_index", P.baseline_prompt(shuffle=F.col("shuffle")).alias("question"),
                    P.shuffled_answer(shuffle=F.col("shuffle")).alias("answer"),
                    F.array_join(F.col("shuffle").cast("array<string>"), ",").alias("shuffle"))


@query("format_scoring_prompt")
def q_format_scoring_prompt(spark, sf):
    return I.questions(spark, sf).select("question_index", P.scoring_prompt().alias("question"))


@query("format_train_prompt")
def q_format_train_prompt(spark, sf):
    q = I.questions(spark, sf)
    return q.select("question_index", P.train_prompt(q, fine_tune=True).alias("text"))


@query("format_test_prompt")
def q_format_test_prompt(spark, sf):
    q = I.questions(spark, sf).drop("E")
    return q.select("question_index", P.train_prompt(q, fine_tune=False).alias("text"))


@query("format_train_prompt_4")
def q_format_train_prompt_4(spark, sf):
    q = I.questions(spark, sf).drop("E")
    return q.select("question_index", P.train_prompt(q, fine_tune=True).alias("text"))


@query("format_test_prompt_5")
def q_format_test_prompt_5(spark, sf):
    q = I.questions(spark, sf)
    return q.select("question_index", P.train_prompt(q, fine_tune=False).alias("text"))


@query("completion_split")
def q_completion_split(spark, sf):
    q = I.questions(spark, sf)
    t = q.select("question_index", P.train_prompt(q, fine_tune=True).alias("text"))
    # the reference trains with max_seq_length=512; words stand in for tokens
    cols = P.completion_split("text", max_words=512)
    return t.select("question_index", *[c.alias(n) for n, c in cols.items()])


@query("word_count")
def q_word_count(spark, sf):
    return fx.prompts(spark, sf).select("question_index", word_count("prompt").alias("n_words"))


def _shuffled_run(spark, sf):
    r = I.responses(spark, sf).where(F.col("model") == "m2").withColumn("shuffle", fx.shuffle_slots())
    return St.shuffle_responses(r)


@query("unshuffle_responses")
def q_unshuffle_responses(spark, sf):
    u = St.unshuffle_responses(_shuffled_run(spark, sf))
    return u.select("question_index", "response", "correct_answer", F.array_join("top3", ",").alias("top3"))


@query("shuffle_agreement")
def q_shuffle_agreement(spark, sf):
    base = I.responses(spark, sf).where(F.col("model") == "m1")
    return rounded(St.shuffle_agreement(base, St.unshuffle_responses(_shuffled_run(spark, sf))))


# --- evaluation ------------------------------------------------------------

@query("option_perplexity")
def q_option_perplexity(spark, sf):
    return rounded(S.option_perplexity(fx.token_logprobs(spark, sf)))


@query("min_perplexity_choice")
def q_min_perplexity_choice(spark, sf):
    return S.min_perplexity_choice(fx.token_logprobs(spark, sf))


def _attached(spark, sf):
    preds = S.min_perplexity_choice(fx.token_logprobs(spark, sf)).select("question_index", "Prediction")
    test = I.questions(spark, sf).select("question_index", "Category", "Answer")
    return J.attach_predictions(test, preds)


@query("attach_predictions")
def q_attach_predictions(spark, sf):
    return _attached(spark, sf)


@query("eval_metrics")
def q_eval_metrics(spark, sf):
    return rounded(S.eval_metrics(_attached(spark, sf), "Answer", "Prediction"))


# --- filters and sources ---------------------------------------------------

@query("category_filter")
def q_category_filter(spark, sf):
    return Fl.category_filter(I.responses(spark, sf), "2-HIGH").select("question_index", "model", "response")


@query("correct_filter")
def q_correct_filter(spark, sf):
    return Fl.correct_filter(I.responses(spark, sf)).select("question_index", "model")


@query("limit_questions")
def q_limit_questions(spark, sf):
    return Fl.limit_questions(I.questions(spark, sf), 1000).select("question_index", "prompt")


@query("distinct_prompts")
def q_distinct_prompts(spark, sf):
    d = Fl.distinct_prompts(fx.prompts(spark, sf))
    return d.select("first_index", "n_copies", F.md5("prompt").alias("prompt_md5"))


@query("normalise_nested")
def q_normalise_nested(spark, sf):
    n = Fl.normalise_nested(fx.nested_mcq(I.questions(spark, sf)))
    return n.select("question_index", "prompt", "A", "B", "C", "D", "E", "Answer")


@query("normalise_flat")
def q_normalise_flat(spark, sf):
    n = Fl.normalise_flat(fx.flat_mcq(I.questions(spark, sf)))
    return n.select("question_index", "prompt", "A", "B", "C", "D", "Answer")


@query("join_on_text")
def q_join_on_text(spark, sf):
    """Documents stand for questions (with their copies), answered by two models."""
    d = fx.table(spark, sf, "documents")
    r = d.select(F.col("text").alias("question"), F.concat(F.lit("m"), (F.col("doc_id") % 2 + 1).cast("string")).alias("model"),
                 F.substr(F.lit("ABCDE"), (F.col("doc_id") % 5 + 1).cast("int"), F.lit(1)).alias("response"))
    q = d.select(F.col("doc_id").alias("question_index"), F.col("text").alias("question"))
    return J.join_on_text(r, q).select("question_index", "model", "response", "n_responses")


@query("difficulty_index")
def q_difficulty_index(spark, sf):
    from quizspark.sources.writers import difficulty_index
    return rounded(difficulty_index(I.difficulty(spark, sf).select("question_index", "llm_difficulty")))


@query("incorrect_filter")
def q_incorrect_filter(spark, sf):
    return Fl.correct_filter(I.responses(spark, sf), incorrect=True).select("question_index", "model")


@query("human_and_models")
def q_human_and_models(spark, sf):
    r = I.responses(spark, sf)
    models = S.accuracy_by_model(r).join(S.expected_accuracy_by_model(r), "model") \
        .select(F.col("model").alias("name"), F.col("n_correct").cast("double").alias("n_correct"),
                "raw_accuracy", "expected_correct", "expected_accuracy")
    human = S.human_baseline(I.master_questions(spark, sf)).where(F.col("Category") == "All") \
        .select(F.lit("Human").alias("name"), "n_correct", "raw_accuracy", "expected_correct", "expected_accuracy")
    return rounded(human.unionByName(models))


# Fixed value of the fixture: report order of categories (one absent).
CATEGORY_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT", "0-NONE", "All"]


@query("ordered_category_table")
def q_ordered_category_table(spark, sf):
    t = q_accuracy_by_category(spark, sf)
    order = spark.createDataFrame([(i, c) for i, c in enumerate(CATEGORY_ORDER)], "sort_order int, Category string")
    return order.join(t, "Category", "left")


# The reference's model registry (name, context window).
MODEL_REGISTRY = [
    ("Mistral_8x7B", 32768), ("Meditron_7B", 4096), ("Meditron_70B", 4096), ("Llama_2_7B", 4096),
    ("Llama_2_13B", 4096), ("Llama_2_70B", 4096), ("Gemma_7B", 8192), ("Jamba", 256000), ("DBRX", 32768),
]


@query("context_cap")
def q_context_cap(spark, sf):
    q = I.questions(spark, sf).select(P.baseline_prompt().alias("question"))
    reg = spark.createDataFrame(MODEL_REGISTRY, "model string, context long")
    return S.context_cap(q, reg, "question")


# --- statistics ------------------------------------------------------------

@query("difficulty_corr")
def q_difficulty_corr(spark, sf):
    joined = J.join_on_index(I.responses(spark, sf), I.master_questions(spark, sf))
    return rounded(St.difficulty_correlations(joined))


@query("pairwise_corr")
def q_pairwise_corr(spark, sf):
    return rounded(St.pairwise_correlations(I.responses(spark, sf), I.MODELS))


def _cell(df):
    """The report's cell: r or z to two places, starred where p < 0.05."""
    stat = "r" if "r" in df.columns else "z"
    return rounded(df.withColumn("cell", format_stat(stat, "pvalue")))


@query("difficulty_corr_p")
def q_difficulty_corr_p(spark, sf):
    joined = J.join_on_index(I.responses(spark, sf), I.master_questions(spark, sf))
    return _cell(St.difficulty_correlations(joined, with_p=True))


@query("pairwise_corr_p")
def q_pairwise_corr_p(spark, sf):
    return _cell(St.pairwise_correlations(I.responses(spark, sf), I.MODELS, with_p=True))


@query("calibration_p")
def q_calibration_p(spark, sf):
    return _cell(St.calibration(I.responses(spark, sf), with_p=True))


@query("best_peer")
def q_best_peer(spark, sf):
    return St.best_peer(rounded(St.pairwise_correlations(I.responses(spark, sf), I.MODELS)))


@query("calibration")
def q_calibration(spark, sf):
    return rounded(St.calibration(I.responses(spark, sf)))


@query("length_regression")
def q_length_regression(spark, sf):
    # questions are whole documents, so ln(word count) varies
    r = fx.responses_for(fx.document_questions(fx.table(spark, sf, "documents")))
    return rounded(St.length_regression(r, "question"), 6)


# --- clustering --------------------------------------------------------------

from quizspark.operators import clustering as C  # noqa: E402


def _vectors(spark, sf):
    return fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query("knn_graph")
def q_knn_graph(spark, sf):
    return rounded(C.knn_graph(_vectors(spark, sf), 10, "id", "vec", metric="cosine"))


@query("knn_approximate")
def q_knn_approximate(spark, sf):
    return rounded(C.approximate_knn(_vectors(spark, sf), 10, "id", "vec", metric="cosine"))


@query("neighbour_coords")
def q_neighbour_coords(spark, sf):
    from quizspark.operators.spectral import spectral_coordinates
    c = spectral_coordinates(C.neighbour_graph(_vectors(spark, sf), 10, metric="cosine"), 3, max_rounds=10)
    return rounded(c.select("id", *[F.get("reduced", i).alias(f"c{i + 1}") for i in range(3)]), 4)


@query("density_clusters")
def q_density_clusters(spark, sf):
    g = C.knn_graph(_vectors(spark, sf), 10, "id", "vec", metric="cosine")
    return rounded(C.density_clusters(g, min_samples=5, min_cluster_size=25))


@query("embed_prompts")
def q_embed_prompts(spark, sf):
    d = Fl.distinct_prompts(fx.prompts(spark, sf))
    e = C.embed_prompts(d, "prompt", "embedding")
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array("embedding")
    return e.select("first_index", F.size(F.filter(arr, lambda x: x != 0)).alias("n_terms"),
                    F.sqrt(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).transform(rounded)


@query("embed_wide")
def q_embed_wide(spark, sf):
    from quizspark.operators.wide import embed_wide
    d = Fl.distinct_prompts(fx.prompts(spark, sf))
    e = embed_wide(d, "first_index", "prompt", k=16)
    return rounded(e.select(F.col("id").alias("first_index"), *[F.get("embedding", i).alias(f"e{i + 1}") for i in range(16)]), 4)


@query("reduce_dims")
def q_reduce_dims(spark, sf):
    v = C.vectors_from_array(fx.table(spark, sf, "embeddings"), "embedding", "features")
    from pyspark.ml.functions import vector_to_array
    r = C.reduce_dims(v, 8, "features", "reduced").select("vec_id", vector_to_array("reduced").alias("r"))
    return rounded(r.select("vec_id", *[F.get("r", i).alias(f"pc{i + 1}") for i in range(8)]), 6)


@query("cluster_score")
def q_cluster_score(spark, sf):
    return rounded(C.cluster_score(fx.planted_clusters(spark, sf)))


@query("cluster_objective")
def q_cluster_objective(spark, sf):
    return rounded(C.cluster_objective(C.cluster_score(fx.planted_clusters(spark, sf))))


@query("cluster_search")
def q_cluster_search(spark, sf):
    v = C.vectors_from_array(fx.table(spark, sf, "embeddings"), "embedding", "features")
    trials, _best = C.cluster_search(v, "vec_id", "features", n_trials=100)
    return rounded(trials)


@query("cluster_top_words")
def q_cluster_top_words(spark, sf):
    p = fx.prompts(spark, sf)
    return C.cluster_top_words(p, "prompt", "Category", "question_index", stop_words=list(STOP_WORDS))


@query("prompt_categories")
def q_prompt_categories(spark, sf):
    from quizspark.plans.lifecycles import prompt_categories
    labels, _trials = prompt_categories(spark, fx.prompts(spark, sf), n_trials=100)
    return labels.select(F.md5("prompt").alias("prompt_md5"), "cluster_label")
