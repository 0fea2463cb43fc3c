"""MCQ tables derived from the driver's generic tables.

The driver ships TPC-H-like tables, not multiple-choice data, so questions,
human answer shares, model logits and token log-probs are *derived* from
``orders`` (one question per order), prompts from ``documents`` and vectors
from ``embeddings``. Each function is a narrow projection: no joins and no
shuffles; the fixed per-question fan-out (models x options, tokens) is a
``explode`` of a literal array (a Generate node), never a cross join.

The formulas are the fixed test definitions shared with the DuckDB oracle
(`quizspark.plans.oracle`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizspark.functions.arrays import argmax_letter, top_k_letters, with_log_softmax
from quizspark.functions.prompts import scoring_prompt
from quizspark.schema import LETTERS

# Fixed values of the test fixture: model names with their numeric ids.
MODELS = [("m1", 1), ("m2", 2), ("m3", 3), ("m4", 4)]
MODEL_NAMES = [m for m, _ in MODELS]
N_TOKENS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _qi() -> Column:
    return F.col("question_index")


def questions(orders: DataFrame) -> DataFrame:
    """Master question table: question_index, prompt, Category, Answer, A..E,
    IOD, MD."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    mods = {"A": 7, "B": 11, "C": 13, "D": 17, "E": 19}
    return orders.select(
        k.alias("question_index"),
        F.concat(F.lit("order "), F.col("o_orderstatus"), F.lit(" "), k.cast("string")).alias("prompt"),
        F.col("o_orderpriority").alias("Category"),
        F.substr(F.lit("ABCDE"), (k % 5).cast("int") + 1, F.lit(1)).alias("Answer"),
        *[F.concat(F.lit(x.lower()), (c % m).cast("string")).alias(x) for x, m in mods.items()],
        (((k * 7) % 1000).cast("double") / 1000).alias("IOD"),
        (((k * 11 + c) % 1000).cast("double") / 1000).alias("MD"),
    )


def document_questions(documents: DataFrame) -> DataFrame:
    """Questions whose prompt is a whole document text (lengths vary from a
    few words to tens of thousands): same columns as :func:`questions`."""
    k, c = F.col("doc_id"), F.col("n_chars")
    mods = {"A": 7, "B": 11, "C": 13, "D": 17, "E": 19}
    return documents.select(
        k.alias("question_index"), F.col("text").alias("prompt"), F.col("source").alias("Category"),
        F.substr(F.lit("ABCDE"), (k % 5).cast("int") + 1, F.lit(1)).alias("Answer"),
        *[F.concat(F.lit(x.lower()), (c % m).cast("string")).alias(x) for x, m in mods.items()],
        (((k * 7) % 1000).cast("double") / 1000).alias("IOD"),
        (((k * 11 + c) % 1000).cast("double") / 1000).alias("MD"),
    )


def responses_for(q: DataFrame) -> DataFrame:
    """Model responses for any question table (see :func:`responses`)."""
    lg = logits(q)
    out = lg.select(
        "question_index", "Category", F.col("prompt").alias("question"), "correct_answer", "model",
        F.array(*[F.lit(i) for i in range(5)]).alias("shuffle"),
        argmax_letter("logits").alias("response"), top_k_letters("logits", 3).alias("top3"), "logits")
    return with_log_softmax(out, "logits", "clls", 5).drop("logits")


def with_human(q: DataFrame) -> DataFrame:
    """Adds %A..%E: the share (percent) of humans choosing each option."""
    w = [((_qi() * 13 + i * 29) % 97 + 1).cast("double") for i in range(5)]
    total = w[0] + w[1] + w[2] + w[3] + w[4]
    return q.select("*", *[(F.lit(100.0) * w[i] / total).alias(f"%{x}") for i, x in enumerate(LETTERS)])


def master_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_human(questions(table(spark, sf_dir, "orders")))


def logits(q: DataFrame) -> DataFrame:
    """One row per (question, model): the five choice logits as an array;
    ``prompt`` is the rendered scoring prompt the model saw."""
    m = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(i).alias("mid")) for n, i in MODELS])).alias("m")
    exploded = q.select("question_index", "Category", scoring_prompt().alias("prompt"),
                        F.col("Answer").alias("correct_answer"), m)
    arr = F.array(*[
        ((_qi() * 31 + F.col("m.mid") * 17 + i * 7
          + F.when(F.lit(x) == F.col("correct_answer"), 40).otherwise(0)) % 101).cast("double") / 20
        for i, x in enumerate(LETTERS)])
    return exploded.select("question_index", "Category", "prompt", "correct_answer",
                           F.col("m.model").alias("model"), arr.alias("logits"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses in the reference's response shape (array form):
    question_index, Category, question, correct_answer, model, shuffle,
    response, top3, clls."""
    lg = logits(questions(table(spark, sf_dir, "orders")))
    # log-softmax is monotonic: response / top3 come straight from the logits
    # (ties identical), which keeps the generated code small when a filter on
    # ``response`` is pushed down into this projection.
    out = lg.select(
        "question_index", "Category", F.col("prompt").alias("question"), "correct_answer", "model",
        F.array(*[F.lit(i) for i in range(5)]).alias("shuffle"),
        argmax_letter("logits").alias("response"), top_k_letters("logits", 3).alias("top3"), "logits")
    return with_log_softmax(out, "logits", "clls", 5).drop("logits")


def token_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-token log-probs of each option continuation for model m1; the
    first token has no prediction (NULL)."""
    q = questions(table(spark, sf_dir, "orders"))
    opt = F.explode(F.array(*[F.struct(F.lit(x).alias("option"), F.lit(i).alias("k")) for i, x in enumerate(LETTERS)]))
    per_opt = q.select("question_index", opt.alias("o"))
    tok = F.explode(F.sequence(F.lit(0), F.lit(N_TOKENS - 1))).alias("tok")
    rows = per_opt.select("question_index", F.col("o.option").alias("option"), F.col("o.k").alias("k"), tok)
    lp = F.when(F.col("tok") == 0, F.lit(None).cast("double")).otherwise(
        -(((_qi() * 5 + F.col("k") * 23 + F.col("tok") * 41) % 89 + 1).cast("double")) / 30)
    return rows.select("question_index", "option", "k", "tok", lp.alias("logprob"))


def shuffle_slots(key: str = "question_index"):
    """Option permutation as an array: shuffle[slot] = original option index,
    slot s shows original option (s + key) % 5."""
    return F.array(*[((F.lit(s) + F.col(key)) % 5).cast("int") for s in range(5)])


def nested_mcq(q: DataFrame) -> DataFrame:
    """Questions in the nested layout: question, answer_idx, options[{key, value}]."""
    opts = F.array(*[F.struct(F.lit(x).alias("key"), F.col(x).alias("value")) for x in LETTERS])
    return q.select("question_index", F.col("prompt").alias("question"), F.col("Answer").alias("answer_idx"),
                    opts.alias("options"))


def flat_mcq(q: DataFrame) -> DataFrame:
    """Questions in the flat 4-option layout: question, opa..opd, cop."""
    return q.select("question_index", F.col("prompt").alias("question"), F.col("A").alias("opa"),
                    F.col("B").alias("opb"), F.col("C").alias("opc"), F.col("D").alias("opd"),
                    (_qi() % 4).cast("int").alias("cop"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("question_index"), F.col("text").alias("prompt"),
                    F.col("source").alias("Category"), "lang", "n_chars")


def planted_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster assignments with membership probability for scoring tests."""
    e = table(spark, sf_dir, "embeddings")
    noise = (F.col("vec_id") % 17) == 0
    return e.select(
        "vec_id",
        F.when(noise, F.lit(-1)).otherwise(F.col("label")).alias("cluster"),
        F.when(noise, F.lit(0.0)).otherwise((F.col("vec_id") % 100).cast("double") / 100).alias("probability"))
