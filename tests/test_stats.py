"""Statistics: p-values, IRLS vs GLR, closed-form calibration, F1 vs MLlib."""
import math

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from quizspark.operators import scoring as S
from quizspark.operators import stats as St
from quizspark.plans import inputs as I
from quizspark.sources import fixtures as fx

from conftest import SF_SMALL


def test_pearson_pvalue_matches_t_table():
    # two-sided 5 % critical t: df=10 -> 2.228, df=30 -> 2.042
    for df_, t in [(10, 2.228138852), (30, 2.042272456)]:
        n = df_ + 2
        r = t / math.sqrt(df_ + t * t)
        assert abs(float(St.pearson_pvalue(r, n)) - 0.05) < 1e-6
    assert abs(float(St.normal_pvalue(1.959963985)) - 0.05) < 1e-8


def _glr(df, features, label):
    v = VectorAssembler(inputCols=features, outputCol="f").transform(df)
    m = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="f", labelCol=label,
                                    maxIter=100, tol=1e-12).fit(v)
    return m.intercept, m.coefficients[0], m.summary.coefficientStandardErrors[0]


def test_length_regression_matches_glr(spark):
    r = fx.responses_for(fx.document_questions(fx.table(spark, SF_SMALL, "documents")))
    ours = {x["model"]: x for x in St.length_regression(r, "question").collect()}
    from quizspark.functions.arrays import nan_to_zero, p_correct
    from quizspark.functions.text import word_count
    d = r.select("model", F.log(F.greatest(word_count("question"), F.lit(1)).cast("double")).alias("x"),
                 nan_to_zero(p_correct()).alias("y"))
    for m in ["m1", "m3"]:
        b0, b1, se = _glr(d.where(F.col("model") == m), ["x"], "y")
        assert abs(ours[m]["slope"] - b1) < 1e-6
        assert abs(ours[m]["intercept"] - b0) < 1e-6
        assert abs(ours[m]["se"] - se) < 1e-5


def test_calibration_matches_glr(spark):
    r = I.responses(spark, SF_SMALL)
    ours = {x["model"]: x for x in St.calibration(r, with_p=True).collect()}
    from quizspark.functions.arrays import correct_flag, nan_to_zero
    d = r.select("model", correct_flag().cast("double").alias("x"),
                 nan_to_zero(F.exp(F.array_max("clls"))).alias("y"))
    b0, b1, se = _glr(d.where(F.col("model") == "m2"), ["x"], "y")
    assert abs(ours["m2"]["slope"] - b1) < 1e-7 and abs(ours["m2"]["se"] - se) < 1e-7
    assert 0 <= ours["m2"]["pvalue"] <= 1


def test_weighted_f1_matches_mllib(spark):
    rows = [("A", "A"), ("A", "B"), ("B", "B"), ("C", "A"), ("C", "C"), ("C", "C"), ("B", "A"), ("D", "A")]
    df = spark.createDataFrame(rows, "Answer string, Prediction string")
    ours = S.eval_metrics(df).first()
    idx = StringIndexer(inputCol="Answer", outputCol="label", stringOrderType="alphabetAsc").fit(
        spark.createDataFrame([(x,) for x in "ABCD"], "Answer string"))
    t = idx.transform(df)
    t = idx.setInputCol("Prediction").setOutputCol("prediction").transform(t)
    ev = MulticlassClassificationEvaluator(metricName="f1", labelCol="label", predictionCol="prediction")
    assert abs(ours["F1 Score"] - ev.evaluate(t)) < 1e-12
    assert abs(ours["Accuracy"] - 4 / 8) < 1e-12


def test_pairwise_symmetric_diagonal_one(spark):
    p = St.pairwise_correlations(I.responses(spark, SF_SMALL), I.MODELS, with_p=True).collect()
    m = {(r["m1"], r["m2"]): r["r"] for r in p}
    assert len(m) == 16
    for (a, b), r in m.items():
        assert abs(r - m[(b, a)]) < 1e-15
        if a == b:
            assert abs(r - 1.0) < 1e-12
    best = {r["model"]: r for r in St.best_peer(St.pairwise_correlations(I.responses(spark, SF_SMALL), I.MODELS)).collect()}
    for a in I.MODELS:
        assert best[a]["r"] == max(v for (x, y), v in m.items() if x == a and y != a)


def test_shuffle_unshuffle_identity(spark):
    r = I.responses(spark, SF_SMALL).where(F.col("model") == "m1").withColumn("shuffle", fx.shuffle_slots())
    back = St.unshuffle_responses(St.shuffle_responses(r))
    a = r.select("question_index", "correct_answer", "clls").orderBy("question_index").collect()
    b = back.select("question_index", "correct_answer", "clls").orderBy("question_index").collect()
    assert [x["correct_answer"] for x in a] == [x["correct_answer"] for x in b]
    assert [x["clls"] for x in a] == [x["clls"] for x in b]


def test_difficulty_and_expected_accuracy_nan_conventions(spark):
    rows = [(1, "m1", "A", "A", [math.log(0.6), math.log(0.4)]),
            (1, "m2", "A", "B", [float("nan"), 0.0]),
            (2, "m1", "B", "B", [math.log(0.5), math.log(0.5)]),
            (2, "m2", "B", None, [math.log(0.9), math.log(0.1)])]
    df = spark.createDataFrame(rows, "question_index long, model string, correct_answer string, response string, "
                                     "clls array<double>")
    d = {r[0]: r[1] for r in S.llm_difficulty(df).collect()}
    assert abs(d[1] - 0.4) < 1e-12 and abs(d[2] - 0.7) < 1e-12
    d2 = {r[0]: r[1] for r in S.llm_difficulty(df, require_all_models=True).collect()}
    assert d2[1] is None
    e = {r["model"]: r for r in S.expected_accuracy_by_model(df).collect()}
    assert abs(e["m2"]["expected_correct"] - 0.1) < 1e-12 and abs(e["m2"]["expected_accuracy"] - 0.05) < 1e-12
    a = {r["model"]: r for r in S.accuracy_by_model(df).collect()}
    assert a["m2"]["n_correct"] == 0 and a["m1"]["n_correct"] == 2


def test_difficulty_correlation_counts_the_pairs(spark):
    rows = [(i, "m", "A", [-0.1 * (i % 7), -2.0], float(i) if i % 3 else None, float(i * i) if i % 2 else None, None) for i in range(30)]
    df = spark.createDataFrame(rows, "question_index long, model string, correct_answer string, clls array<double>, IOD double, MD double, h double")
    df = df.withColumns({f"%{x}": df["h"] for x in "ABCDE"}).withColumn("Answer", df["correct_answer"])
    got = {r["metric"]: r for r in St.difficulty_correlations(df, with_p=True).collect()}
    assert {m: r["n"] for m, r in got.items()} == {"IOD": 20, "DI": 15, "Human": 0}
    assert abs(got["IOD"]["pvalue"] - float(St.pearson_pvalue(got["IOD"]["r"], 20))) < 1e-12 and got["Human"]["r"] is None


def test_join_on_text_duplicates(spark):
    from quizspark.operators.joins import join_on_text
    r = spark.createDataFrame([("t1", "A"), ("t1", "B"), ("t2", "C")], "question string, response string")
    q = spark.createDataFrame([(5, "t1"), (3, "t1"), (9, "t2")], "question_index long, question string")
    every = sorted((x["question_index"], x["response"]) for x in join_on_text(r, q, duplicates="all").collect())
    assert every == [(3, "A"), (5, "A"), (9, "C")]   # no question is lost, one response each
    models = r.withColumn("model", r["response"])
    assert join_on_text(models, q, duplicates="all").count() == 5
    assert join_on_text(r, q, duplicates="multiply").count() == 5


def test_join_on_text_counts_lose_no_response(spark):
    """Copies answered differently: each copy gets every answer, and the counts
    are those of the plain merge."""
    from collections import Counter
    from quizspark.operators.joins import join_on_text
    given = [("t1", "m1", "ABCDE"[i % 5]) for i in range(40)] + [("t1", "m2", "C")] * 3 + [("t2", "m1", None)] * 2 + [(None, "m1", "A"), ("t3", "m1", "A")]
    r = spark.createDataFrame(given, "question string, model string, response string")
    q = spark.createDataFrame([(5, "t1"), (3, "t1"), (9, "t2"), (1, None), (2, "t4")], "question_index long, question string")
    for null_safe in (False, True):
        got = join_on_text(r, q, null_safe=null_safe, duplicates="count").select("question_index", "model", "response", "n_responses").collect()
        merged = join_on_text(r, q, null_safe=null_safe, duplicates="multiply").select("question_index", "model", "response").collect()
        assert {tuple(x)[:3]: x["n_responses"] for x in got} == Counter(tuple(x) for x in merged)
        assert len(got) == 2 * 6 + 1 + null_safe
    with pytest.raises(ValueError, match="n_responses"):
        join_on_text(r.withColumn("n_responses", r["model"]), q, duplicates="count")


def test_join_on_text_warns_on_zero_matches(spark):
    import warnings
    from quizspark.operators.joins import join_on_text
    r = spark.createDataFrame([("rendered A",)], "question string")
    q = spark.createDataFrame([(1, "rendered B")], "question_index long, question string")
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert join_on_text(r, q, warn_if_empty=True).count() == 0
    assert any("matched no question" in str(x.message) for x in w)


def _answers(spark, rows):
    return spark.createDataFrame(rows, "question_index long, model string, correct_answer string, response string, clls array<double>, "
                                       "Category string, IOD double, MD double, Answer string, `%A` double, `%B` double, `%C` double, `%D` double, `%E` double")


def _row(q, model, p, category="c", ok=True):
    return (q, model, "A", "A" if ok else "B", [math.log(p)] + [-9.0] * 4, category, float(q % 3), float(q % 5), "A", 10.0 + q, 0.0, 0.0, 0.0, 0.0)


def test_pairs_use_questions_both_answered(spark):
    rows = [_row(q, "a", 0.1 + 0.02 * q) for q in range(30)] + [_row(q, "b", 0.2 + 0.02 * q) for q in range(0, 30, 3)] \
        + [_row(q, "flat", 0.5) for q in range(30)]
    got = {(r["m1"], r["m2"]): r for r in St.pairwise_correlations(_answers(spark, rows), ["a", "b", "flat", "none"]).collect()}
    assert len(got) == 16 and got["a", "b"]["n"] == 10 and abs(got["a", "b"]["r"] - 1) < 1e-9
    assert got["a", "flat"]["r"] is None and got["a", "none"]["n"] == 0 and got["none", "none"]["r"] is None
    assert {r["r"] for r in St.difficulty_correlations(_answers(spark, rows)).where("model = 'flat'").collect()} == {None}


def test_saturated_and_empty_inputs(spark):
    one = _answers(spark, [_row(0, "m", 1.0), _row(1, "m", 1.0), _row(2, "m", 0.5, ok=False), _row(3, "k", 0.4)])
    got = {r["model"]: r for r in St.calibration(one).collect()}
    assert got["m"]["slope"] is None and got["m"]["se"] is None and got["k"]["slope"] is None
    empty = one.where("false")
    assert St.shuffle_agreement(empty, empty).first()["diagonal_share"] is None
    assert St.calibration(empty).count() == 0


def test_null_and_all_categories_keep_their_rows(spark):
    from quizspark.operators import scoring as S
    df = _answers(spark, [_row(0, "m", 0.5, "All"), _row(1, "m", 0.5, None, ok=False), _row(2, "m", 0.5, "x"), _row(3, "m", 0.5, "x", ok=False)])
    rows = S.category_metric_table(df, df, ["m", "absent"], "raw", with_human=True).collect()
    assert sorted((r["Category"] or "", r["Count"], r["m"]) for r in rows) == [("", 1, 0.0), ("All", 1, 1.0), ("All", 4, 0.5), ("x", 2, 0.5)]
    assert all(r["absent"] is None for r in rows)


def test_t_tail_against_known_values():
    for r, n, p in ((0.5, 10, 0.14111328125), (0.0, 5, 1.0), (0.9, 3, 1 - 2 * math.asin(0.9) / math.pi)):
        assert abs(float(St.pearson_pvalue(r, n)) - p) < 1e-9
    assert float(St.pearson_pvalue(1.0, 10)) == 0.0 and math.isnan(float(St.pearson_pvalue(0.3, 2)))


def test_regression_says_when_it_does_not_settle(spark):
    rows = [(f"w{i} " * (1 + i % 7), "m", "A", [math.log(0.05 + 0.1 * (i % 7))] + [-9.0] * 4) for i in range(70)]
    df = spark.createDataFrame(rows, "question string, model string, correct_answer string, clls array<double>")
    assert St.length_regression(df).count() == 1
    with pytest.raises(RuntimeError):
        St.length_regression(df, max_iter=1)


def test_training_table_with_gapped_keys(spark, tmp_path):
    from quizspark.operators.joins import training_table
    from quizspark.sources import readers as R, writers as W
    q = spark.createDataFrame([(k, f"p{k}") for k in (0, 1, 10, 20)], "question_index long, prompt string")
    d = spark.createDataFrame([(0, 0.5), (1, 0.9), (10, 0.1), (20, 0.2)], "question_index long, llm_difficulty double")
    c = spark.createDataFrame([("p0", 1)], "prompt string, cluster_label int")
    W.write_difficulty(d, str(tmp_path / "d"))
    back = R.read_difficulty(spark, str(tmp_path / "d"))
    for table in (back, back.drop("question_index")):
        got = {r["question_index"]: r["llm_difficulty"] for r in training_table(q, table, c).collect()}
        assert got == {0: 0.5, 1: 0.9, 10: 0.1, 20: 0.2}


def test_limit_finds_the_bound_by_ranges(spark):
    from quizspark.operators.filters import limit_questions
    keys = [None, None] + [k * k for k in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "question_index long")
    for n in (1, 2, 3, 250, 501, 502, 10_000):
        got = sorted((r[0] is not None, r[0] or 0) for r in limit_questions(df, n, slots=4, last=5).collect())
        assert got == sorted((k is not None, k or 0) for k in keys)[:n]


def test_positions_over_many_partitions(spark):
    from quizspark.operators.position import global_position, release_positions
    df = spark.range(3000).selectExpr("(id * 7919) % 3001 as k")
    got = [r["k"] for r in global_position(df, ["k"], n_partitions=600).orderBy("position").collect()]
    assert got == sorted(got) and len(got) == 3000
    release_positions()


def test_oracle_needs_no_files_beside_pyspark(monkeypatch):
    import pyspark
    from quizspark.plans import oracle
    monkeypatch.setattr(pyspark, "__file__", "/nowhere/pyspark.zip/pyspark/__init__.py")
    assert all(isinstance(v, str) for v in oracle.oracle_sql().values())


def test_p_columns_equal_the_helpers(spark):
    rows = [(r, n) for r in (0.0, 1e-6, -0.01, 0.05, -0.3, 0.8, 0.999, -1.0, 1.0) for n in (3, 4, 5, 12, 250, 40_000, 3_000_000)]
    got = spark.createDataFrame(rows, "r double, n long").select("r", "n", St.pearson_p(F.col("r"), F.col("n")).alias("p")).collect()
    for x in got:
        assert abs(x.p - float(St.pearson_pvalue(x.r, x.n))) < 1e-10, (x.r, x.n)
    z = [0.0, 1e-9, 0.1, -1.959963985, 3.0, 8.0, -25.0, 37.0, 500.0, 1e9]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", St.normal_p(F.col("z")).alias("p")).collect()
    for x in got:
        want = math.erfc(abs(x.z) / math.sqrt(2))
        assert abs(x.p - want) <= 1e-10 * want + 1e-300, x.z
    odd = spark.createDataFrame([(None, 9), (float("nan"), 9), (0.3, 2), (0.3, None)], "r double, n long")
    assert all(x.p is None and x.q is None for x in odd.select(St.pearson_p(F.col("r"), F.col("n")).alias("p"),
                                                              St.normal_p(F.when(F.col("n") != 2, F.lit(None)).otherwise(F.lit(None))).alias("q")).collect())


def _scores(spark, models, questions, seed=5):
    """(question_index, model, _p): gaps, a constant model, a model alone."""
    rng = np.random.default_rng(seed)
    base = rng.random(questions)
    rows = []
    for m in range(models):
        for q in range(questions):
            if m == 1:
                rows.append((q, "m1", 0.25))
            elif m == 2 and q >= 2:
                continue
            elif rng.random() < 0.8:
                rows.append((q, f"m{m}", float(0.5 * base[q] + 0.5 * rng.random())))
    return spark.createDataFrame(rows, "question_index long, model string, _p double")


def test_gram_correlations_equal_pandas(spark):
    df = _scores(spark, 20, 120)
    models = [f"m{i}" for i in range(20)] + ["never seen"]
    got = {(r.m1, r.m2): r for r in St._gram_correlations(df, models, ["question_index"]).collect()}
    assert set(got) == {(a, b) for a in models for b in models}
    wide = df.toPandas().pivot(index="question_index", columns="model", values="_p")
    for a in models:
        for b in models:
            if "never seen" in (a, b):
                assert got[a, b].n == 0 and got[a, b].r is None
                continue
            both = wide[[a]].notna().to_numpy()[:, 0] & wide[[b]].notna().to_numpy()[:, 0]
            x, y = wide[a].to_numpy()[both], wide[b].to_numpy()[both]
            assert got[a, b].n == both.sum()
            if both.sum() < 2 or "m1" in (a, b):
                assert got[a, b].r is None
            else:
                assert abs(got[a, b].r - np.corrcoef(x, y)[0, 1]) < 1e-9


def test_many_models_by_gram_matrices(spark):
    """400 models: the plan does not grow, and both ways agree on the first."""
    few = [f"m{i}" for i in range(3, 9)]
    many = [f"m{i}" for i in range(400)]
    rows = [(q, m, ["A", "B"][q % 2], [math.log(0.05 + 0.9 * ((q * 31 + i * 17 + q * i) % 97) / 100)] * 5)
            for q in range(40) for i, m in enumerate(many)]
    resp = spark.createDataFrame(rows, "question_index long, model string, correct_answer string, clls array<double>")
    wide = St.pairwise_correlations(resp, many, with_p=True)
    assert len(wide._jdf.queryExecution().optimizedPlan().toString()) < 400_000
    got = {(r.m1, r.m2): r for r in wide.where(F.col("m1").isin(few) & F.col("m2").isin(few)).collect()}
    want = St.pairwise_correlations(resp, few, with_p=True).collect()
    assert len(want) == 36 == len(got)
    for w in want:
        assert abs(w.r - got[w.m1, w.m2].r) < 1e-9 and w.n == got[w.m1, w.m2].n == 40
        assert abs(w.pvalue - got[w.m1, w.m2].pvalue) < 1e-9 or abs(w.r) > 1 - 1e-9


def test_responses_and_questions_are_never_broadcast(spark, tmp_path):
    """A side of a few bytes a row on disk unfolds into wide rows in memory."""
    from quizspark.operators.joins import join_on_index
    spark.range(2000).select(F.col("id").alias("question_index")).write.parquet(str(tmp_path / "q"))
    q = spark.read.parquet(str(tmp_path / "q"))
    r = q.select("question_index", F.explode(F.array(F.lit("m1"), F.lit("m2"))).alias("model"))
    joined = join_on_index(r, q.withColumn("Answer", F.lit("A")))
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 4000
