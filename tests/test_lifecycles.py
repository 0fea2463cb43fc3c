"""End-to-end plans: difficulty file, curriculum files, evaluation outputs."""
from pyspark.sql import functions as F

from quizspark.operators.ordering import OrderingSpec
from quizspark.plans import inputs as I
from quizspark.plans import lifecycles as L
from quizspark.sources import fixtures as fx
from quizspark.sources import readers as R
from quizspark.sources import writers as W

from conftest import SF_SMALL


def test_difficulty_file(spark, tmp_path):
    out = str(tmp_path / "difficulty")
    L.difficulty_from_responses(I.responses(spark, SF_SMALL), out_path=out)
    back = R.read_difficulty(spark, out)
    n = I.questions(spark, SF_SMALL).count()
    assert back.count() == n
    assert [r["Index"] for r in back.orderBy("Index").collect()] == list(range(n))
    assert back.where((F.col("llm_difficulty") < 0) | (F.col("llm_difficulty") > 1)).count() == 0


def test_curriculum_files(spark, tmp_path):
    t = I.training(spark, SF_SMALL).select("question_index", "cluster_label", "llm_difficulty")
    base = str(tmp_path / "orders")
    L.write_curriculum(t, base, "train", OrderingSpec(), columns=["question_index"])
    for name in ["original", "interleaved_emh"]:
        pos = [r["position"] for r in W.read_ordering(spark, base, "train", name).collect()]
        assert pos == list(range(len(pos)))


def test_evaluate_outputs(spark, tmp_path):
    test = I.questions(spark, SF_SMALL).select("question_index", "Answer")
    attached, metrics = L.evaluate(test, fx.token_logprobs(spark, SF_SMALL), str(tmp_path / "pred"),
                                   str(tmp_path / "metrics"))
    m = metrics.first()
    assert 0 <= m["Accuracy"] <= 1 and 0 <= m["F1 Score"] <= 1
    assert spark.read.option("header", True).csv(str(tmp_path / "pred")).count() == test.count()


def test_score_report_tables(spark):
    q = I.master_questions(spark, SF_SMALL)
    tabs = L.score_report(I.responses(spark, SF_SMALL), q, I.MODELS)
    assert tabs["accuracy_by_category"].where(F.col("Category") == "All").count() == 1
    assert tabs["pairwise_corr"].count() == 16
