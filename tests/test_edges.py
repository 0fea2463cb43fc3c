"""Edge cases: empty inputs, NULL predictions, categories missing a model."""
import math

from pyspark.sql import functions as F

from quizspark.operators import ordering as O
from quizspark.operators import scoring as S
from quizspark.operators.position import global_position


def test_orderings_on_empty_input(spark):
    df = spark.createDataFrame([], "question_index long, cluster_label int, llm_difficulty double")
    for name in ["original", "blocked", "interleaved", "curriculum_emh"]:
        assert O.ORDERINGS[name](df, O.OrderingSpec()).count() == 0
    assert global_position(df, [F.col("question_index")]).count() == 0


def test_single_row_and_all_null_difficulty(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 0, float("nan"))],
                               "question_index long, cluster_label int, llm_difficulty double")
    assert O.order_curriculum_emh(df).count() == 0
    strict = O.order_curriculum_strict(df).orderBy("position").collect()
    assert [r["question_index"] for r in strict] == [1, 2]
    inter = O.order_interleaved(df.limit(1)).collect()
    assert [r["position"] for r in inter] == [0]


def test_eval_metrics_with_null_predictions(spark):
    df = spark.createDataFrame([("A", "A"), ("B", None), ("B", "B"), ("C", "A")], "Answer string, Prediction string")
    m = S.eval_metrics(df).first()
    assert abs(m["Accuracy"] - 0.5) < 1e-12
    # labels A: tp1 s1 p2 -> 2/3 ; B: tp1 s2 p1 -> 2/3 ; C: 0 ; weighted (1*2/3 + 2*2/3 + 0) / 4 = 0.5
    assert abs(m["F1 Score"] - 0.5) < 1e-12


def test_category_table_with_missing_model(spark):
    r = spark.createDataFrame([(1, "m1", "A", "A", [0.0, -1.0]), (2, "m2", "A", "B", [-1.0, 0.0])],
                              "question_index long, model string, correct_answer string, response string, "
                              "clls array<double>")
    q = spark.createDataFrame([(1, "X", "A"), (2, "Y", "A")], "question_index long, Category string, Answer string")
    from quizspark.operators.joins import join_on_index
    t = {x["Category"]: x for x in S.category_metric_table(join_on_index(r, q), q, ["m1", "m2"], "raw").collect()}
    assert t["X"]["m1"] == 1.0 and t["X"]["m2"] is None and t["Y"]["m2"] == 0.0
    assert t["All"]["Count"] == 2 and t["All"]["m1"] == 1.0


def test_histogram_constant_values(spark):
    d = spark.createDataFrame([(i, 0.5) for i in range(4)], "question_index long, llm_difficulty double")
    h = S.difficulty_histogram(d).orderBy("bin").collect()
    assert len(h) == 10 and sum(x["count"] for x in h) == 4
    assert math.isclose(h[0]["lo"], 0.0) and math.isclose(h[-1]["hi"], 1.0)
