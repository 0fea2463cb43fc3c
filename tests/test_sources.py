"""Round trips through readers and writers."""
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from quizspark.operators.ordering import OrderingSpec, order_blocked
from quizspark.schema import require_columns
from quizspark.sources import readers as R
from quizspark.sources import writers as W


def _qa(i, ans, resp, clls):
    return {"question": f"q{i}", "correct_answer": ans, "question_index": i, "shuffle": [0, 1, 2, 3, 4],
            "response": resp, "top3": [resp, "B", "C"], "clls": clls}


def test_read_responses_json_with_nan(spark, tmp_path):
    docs = {"Llama-2-7b-chat-hf_medqa.json": [_qa(0, "A", "A", [-0.1, -2.0, -3.0, -4.0, -5.0]),
                                              _qa(1, "B", "A", [-0.5, float("nan"), float("-inf"), -4.0, -5.0])],
            "med42-70b_randomized_medqa.json": [_qa(0, "C", "C", [-1.0, -2.0, -0.2, -4.0, -5.0])]}
    for name, qs in docs.items():
        (tmp_path / name).write_text(json.dumps({"questions": qs}, indent=4))
    df = R.read_responses(spark, str(tmp_path))
    rows = {(r["model"], r["pos"]): r for r in df.collect()}
    assert set(rows) == {("Llama-2-7b-chat-hf", 0), ("Llama-2-7b-chat-hf", 1), ("med42-70b_randomized", 0)}
    assert all(r["dataset"] == "medqa" for r in rows.values())
    c = rows[("Llama-2-7b-chat-hf", 1)]["clls"]
    assert math.isnan(c[1]) and c[2] == float("-inf")
    out = str(tmp_path / "table")
    W.write_responses(df, out)
    back = spark.read.parquet(out)
    assert back.count() == 3 and set(back.columns) >= {"dataset", "model", "clls"}
    # dynamic overwrite: rewriting one model keeps the other
    W.write_responses(df.where(F.col("model") == "med42-70b_randomized"), out)
    assert spark.read.parquet(out).count() == 3


def test_read_questions_csv_unnamed_index(spark, tmp_path):
    p = tmp_path / "master.csv"
    p.write_text(',prompt,A,B,C,D,E,Answer,Category,IOD,MD,%A,%B,%C,%D,%E\n'
                 '0,"multi\nline ""quoted""",a,b,c,d,e,A,ID,0.5,0.1,10,20,30,20,20\n'
                 '1,plain,a,b,c,d,e,C,PD,0.7,,50,10,20,10,10\n')
    df = R.read_questions(spark, str(p))
    rows = df.orderBy("question_index").collect()
    assert rows[0]["question_index"] == 0 and rows[0]["prompt"] == 'multi\nline "quoted"'
    assert rows[1]["MD"] is None and rows[1]["%A"] == 50.0
    q = R.load_questions(spark, str(p), "csv", limit=1)
    assert [r["question_index"] for r in q.collect()] == [0]


def test_load_nested_and_flat(spark, tmp_path):
    nested = tmp_path / "nested.json"
    nested.write_text("\n".join(json.dumps({"question_index": i, "question": f"q{i}", "answer_idx": "B",
                                            "options": [{"key": k, "value": f"{k}{i}"} for k in "ABCDE"]})
                                for i in range(3)))
    n = R.load_questions(spark, str(nested), "nested").orderBy("question_index").collect()
    assert n[2]["E"] == "E2" and n[0]["Answer"] == "B" and n[1]["prompt"] == "q1"
    flat = tmp_path / "flat.json"
    flat.write_text("\n".join(json.dumps({"question_index": i, "question": f"q{i}", "opa": "w", "opb": "x",
                                          "opc": "y", "opd": "z", "cop": i % 4}) for i in range(4)))
    f = R.load_questions(spark, str(flat), "flat").orderBy("question_index").collect()
    assert [r["Answer"] for r in f] == ["A", "B", "C", "D"]


def test_write_difficulty_index_is_position(spark, tmp_path):
    d = spark.createDataFrame([(10, 0.3), (5, 0.9), (7, 0.1)], "question_index long, llm_difficulty double")
    W.write_difficulty(d, str(tmp_path / "diff"))
    back = R.read_difficulty(spark, str(tmp_path / "diff")).orderBy("Index").collect()
    assert [(r["Index"], r["llm_difficulty"]) for r in back] == [(0, 0.9), (1, 0.1), (2, 0.3)]


def test_write_ordering_partitions_and_order(spark, tmp_path):
    t = spark.createDataFrame([(i, i % 3, i / 100) for i in range(60)],
                              "question_index long, cluster_label int, llm_difficulty double")
    o = order_blocked(t, OrderingSpec())
    base = str(tmp_path / "orders")
    W.write_ordering(o, base, "train", "blocked")
    W.write_ordering(o, base, "train", "blocked_again")
    back = W.read_ordering(spark, base, "train", "blocked").collect()
    assert [r["position"] for r in back] == list(range(60))
    assert sorted(os.listdir(os.path.join(base, "dataset=train"))) == ["ordering=blocked", "ordering=blocked_again"]


def test_metrics_append_and_predictions(spark, tmp_path):
    m = spark.createDataFrame([(0.5, 0.4)], "Accuracy double, `F1 Score` double")
    W.append_metrics(m, str(tmp_path / "metrics"))
    W.append_metrics(m, str(tmp_path / "metrics"))
    back = spark.read.option("header", True).csv(str(tmp_path / "metrics"))
    assert back.count() == 2 and back.columns == ["Accuracy", "F1 Score"]
    p = spark.createDataFrame([(1, "A", "B")], "question_index long, Answer string, Prediction string")
    W.write_predictions(p, str(tmp_path / "pred"))
    W.write_predictions(p, str(tmp_path / "pred"))
    assert spark.read.option("header", True).csv(str(tmp_path / "pred")).count() == 1


def test_require_columns(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        require_columns(df, ["prompt"])


def test_response_file_names(spark, tmp_path):
    body = json.dumps({"questions": [{"question": "q", "question_index": 0}]})
    for name in ("alone", "my_model_med_qa", "m_x"):
        (tmp_path / f"{name}.json").write_text(body)
    got = {(r["model"], r["dataset"]) for r in R.read_responses(spark, str(tmp_path), datasets=("med_qa",)).collect()}
    assert got == {("alone", ""), ("my_model", "med_qa"), ("m", "x")}


def test_questions_without_an_index_get_their_row(spark, tmp_path):
    p = tmp_path / "train.csv"
    p.write_text("prompt,A,B,C,D,E,Answer,cluster_label,llm_difficulty\n" + "".join(f"q{i},a,b,c,d,e,A,ID,0.{i}\n" for i in range(1, 8)))
    df = R.read_questions(spark, str(p))
    assert sorted((r["question_index"], r["prompt"]) for r in df.collect()) == [(i - 1, f"q{i}") for i in range(1, 8)]


def test_load_questions_split_shuffle_and_dense_index(spark, tmp_path):
    for name, n in (("train", 30), ("test", 5)):
        body = [json.dumps({"question": f"{name} {i}", "opa": "a", "opb": "b", "opc": "c", "opd": "d", "cop": i % 4, "split": name}) for i in range(n)]
        (tmp_path / f"{name}.json").write_text("\n".join(body) + "\n")
    train = R.load_questions(spark, str(tmp_path / "{split}.json"), "flat", split="train", shuffle_seed=3)
    rows = sorted((r["question_index"], r["prompt"], sorted(r["shuffle"])) for r in train.collect())
    assert rows == [(i, f"train {i}", [0, 1, 2, 3]) for i in range(30)]
    assert len({tuple(r["shuffle"]) for r in train.collect()}) > 5
    both = R.load_questions(spark, str(tmp_path / "t*.json"), "flat")  # several files: positions without gaps
    assert sorted(r["question_index"] for r in both.collect()) == list(range(35))
    assert R.load_questions(spark, str(tmp_path / "t*.json"), "flat", split="test").count() == 5
    with pytest.raises(ValueError, match="split"):
        (tmp_path / "plain.json").write_text(json.dumps({"question": "q", "opa": "a", "opb": "b", "opc": "c", "opd": "d", "cop": 1}))
        R.load_questions(spark, str(tmp_path / "plain.json"), "flat", split="train")
