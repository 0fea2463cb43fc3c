"""Structured Streaming ingest of response documents."""
import json

from quizspark.streaming import responses as SR


def test_stream_ingest_and_running_accuracy(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for model, resp in [("mA", ["A", "B", "C"]), ("mB", ["A", "A", "A"])]:
        qs = [{"question": f"q{i}", "correct_answer": "A", "question_index": i, "shuffle": [0, 1, 2, 3, 4],
               "response": r, "top3": [r], "clls": [-0.1, -2.0, -3.0, -4.0, -5.0]} for i, r in enumerate(resp)]
        (src / f"{model}_toy.json").write_text(json.dumps({"questions": qs}))
    q = SR.ingest_responses(spark, str(src), str(tmp_path / "table"), str(tmp_path / "ck1"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 6
    q2 = SR.running_accuracy(spark, str(src), str(tmp_path / "ck2"), "acc_test")
    q2.awaitTermination(120)
    rows = {r["model"]: r for r in spark.sql("SELECT * FROM acc_test").collect()}
    assert rows["mA"]["n_correct"] == 1 and rows["mB"]["n_correct"] == 3 and rows["mB"]["n"] == 3


def test_stream_reads_file_names_like_the_batch_reader(spark, tmp_path):
    from quizspark.sources.readers import read_responses
    src = tmp_path / "in"
    src.mkdir()
    for name in ("alone", "my_model_med_qa", "m_x", "a b_y"):
        (src / f"{name}.json").write_text(json.dumps({"questions": [{"question": "q", "question_index": 0}]}))
    q = (SR.response_stream(spark, str(src), datasets=("med_qa",)).writeStream.format("memory").queryName("names")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    want = {(r["model"], r["dataset"]) for r in read_responses(spark, str(src), datasets=("med_qa",)).collect()}
    assert {(r["model"], r["dataset"]) for r in spark.sql("SELECT * FROM names").collect()} == want and ("my_model", "med_qa") in want


def test_running_accuracy_to_table(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    qs = [{"question": f"q{i}", "correct_answer": "A", "question_index": i, "shuffle": [0, 1, 2, 3, 4],
           "response": "A" if i % 2 else "B", "top3": ["A"], "clls": [-0.1, -2.0, -3.0, -4.0, -5.0]}
          for i in range(4)]
    (src / "mX_toy.json").write_text(json.dumps({"questions": qs}))
    q = SR.running_accuracy(spark, str(src), str(tmp_path / "ck"), table_path=str(tmp_path / "acc"))
    q.awaitTermination(120)
    row = spark.read.parquet(str(tmp_path / "acc")).first()
    assert row["model"] == "mX" and row["n"] == 4 and row["n_correct"] == 2
