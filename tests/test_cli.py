"""Command line smoke tests (difficulty and order)."""
import json

from quizspark.__main__ import main
from quizspark.sources import readers as R


def test_cli_difficulty_and_order(spark, tmp_path):
    src = tmp_path / "resp"
    src.mkdir()
    for m, shift in [("mA", 0.0), ("mB", 0.5)]:
        qs = [{"question": f"q{i}", "correct_answer": "A", "question_index": i, "shuffle": [0, 1, 2, 3, 4],
               "response": "A", "top3": ["A"], "clls": [-0.2 - shift - i / 100, -2.0, -3.0, -4.0, -5.0]}
              for i in range(30)]
        (src / f"{m}_toy.json").write_text(json.dumps({"questions": qs}))
    main(["difficulty", "--responses", str(src), "--out", str(tmp_path / "diff")])
    d = R.read_difficulty(spark, str(tmp_path / "diff"))
    assert d.count() == 30
    train = tmp_path / "train.csv"
    lines = [",prompt,A,B,C,D,E,Answer,cluster_label,llm_difficulty"]
    lines += [f"{i},p{i},a,b,c,d,e,A,{i % 3},{(i * 7 % 30) / 30}" for i in range(30)]
    train.write_text("\n".join(lines) + "\n")
    main(["order", "--train", str(train), "--out", str(tmp_path / "orders"), "--dataset", "toy",
          "--orderings", "blocked,interleaved"])
    o = spark.read.parquet(str(tmp_path / "orders"))
    assert o.where("ordering = 'interleaved'").count() == 30
