"""Unit tests for column helpers on tiny inline frames."""
import math

from pyspark.sql import functions as F

from quizspark.functions import prompts as P
from quizspark.functions.arrays import (argmax_letter, correct_flag, letter_index, log_softmax, p_correct,
                                        sorted_desc, top_k_letters)
from quizspark.functions.text import format_stat, word_count


def test_letter_index_and_unknown(spark):
    df = spark.createDataFrame([("A",), ("E",), ("Z",), (None,)], "a string")
    got = [r[0] for r in df.select(letter_index("a")).collect()]
    assert got == [0, 4, None, None]


def test_p_correct_nan_and_ragged(spark):
    df = spark.createDataFrame([([math.log(0.5), math.log(0.25), math.log(0.25), float("-inf")], "B"),
                                ([float("nan"), 0.0, 0.0, 0.0, 0.0], "A"),
                                ([0.0, 0.0, 0.0, 0.0], "E"),
                                ([0.0], None)], "clls array<double>, correct_answer string")
    got = [r[0] for r in df.select(p_correct()).collect()]
    assert abs(got[0] - 0.25) < 1e-12
    assert math.isnan(got[1])
    assert got[2] is None and got[3] is None


def test_log_softmax_sums_to_one_and_keeps_length(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],), ([0.5, 0.5, 0.1, -3.0],)], "logits array<double>")
    rows = df.select(log_softmax("logits").alias("c")).collect()
    for r in rows:
        assert abs(sum(math.exp(x) for x in r["c"]) - 1.0) < 1e-12
    assert len(rows[1]["c"]) == 4


def test_argmax_and_top3_ties_to_lowest_letter(spark):
    df = spark.createDataFrame([([0.1, 0.3, 0.3, 0.2, 0.0],), ([float("nan"), 1.0, 1.0, 0.5, 0.5],),
                                ([0.0, 0.0, 0.0, 0.0],)], "clls array<double>")
    rows = df.select(argmax_letter("clls").alias("r"), top_k_letters("clls", 3).alias("t")).collect()
    assert rows[0]["r"] == "B" and rows[0]["t"] == ["B", "C", "D"]
    assert rows[1]["r"] == "B" and rows[1]["t"] == ["B", "C", "D"]
    assert rows[2]["r"] == "A" and rows[2]["t"] == ["A", "B", "C"]


def test_sorted_desc_nan_last(spark):
    df = spark.createDataFrame([([0.1, float("nan"), 0.5, 0.2, 0.3],)], "clls array<double>")
    assert df.select(sorted_desc("clls")).first()[0] == [0.5, 0.3, 0.2, 0.1, None]


def test_correct_flag_null_is_wrong(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("A", None), (None, None)], "correct_answer string, response string")
    assert [r[0] for r in df.select(correct_flag()).collect()] == [True, False, False, False]


def test_word_count_matches_python_split(spark):
    texts = ["", "  one ", "two  words\n", "tab\tsep\x0bvt\x1cfs", "nbsp word 　ideo", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(word_count("t")).collect()]
    assert got == [len(t.split()) if t is not None else 0 for t in texts]


def test_words_are_counted_without_a_pattern_and_once(spark):
    """A pattern made a list of all words, twice a row in the completion split."""
    odd = " \u00a0a\x1cb\u2003\U0001F600c\u200bd\u3000 \x85e\t"
    df = spark.createDataFrame([(odd,), (None,)], "text string")
    out = df.select(*[c.alias(n) for n, c in P.completion_split("text", max_words=3).items()])
    assert [(r["n_words"], r["over_budget"]) for r in out.collect()] == [(len(odd.split()), True), (0, False)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and plan.count("ArrowEvalPython") == 1
    assert out.schema["n_words"].dataType.simpleString() == "bigint"


def test_format_stat(spark):
    df = spark.createDataFrame([(0.1234, 0.01), (0.5, 0.2), (-0.126, 0.049)], "s double, p double")
    got = [r[0] for r in df.select(format_stat("s", "p")).collect()]
    assert got == ["0.12*", "0.50 ", "-0.13*"]


EXAMPLE = {"prompt": "Which of these metals is liquid at room temperature?", "A": "Mercury.", "B": "Iron.",
           "C": "Copper.", "D": "Tin.", "E": "Zinc.", "Answer": "A"}


def _python_train(ex, fine_tune):
    head = ("Answer the following multiple choice question by giving the most appropriate response. "
            "Answer should be one among [A, B, C, D, E].\n\n")
    return (head + f"Question: {ex['prompt']}\nA) {ex['A']}\nB) {ex['B']}\nC) {ex['C']}\nD) {ex['D']}\n"
            f"E) {ex['E']}\n\n### Answer: {ex['Answer'] if fine_tune else ''}")


def test_train_and_test_prompt_text(spark):
    df = spark.createDataFrame([EXAMPLE])
    assert df.select(P.train_prompt(df, True)).first()[0] == _python_train(EXAMPLE, True)
    assert df.select(P.train_prompt(df, False)).first()[0] == _python_train(EXAMPLE, False)
    four = df.drop("E")
    text = four.select(P.train_prompt(four, False)).first()[0]
    assert "[A, B, C, D]." in text and "E)" not in text


def test_baseline_prompt_and_shuffle_round_trip(spark):
    df = spark.createDataFrame([dict(EXAMPLE, question_index=7)])
    row = df.select(P.baseline_prompt().alias("q"), P.shuffled_answer().alias("a")).first()
    assert row["q"].startswith("Answer the following multiple choice question by giving the most appropriate "
                               "response. The answer should be one of ['A', 'B', 'C', 'D', 'E']. Question: Which")
    assert row["q"].endswith(" ".join(f"{x}) {EXAMPLE[x]}" for x in "ABCDE"))
    assert row["a"] == "A"
    s = df.withColumn("shuffle", P.hash_shuffle("question_index", 3))
    r = s.select("shuffle", P.baseline_prompt(shuffle=F.col("shuffle")).alias("q"),
                 P.shuffled_answer(shuffle=F.col("shuffle")).alias("a")).first()
    assert sorted(r["shuffle"]) == [0, 1, 2, 3, 4]
    slot = "ABCDE".index(r["a"])
    assert r["shuffle"][slot] == 0  # the right answer (A) sits in the answer's slot
    assert f"{r['a']}) {EXAMPLE['A']}" in r["q"]


def test_completion_split(spark):
    df = spark.createDataFrame([("x Answer: y ### Answer: B",), ("no marker",)], "text string")
    cols = P.completion_split("text", max_words=3)
    rows = df.select(*[c.alias(n) for n, c in cols.items()]).collect()
    assert rows[0]["completion"] == " B" and rows[0]["prompt_part"] == "x Answer: y ### Answer:"
    assert rows[0]["over_budget"] is True
    assert rows[1]["has_marker"] is False and rows[1]["completion"] is None


def test_response_file_name(spark):
    from quizspark.functions.text import response_file_name
    df = spark.createDataFrame([("epfl-llm/meditron-70b", "medqa"), ("plain", "x")], "model string, dataset string")
    assert [r[0] for r in df.select(response_file_name()).collect()] == ["meditron-70b_medqa.json", "plain_x.json"]
