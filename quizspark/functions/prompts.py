"""Prompt rendering, option shuffling and completion splitting.

All rendering is ``concat`` / ``format_string`` over columns; option
permutations are arrays of original indices built from a keyed hash (no
lambdas, no UDFs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizspark.functions.arrays import letter_index, letters_array
from quizspark.functions.text import word_count
from quizspark.schema import LETTERS

# Prompt texts that must equal the reference's byte for byte.
INSTRUCTION = "Answer the following multiple choice question by giving the most appropriate response."
BASELINE_HEAD = INSTRUCTION + " The answer should be one of {choices}. Question: "
SCORING_HEAD = INSTRUCTION + " The answer should be one of [A, B, C, D, E]. Question: "
TRAIN_HEAD_5 = INSTRUCTION + " Answer should be one among [A, B, C, D, E].\n\nQuestion: "
TRAIN_HEAD_4 = INSTRUCTION + " Answer should be one among [A, B, C, D].\n\nQuestion: "
ANSWER_MARK = "\n\n### Answer: "
COMPLETION_MARKER = "Answer:"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _py_list(letters) -> str:
    # how Python prints a list of strings: ['A', 'B', ...]
    return "[" + ", ".join(f"'{x}'" for x in letters) + "]"


def _text(c, missing: str) -> Column:
    """Value as Python would print it inside an f-string (NULL -> missing)."""
    return F.coalesce(_col(c).cast("string"), F.lit(missing))


def identity_shuffle(n: int = 5) -> Column:
    return F.array(*[F.lit(i) for i in range(n)])


def hash_shuffle(key="question_index", seed: int = 0, n: int = 5) -> Column:
    """Deterministic permutation of 0..n-1 per row: indices sorted by
    md5(seed:key:i). shuffle[slot] = original option shown in that slot."""
    k = _col(key).cast("string")
    pairs = F.array_sort(F.array(*[
        F.struct(F.md5(F.concat(F.lit(f"{seed}:"), k, F.lit(f":{i}"))).alias("h"), F.lit(i).alias("i"))
        for i in range(n)]))
    return F.array(*[F.get(pairs, s)["i"] for s in range(n)])


def baseline_prompt(prompt="prompt", options=None, shuffle: Column | None = None, letters=LETTERS) -> Column:
    """Response-generation prompt: choices printed as a Python list, options
    'A) x' joined by single spaces, in the shuffled slot order."""
    options = options or list(letters)
    values = F.array(*[_text(o, "nan") for o in options])
    shuffle = shuffle if shuffle is not None else identity_shuffle(len(letters))
    parts = [F.concat(F.lit(f"{x}) "), F.get(values, F.get(shuffle, s))) for s, x in enumerate(letters)]
    return F.concat(F.lit(BASELINE_HEAD.format(choices=_py_list(letters))), _text(prompt, "nan"),
                    F.lit(" "), F.concat_ws(" ", *parts))


def shuffled_answer(answer="Answer", shuffle: Column | None = None, letters=LETTERS) -> Column:
    """Letter of the slot that shows the right option."""
    shuffle = shuffle if shuffle is not None else identity_shuffle(len(letters))
    slot = F.array_position(shuffle, letter_index(answer, letters)) - 1
    return F.when(slot >= 0, F.get(letters_array(letters), slot.cast("int")))


def scoring_prompt(prompt="prompt", letters=LETTERS) -> Column:
    parts = [F.concat(F.lit(f" {x}) "), _text(x, "nan")) for x in letters]
    return F.concat(F.lit(SCORING_HEAD), _text(prompt, "nan"), *parts)


def train_prompt(df: DataFrame, fine_tune: bool = True, prompt="prompt", answer="Answer",
                 with_e: bool | None = None) -> Column:
    """Fine-tuning / test prompt; the 5-option template when column E
    exists, else the 4-option one; the answer is blank at test time."""
    with_e = ("E" in df.columns) if with_e is None else with_e
    letters = LETTERS if with_e else LETTERS[:4]
    head = TRAIN_HEAD_5 if with_e else TRAIN_HEAD_4
    opts = [F.concat(F.lit(f"\n{x}) "), _text(x, "None")) for x in letters]
    ans = _text(answer, "None") if fine_tune else F.lit("")
    return F.concat(F.lit(head), _text(prompt, "None"), *opts, F.lit(ANSWER_MARK), ans)


def completion_split(text="text", marker: str = COMPLETION_MARKER, max_words: int | None = None) -> dict:
    """Prompt part (through the last marker) and completion (after it): the
    training loss covers only the completion. Returns named columns."""
    t = _col(text)
    has = F.locate(marker, t) > 0
    completion = F.when(has, F.substring_index(t, marker, -1))
    prompt_part = F.when(has, F.substr(t, F.lit(1), F.length(t) - F.length(F.substring_index(t, marker, -1))))
    n_words = word_count(t)
    out = {"prompt_part": prompt_part, "completion": completion, "has_marker": has, "n_words": n_words}
    if max_words is not None:
        out["over_budget"] = n_words > max_words
    return out
