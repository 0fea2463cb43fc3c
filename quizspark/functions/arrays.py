"""Array / letter helpers for per-option scores.

Every helper builds plain Catalyst expressions over a *static* option count,
so they stay inside whole-stage codegen (no lambda functions, no UDFs).
Arrays shorter than ``n`` (4-option questions) are handled through ``get``,
which yields NULL outside the array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizspark.schema import LETTERS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def letters_array(letters=LETTERS) -> Column:
    return F.array(*[F.lit(x) for x in letters])


def letter_index(letter, letters=LETTERS) -> Column:
    """0-based index of a letter in ``letters``; NULL when unknown or NULL."""
    pos = F.array_position(letters_array(letters), _col(letter))
    return F.when(pos > 0, (pos - 1).cast("int"))


def option_value(arr, index) -> Column:
    """arr[index] (0-based) or NULL when out of range / NULL index."""
    return F.get(_col(arr), _col(index) if not isinstance(index, int) else F.lit(index))


def nan_to_null(c) -> Column:
    return F.nanvl(_col(c), F.lit(None).cast("double"))


def nan_to_zero(c) -> Column:
    return F.coalesce(nan_to_null(c), F.lit(0.0))


def exp_safe(c) -> Column:
    return F.exp(_col(c))


def p_correct(clls="clls", answer="correct_answer", letters=LETTERS) -> Column:
    """exp(clls[index of the correct letter]) — the model's probability of the
    right option. NaN stays NaN (callers choose skip or zero); an unknown
    letter gives NULL."""
    return F.exp(F.get(_col(clls), letter_index(answer, letters)))


def correct_flag(answer="correct_answer", response="response") -> Column:
    """answer == response, with NULL counted as wrong."""
    return F.coalesce(_col(answer) == _col(response), F.lit(False))


def log_softmax(logits="logits", n: int = 5) -> Column:
    """l_i - (max + ln sum exp(l_j - max)) over the first ``n`` elements,
    trimmed back to the input length (ragged arrays keep their size)."""
    arr = _col(logits)
    items = [F.get(arr, i) for i in range(n)]
    mx = F.greatest(*items)
    total = None
    for it in items:
        term = F.coalesce(F.exp(it - mx), F.lit(0.0))
        total = term if total is None else total + term
    lse = mx + F.log(total)
    return F.slice(F.array(*[it - lse for it in items]), 1, F.size(arr))


def with_log_softmax(df, logits: str = "logits", out: str = "clls", n: int = 5):
    """DataFrame form of :func:`log_softmax` computed in stages (max, then
    log-sum-exp, then the array): each stage is referenced several times by
    the next, so Catalyst keeps them as separate projections and the
    generated code stays small."""
    arr = F.col(logits)
    items = [F.get(arr, i) for i in range(n)]
    df = df.withColumn("_mx", F.greatest(*items))
    total = None
    for it in items:
        term = F.coalesce(F.exp(it - F.col("_mx")), F.lit(0.0))
        total = term if total is None else total + term
    df = df.withColumn("_lse", F.col("_mx") + F.log(total))
    return df.withColumn(out, F.slice(F.array(*[it - F.col("_lse") for it in items]), 1, F.size(arr))) \
        .drop("_mx", "_lse")


def _ranked(arr, n: int):
    # struct(score, -index): greatest/sort on it orders by score, ties to the
    # lowest index. NaN scores are treated as missing.
    return [F.struct(nan_to_null(F.get(arr, i)).alias("s"), F.lit(-i).alias("neg"))
            for i in range(n)]


def argmax_letter(clls="clls", letters=LETTERS) -> Column:
    arr = _col(clls)
    best = F.greatest(*_ranked(arr, len(letters)))
    return F.when(best["s"].isNotNull(), F.get(letters_array(letters), -best["neg"]))


def top_k_letters(clls="clls", k: int = 3, letters=LETTERS) -> Column:
    """Letters of the k highest scores, descending; ties to the lowest letter."""
    arr = _col(clls)
    ordered = F.sort_array(F.array(*_ranked(arr, len(letters))), asc=False)
    # one reference to ``ordered`` (a lambda), so the sort is not repeated
    # per pick in the generated code
    la = letters_array(letters)
    return F.transform(F.filter(F.slice(ordered, 1, k), lambda x: x["s"].isNotNull()),
                       lambda x: F.get(la, -x["neg"]))


def sorted_desc(clls="clls", n: int = 5) -> Column:
    """Scores sorted descending with NaN treated as missing (NULLs go last)."""
    arr = _col(clls)
    return F.sort_array(F.array(*[nan_to_null(F.get(arr, i)) for i in range(n)]), asc=False)
