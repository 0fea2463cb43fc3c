"""Quality rules with risk-controlled thresholds.

Rules compare a statistic of the whole text with a cutoff; a document that any
rule rejects is dropped. The cutoffs are not guessed: for each stratum (band
of document length) and rule, every cutoff of a fixed grid is tested on the
labelled documents. A cutoff may be used only if the exact (Clopper-Pearson)
upper bound of its false rejection rate - good documents rejected over good
documents - is at most ``max_loss / number of rules``, at level
``error / number of tests`` (Bonferroni over all strata, rules and cutoffs).
Then, with probability 1 - error, all used cutoffs hold their limit together,
and a stratum loses at most ``max_loss`` of its good documents by all rules
together. Among the allowed cutoffs the one with the most labelled bad
documents rejected, less the good ones, is used (ties: the mildest); a stratum
without enough labels keeps its documents.

The labelled counts are one aggregate of fixed size (strata x rules x grid).

Defined results: null texts have no words; documents without words have all
statistics zero and fail the base rule (under 50 words); a document labelled
more than once is good only if all its labels are; null labels do not count;
repeated rows are judged row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizspark.llm.common import pieces

SYMBOLS = "#*$%&|<>"
#: Lower ends of the strata, in words.
BANDS = (50, 200, 600)
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long"
#: rule -> (statistic over which count, cutoffs from mild to strict); a document is rejected above the cutoff
RULES = {
    "symbols": ("n_symbols", "n_words", (2.0, 1.0, 0.5, 0.3, 0.15)),
    "repeats": ("n_repeat_words", "n_words", (0.45, 0.4, 0.35, 0.3, 0.25)),
    "upper": ("n_upper", "word_chars", (0.9, 0.7, 0.5, 0.3, 0.2)),
    "marks": ("n_marks", "n_words", (2.0, 1.5, 1.0, 0.7, 0.5)),
    "long_words": ("word_chars", "n_words", (20.0, 15.0, 12.0, 10.0)),
}


def _repeat_words(ids: np.ndarray) -> int:
    """Words that stand in a window of three found at least twice."""
    n = len(ids) - 2
    if n < 2:
        return 0
    m = int(ids.max()) + 1
    if m < 2_000_000:
        code = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
    else:  # two steps, so that codes stay below 2**63
        pair = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1].ravel()
        code = pair[:-1] * m + ids[2:]
    order = np.argsort(code, kind="stable")
    s = code[order]
    same = s[1:] == s[:-1]
    again = np.zeros(n, dtype=bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    covered = np.zeros(n + 2, dtype=bool)
    for i in range(3):
        covered[i:i + n] |= again
    return int(covered.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    text = text or ""
    number: dict[bytes, int] = {}
    ids, chars, marks = [], 0, 0
    for part in pieces(text):
        words = part.encode("utf-8", "surrogatepass").split()
        ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words)))
        chars += len(b"".join(words).decode("utf-8", "surrogatepass"))
        marks += part.count("!") + part.count("?")
    all_ids = np.concatenate(ids)
    seen, dup = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup += bool(line.encode("utf-8", "surrogatepass").split())
            else:
                seen.add(line)
    lower = text.lower()
    upper = 0 if text == lower else sum(1 for a in text if a.isupper())
    return (len(all_ids), chars, sum(text.count(c) for c in SYMBOLS), dup, _repeat_words(all_ids), upper, marks)


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of the whole text."""
    names = [c.split()[0] for c in _STATS.split(", ")]

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame([text_stats(t) for t in s], columns=names)
    stats = F.pandas_udf(run, _STATS)(F.col("text").cast("string"))
    return docs.select("doc_id", stats.alias("s")).select("doc_id", "s.*")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def band() -> Column:
    out = F.lit(0)
    for i, b in enumerate(BANDS[1:], 1):
        out = F.when(F.col("n_words") >= b, i).otherwise(out)
    return out


def _ratio(rule: str) -> Column:
    over, under, _ = RULES[rule]
    return F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under).cast("double")), F.lit(0.0))


def upper_bound_holds(k: int, n: int, limit: float, level: float) -> bool:
    """True if the Clopper-Pearson upper bound at ``level`` of k failures in n is
    at most ``limit``: P(Binomial(n, limit) <= k) <= level, exactly."""
    if n == 0 or not 0 < limit < 1:
        return False
    if k >= n * limit:  # the distribution's middle: the probability is near one half or more
        return False
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(limit) + (n - i) * math.log1p(-limit)
            for i in range(k + 1)]
    top = max(logs)
    return top + math.log(math.fsum(math.exp(x - top) for x in logs)) <= math.log(level)


def fit_cutoffs(stats: DataFrame, labels: DataFrame, max_loss: float = 0.05, error: float = 0.05) -> dict[tuple[int, str], float]:
    """(band, rule) -> cutoff, from the labelled documents that pass the base rule."""
    y = (labels.select("doc_id", F.col("quality").cast("int").alias("good")).where(F.col("good").isin(0, 1))
         .groupBy("doc_id").agg(F.min("good").alias("good")))
    rows = stats.where(~base_failed()).join(y, "doc_id").withColumn("band", band())
    tests = [(r, i, c) for r, (_, _, cuts) in RULES.items() for i, c in enumerate(cuts)]
    hit = [F.sum(F.when(_ratio(r) > c, 1 - g).otherwise(0)).alias(f"{kind}_{r}_{i}")
           for r, i, c in tests for kind, g in (("bad", F.col("good")), ("lost", 1 - F.col("good")))]
    found = rows.groupBy("band").agg(F.sum("good").alias("n_good"), *hit).collect()  # a row per band
    level = error / (len(BANDS) * len(tests))
    limit = max_loss / len(RULES)
    out: dict[tuple[int, str], float] = {}
    for row in found:
        for rule, (_, _, cuts) in RULES.items():
            best = 0
            for i, c in enumerate(cuts):
                lost, bad = row[f"lost_{rule}_{i}"], row[f"bad_{rule}_{i}"]
                if bad - lost > best and upper_bound_holds(lost, row["n_good"], limit, level):
                    best, out[row["band"], rule] = bad - lost, c
    return out


def judge(stats: DataFrame, cutoffs: dict[tuple[int, str], float]) -> DataFrame:
    """Adds base_failed and kept to the statistics."""
    rejected = F.lit(False)
    for (b, rule), cut in sorted(cutoffs.items()):
        rejected = rejected | ((band() == b) & (_ratio(rule) > cut))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)
