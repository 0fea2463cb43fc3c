"""Statistics over responses: correlations with difficulty measures,
pairwise model correlations, best peer, length regression (grouped IRLS),
calibration (closed form), shuffle agreement.

The heavy part of each statistic is one grouped aggregate over the
responses; p-values are column expressions on the result rows (one row per
model or model pair).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizspark.functions.arrays import (
    argmax_letter, correct_flag, letter_index, letters_array, nan_to_null, nan_to_zero, p_correct,
)
from quizspark.functions.text import word_count
from quizspark.schema import LETTERS


# --- p-values: on the driver's rows, then as column expressions -------------

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(40)


def _t_tail(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t by Gauss-Legendre panels. With u = sqrt(df)
    tan(a) the density is proportional to cos(a)^(df - 1) on (-pi/2, pi/2)."""
    start = math.atan(abs(t) / math.sqrt(df))
    # beyond twelve widths the density has dropped by e^-72
    end = min(math.pi / 2, start + 12 / math.sqrt(df))
    log_front = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi)
    total, step = 0.0, (end - start) / 8
    for i in range(8):
        a = start + step * (i + (_NODES + 1) / 2)
        total += step / 2 * float(_WEIGHTS @ np.exp(log_front + (df - 1) * np.log(np.maximum(np.cos(a), 1e-300))))
    return min(1.0, 2 * total)


def pearson_pvalue(r, n):
    """Two-sided p of Pearson r with n pairs (t with n-2 df)."""
    def one(x: float, m: float) -> float:
        if not math.isfinite(x) or m <= 2:
            return math.nan
        if abs(x) >= 1:
            return 0.0
        return _t_tail(x * math.sqrt((m - 2) / (1 - x * x)), m - 2)
    return np.vectorize(one, otypes=[float])(np.asarray(r, dtype=float), np.asarray(n, dtype=float))


def normal_pvalue(z):
    """Two-sided p of a standard-normal statistic (Wald test)."""
    z = np.asarray(z, dtype=float)
    return np.vectorize(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if np.isfinite(v) else np.nan)(z)


#: 8 panels of 40 Gauss-Legendre nodes on (0, 1) with their weights
_GRID = [((i + (u + 1) / 2) / 8, w / 16) for i in range(8) for u, w in zip(_NODES.tolist(), _WEIGHTS.tolist())]


def _integral(f) -> Column:
    """Integral over (0, 1) of ``f``, a function from column to column."""
    # one literal each: an array of 320 literals takes the optimizer seconds
    nodes, weights = (F.split(F.lit(",".join(map(repr, v))), ",").cast("array<double>") for v in zip(*_GRID))
    return F.aggregate(F.zip_with(nodes, weights, lambda u, w: w * f(u)), F.lit(0.0), lambda total, x: total + x)


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided p of Pearson r with n pairs, inside the JVM: with t = sqrt(df)
    tan(a) the tail of Student's t is the share of cos(a)^(df - 1) beyond a.
    NULL without r or with two pairs or fewer."""
    r, df = r.cast("double"), n.cast("double") - 2
    start = F.asin(F.abs(r))                   # tan(a) = |r| / sqrt(1 - r^2)
    width = F.lit(12.0) / F.sqrt(df)           # the density has dropped by e^-72 there

    def mass(begin: Column) -> Column:
        length = F.least(F.lit(math.pi / 2) - begin, width)
        return length * _integral(lambda u: F.pow(F.cos(begin + length * u), df - 1))
    p = F.when(F.abs(r) >= 1, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(mass(start), mass(F.lit(0.0)))))
    return F.when(r.isNotNull() & ~F.isnan(r) & (df > 0), p)


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal statistic, inside the JVM: its density
    at z times the integral of exp(-z u - u^2 / 2). NULL without z; p of an
    infinite z is 0."""
    z = F.abs(z.cast("double"))
    length = F.least(F.lit(12.0), F.lit(40.0) / F.greatest(z, F.lit(1.0)))
    tail = length * _integral(lambda u: F.exp(-z * length * u - F.pow(length * u, F.lit(2.0)) / 2))
    p = F.lit(math.sqrt(2 / math.pi)) * F.exp(-z * z / 2) * tail
    return F.when(z.isNotNull() & ~F.isnan(z), F.when(z > 1e3, 0.0).otherwise(F.least(F.lit(1.0), p)))


def with_pearson_p(df: DataFrame, r: str = "r", n: str = "n", out: str = "pvalue") -> DataFrame:
    return df.withColumn(out, pearson_p(F.col(r), F.col(n)))


def with_normal_p(df: DataFrame, z: str = "z", out: str = "pvalue") -> DataFrame:
    return df.withColumn(out, normal_p(F.col(z)))


# --- correlations ----------------------------------------------------------

def human_share(letters=LETTERS) -> Column:
    """%<Answer>: share of humans choosing the right option."""
    return F.get(F.array(*[F.col(f"`%{x}`") for x in letters]), letter_index("Answer", letters))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r over the rows where both are present; NULL without variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def difficulty_correlations(joined: DataFrame, with_p: bool = False) -> DataFrame:
    """Pearson r per model between p_correct (NaN -> 0) and IOD, MD ('DI')
    and the human share of the right answer (Answer from the questions
    table), with the number of rows where both are present; one aggregate
    computes all three."""
    p = nan_to_zero(p_correct("clls", "correct_answer"))
    s = joined.select("model", p.alias("_p"), F.col("IOD").alias("_iod"), F.col("MD").alias("_md"),
                      human_share().alias("_h"))
    measures = {"IOD": F.col("_iod"), "DI": F.col("_md"), "Human": F.col("_h")}
    wide = s.groupBy("model").agg(*[F.struct(F.lit(m).alias("metric"), F.count(F.when(c.isNotNull() & F.col("_p").isNotNull(), 1)).alias("n"),
                                             safe_corr(c, F.col("_p")).alias("r")).alias(m) for m, c in measures.items()])
    out = wide.select("model", F.explode(F.array(*measures)).alias("e")).select("model", "e.n", "e.metric", "e.r")
    return with_pearson_p(out) if with_p else out


#: up to so many models each pair is an expression of one plan
_EXPRESSION_MODELS = 16


def pairwise_correlations(responses: DataFrame, models, keys=("question_index",), with_p: bool = False) -> DataFrame:
    """Full M x M Pearson matrix (self included, mirrored) of p_correct
    (NaN -> 0) across the questions that both models answered, with their
    number; NULL for a pair without variance (in the pair's own questions). Up
    to 16 models: one pivot (shuffle on the question key) and one aggregate
    with M(M+1)/2 ``corr`` expressions. Beyond, ``_gram_correlations``, whose
    plan does not grow with the models. No row pairs either way."""
    models = list(models)
    p = nan_to_zero(p_correct("clls", "correct_answer"))
    scores = responses.select(*keys, "model", p.alias("_p"))
    if len(models) > _EXPRESSION_MODELS:
        out = _gram_correlations(scores, models, list(keys))
        return with_pearson_p(out) if with_p else out
    wide = scores.groupBy(*keys).agg(*[F.max(F.when(F.col("model") == m, F.col("_p"))).alias(m) for m in models])
    rows = []
    aggs = []
    for i, a in enumerate(models):
        for b in models[i:]:
            x, y, name = F.col(f"`{a}`"), F.col(f"`{b}`"), f"_{len(aggs)}"
            aggs.append(F.struct(safe_corr(x, y).alias("r"), F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("n")).alias(name))
            for m1, m2 in {(a, b), (b, a)}:
                rows.append(F.struct(F.lit(m1).alias("m1"), F.lit(m2).alias("m2"), F.col(name)["r"].alias("r"), F.col(name)["n"].alias("n")))
    out = wide.agg(*aggs).select(F.explode(F.array(*rows)).alias("e")).select("e.*")
    return with_pearson_p(out) if with_p else out


def _gram_correlations(scores: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """Pairwise r and n from Gram matrices. Each question's scores (at most one
    a model) meet in one row; a task multiplies matrices of 2,000 questions x
    models, with a mask of the answers present, into the sums of x, xx, xy and
    the number of common questions, and returns one row per model pair, summed
    by Spark. A pair counts as without variance where what is left of xx after
    centring is below 1e-12 of it."""
    names = pa.array(models, pa.string())
    m = len(models)
    per_question = (scores.where(F.col("model").isin(models) & F.col("_p").isNotNull())
                    .groupBy(*keys, "model").agg(F.max("_p").alias("_p"))
                    .groupBy(*keys).agg(F.collect_list("model").alias("m"), F.collect_list("_p").alias("p")))

    def gram(batches):
        total = np.zeros((4, m, m))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                which, value = batch.column(0).slice(at, 2000), batch.column(1).slice(at, 2000)
                row = np.repeat(np.arange(len(which)), pc.list_value_length(which).to_numpy(zero_copy_only=False))
                col = pc.index_in(which.flatten(), names).to_numpy(zero_copy_only=False)
                x, there = np.zeros((len(which), m)), np.zeros((len(which), m))
                x[row, col], there[row, col] = value.flatten().to_numpy(zero_copy_only=False), 1.0
                total += there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x
        i, j = np.nonzero(np.triu(total[0]))
        for k in range(0, len(i), 10_000):
            a, b = i[k:k + 10_000], j[k:k + 10_000]
            n, sx, sxx, sxy = total
            yield pa.RecordBatch.from_pydict({"i": a, "j": b, "n": n[a, b].astype(np.int64), "x": sx[a, b], "y": sx[b, a],
                                              "xx": sxx[a, b], "yy": sxx[b, a], "xy": sxy[a, b]})

    sums = (per_question.select("m", "p").mapInArrow(gram, "i long, j long, n long, x double, y double, xx double, yy double, xy double")
            .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]))
    left = lambda s, ss: F.when(ss - s * s / F.col("n") > 1e-12 * ss, ss - s * s / F.col("n"))
    r = F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("n"),
                     F.sqrt(left(F.col("x"), F.col("xx"))) * F.sqrt(left(F.col("y"), F.col("yy"))))
    # every pair has a row, also one without a common question (n = 0)
    ids = scores.sparkSession.range(m * m).select(F.expr(f"id div {m}").alias("a"), (F.col("id") % m).alias("b"))
    name = lambda c: F.element_at(F.lit(models), (F.col(c) + 1).cast("int"))
    found = sums.select(F.col("i").alias("lo"), F.col("j").alias("hi"), r.alias("r"), "n")
    return (ids.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(found, ["lo", "hi"], "left")
            .select(name("a").alias("m1"), name("b").alias("m2"), "r", F.coalesce("n", F.lit(0)).alias("n")))


def best_peer(pairs: DataFrame) -> DataFrame:
    """Per model, the other model with the highest r (self excluded; ties to
    the later name)."""
    others = pairs.where(F.col("m1") != F.col("m2"))
    best = others.groupBy("m1").agg(F.max(F.struct("r", "m2")).alias("b"))
    return best.select(F.col("m1").alias("model"), F.col("b.m2").alias("best_peer"), F.col("b.r").alias("r"))


# --- regressions -----------------------------------------------------------

def calibration(responses: DataFrame, with_p: bool = False) -> DataFrame:
    """Logit of y = exp(max clls) (NaN -> 0) on correctness x (0/1) + const.
    With one binary regressor the fit is saturated: the MLE reproduces the
    group means, so slope = logit(p1) - logit(p0) and
    se^2 = 1/(n1 p1 (1-p1)) + 1/(n0 p0 (1-p0)) — one aggregate, no
    iterations. A group without rows, or with mean 0 or 1, has no finite
    estimate: its columns are NULL."""
    y = nan_to_zero(F.exp(F.array_max(F.array(*[nan_to_null(F.get("clls", i)) for i in range(5)]))))
    x = correct_flag("correct_answer", "response")
    g = responses.select("model", y.alias("_y"), x.alias("_x")).groupBy("model").agg(
        F.avg(F.when(F.col("_x"), F.col("_y"))).alias("p1"), F.count(F.when(F.col("_x"), 1)).alias("n1"),
        F.avg(F.when(~F.col("_x"), F.col("_y"))).alias("p0"), F.count(F.when(~F.col("_x"), 1)).alias("n0"))
    logit = lambda p: F.log(F.try_divide(F.when(p > 0, p), F.lit(1.0) - p))
    part = lambda n, p: F.try_divide(F.lit(1.0), F.col(n) * F.col(p) * (1 - F.col(p)))
    se = F.sqrt(part("n1", "p1") + part("n0", "p0"))
    out = g.select("model", logit(F.col("p0")).alias("intercept"),
                   (logit(F.col("p1")) - logit(F.col("p0"))).alias("slope"), se.alias("se"))
    out = out.withColumn("z", F.try_divide("slope", "se"))
    return with_normal_p(out) if with_p else out


def _per_model(coef: dict, idx: int) -> Column:
    """Coefficient ``idx`` of each model as a CASE expression (M tiny)."""
    expr = None
    for m, b in coef.items():
        expr = (F.when(F.col("model") == m, F.lit(float(b[idx]))) if expr is None
                else expr.when(F.col("model") == m, F.lit(float(b[idx]))))
    return expr


def length_regression(responses: DataFrame, text_col: str = "question", max_iter: int = 50, tol: float = 1e-10,
                      with_p: bool = True) -> DataFrame:
    """Logit of p_correct (fractional, NaN -> 0) on ln(word count) + const,
    per model, by grouped IRLS (Newton): each iteration is one
    ``groupBy(model)`` of five weighted sums with the current coefficients
    inlined as literals; the 2x2 solves run on the M coefficient rows, the
    only data collected. The responses are read once, into counts and sums of
    y per (model, word count); the steps run on that small persisted table.
    Raises if the steps do not settle."""
    spark = responses.sparkSession
    y = nan_to_zero(p_correct("clls", "correct_answer"))
    x = F.log(F.greatest(word_count(text_col), F.lit(1)).cast("double"))
    data = (responses.select("model", x.alias("x"), y.alias("y")).groupBy("model", "x")
            .agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("k")).persist(StorageLevel.MEMORY_AND_DISK))

    def sums(coef):
        if coef is None:
            eta = F.lit(0.0)
        else:
            eta = _per_model(coef, 0) + _per_model(coef, 1) * F.col("x")
        mu = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
        w = F.greatest(mu * (F.lit(1.0) - mu), F.lit(1e-12)) * F.col("k")
        wz = w * eta + F.col("y") - mu * F.col("k")
        rows = data.groupBy("model").agg(
            F.sum(w).alias("sw"), F.sum(w * F.col("x")).alias("swx"),
            F.sum(w * F.col("x") * F.col("x")).alias("swxx"), F.sum(wz).alias("swz"),
            F.sum(F.col("x") * wz).alias("swxz"), F.sum("k").alias("n")).collect()
        return {r["model"]: r for r in rows}

    coef, info = None, None
    for _ in range(max_iter):
        info = sums(coef)
        new, delta = {}, 0.0
        for m, r in info.items():
            a = np.array([[r["sw"], r["swx"]], [r["swx"], r["swxx"]]])
            try:
                b = np.linalg.solve(a, np.array([r["swz"], r["swxz"]]))
            except np.linalg.LinAlgError:
                b = np.array([np.nan, np.nan])
            old = np.zeros(2) if coef is None else np.array(coef[m])
            new[m] = (float(b[0]), float(b[1]))
            if np.all(np.isfinite(b)):
                delta = max(delta, float(np.max(np.abs(b - old))))
        coef = new
        if delta < tol:
            break
    else:
        data.unpersist()
        raise RuntimeError(f"length_regression: coefficients still move by {delta:.3g} after {max_iter} steps")
    info = sums(coef)  # information matrix at the estimate
    data.unpersist()
    rows = []
    for m, (b0, b1) in coef.items():
        r = info[m]
        det = r["sw"] * r["swxx"] - r["swx"] ** 2
        se = math.sqrt(r["sw"] / det) if det > 0 else float("nan")
        zval = b1 / se if se and np.isfinite(se) else float("nan")
        p = float(normal_pvalue(zval)) if with_p else None
        rows.append((m, b0, b1, se, zval, p, int(r["n"])))
    return spark.createDataFrame(rows, "model string, intercept double, slope double, se double, z double, "
                                       "pvalue double, n long")


# --- shuffle check ---------------------------------------------------------

def shuffle_agreement(base: DataFrame, unshuffled: DataFrame, key: str = "question_index") -> DataFrame:
    """2x2 agreement of correctness between a base run and an (un-shuffled)
    shuffled run over the same questions, and the diagonal share."""
    b = base.select(key, correct_flag("correct_answer", "response").alias("base_correct"))
    u = unshuffled.select(key, correct_flag("correct_answer", "response").alias("unrand_correct"))
    j = u.join(b, key)
    u_, b_ = F.col("unrand_correct"), F.col("base_correct")
    return j.agg(
        F.count(F.when(u_ & b_, 1)).alias("n_both_correct"),
        F.count(F.when(u_ & ~b_, 1)).alias("n_unrand_only"),
        F.count(F.when(~u_ & b_, 1)).alias("n_base_only"),
        F.count(F.when(~u_ & ~b_, 1)).alias("n_both_wrong"),
        F.try_divide(F.count(F.when(u_ == b_, 1)), F.count(F.lit(1))).alias("diagonal_share"))


def shuffle_responses(responses: DataFrame, shuffle: str = "shuffle", letters=LETTERS) -> DataFrame:
    """What a model run on shuffled options records: clls in slot order,
    response / top3 / correct_answer as slot letters (slot s shows original
    option shuffle[s])."""
    from quizspark.functions.arrays import top_k_letters
    n = len(letters)
    clls = F.array(*[F.get(F.col("clls"), F.get(F.col(shuffle), s)) for s in range(n)])
    slot_of = F.array_position(F.col(shuffle), letter_index("correct_answer", letters)) - 1
    r = responses.withColumn("clls", clls).withColumn(
        "correct_answer", F.when(slot_of >= 0, F.get(letters_array(letters), slot_of.cast("int"))))
    return r.withColumn("response", argmax_letter("clls", letters)).withColumn("top3", top_k_letters("clls", 3, letters))


def unshuffle_responses(responses: DataFrame, shuffle: str = "shuffle", letters=LETTERS) -> DataFrame:
    """Map a shuffled run back to original option letters: letter c becomes
    letters[shuffle[index(c)]]; clls[i] = shuffled clls[position of i]."""
    n = len(letters)
    la = letters_array(letters)

    def unmap(c):
        return F.get(la, F.get(F.col(shuffle), letter_index(c, letters)))

    clls = F.array(*[F.get(F.col("clls"), (F.array_position(F.col(shuffle), F.lit(i)) - 1).cast("int"))
                     for i in range(n)])
    top3 = F.array_compact(F.array(*[unmap(F.get(F.col("top3"), j)) for j in range(3)]))
    return responses.withColumns({"response": unmap(F.col("response")),
                                  "correct_answer": unmap(F.col("correct_answer")),
                                  "top3": top3, "clls": clls})
