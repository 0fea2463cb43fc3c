"""DuckDB SQL equivalents of the registered queries (the correctness
oracle). The fixture views of FIXTURES.md are inlined as CTEs; every
statement runs on the driver's pre-registered tables."""

from __future__ import annotations

from quizspark.functions.text import STOP_WORDS

_CTES = {
    "questions_v": """
SELECT o_orderkey AS question_index,
       concat('order ', o_orderstatus, ' ', cast(o_orderkey AS varchar)) AS prompt,
       o_orderpriority AS Category,
       substr('ABCDE', cast(o_orderkey % 5 AS int) + 1, 1) AS Answer,
       concat('a', cast(o_custkey % 7 AS varchar)) AS A,
       concat('b', cast(o_custkey % 11 AS varchar)) AS B,
       concat('c', cast(o_custkey % 13 AS varchar)) AS C,
       concat('d', cast(o_custkey % 17 AS varchar)) AS D,
       concat('e', cast(o_custkey % 19 AS varchar)) AS E,
       cast((o_orderkey * 7) % 1000 AS double) / 1000 AS IOD,
       cast((o_orderkey * 11 + o_custkey) % 1000 AS double) / 1000 AS MD
FROM orders""",
    "human_v": """
SELECT question_index, option, 100 * w / sum(w) OVER (PARTITION BY question_index) AS pct
FROM (SELECT q.question_index, o.option, cast((q.question_index * 13 + o.k * 29) % 97 + 1 AS double) AS w
      FROM questions_v q CROSS JOIN (VALUES ('A',0),('B',1),('C',2),('D',3),('E',4)) AS o(option, k)) t""",
    "logits_v": """
SELECT q.question_index, q.Category, q.prompt, q.Answer AS correct_answer, m.model, o.option, o.k,
       cast((q.question_index * 31 + m.mid * 17 + o.k * 7
             + CASE WHEN o.option = q.Answer THEN 40 ELSE 0 END) % 101 AS double) / 20 AS logit
FROM questions_v q
CROSS JOIN (VALUES ('m1',1),('m2',2),('m3',3),('m4',4)) AS m(model, mid)
CROSS JOIN (VALUES ('A',0),('B',1),('C',2),('D',3),('E',4)) AS o(option, k)""",
    "resp_long_v": """
SELECT question_index, Category, prompt, correct_answer, model, option, k,
       logit - (mx + ln(sum(exp(logit - mx)) OVER (PARTITION BY question_index, model))) AS cll
FROM (SELECT *, max(logit) OVER (PARTITION BY question_index, model) AS mx FROM logits_v) t""",
    "predictions_v": """
SELECT question_index, Category, model, correct_answer, option AS response
FROM (SELECT *, row_number() OVER (PARTITION BY question_index, model ORDER BY cll DESC, k) AS rn
      FROM resp_long_v) t
WHERE rn = 1""",
    "difficulty_v": """
SELECT question_index, Category, 1 - avg(exp(cll)) AS llm_difficulty
FROM resp_long_v WHERE option = correct_answer GROUP BY question_index, Category""",
    "token_logprobs_v": """
SELECT question_index, option, k, tok,
       CASE WHEN tok = 0 THEN NULL
            ELSE -cast((question_index * 5 + k * 23 + tok * 41) % 89 + 1 AS double) / 30 END AS logprob
FROM (SELECT q.question_index, o.option, o.k FROM questions_v q
      CROSS JOIN (VALUES ('A',0),('B',1),('C',2),('D',3),('E',4)) AS o(option, k)) x
CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5)) AS t(tok)""",
    "shuffle_v": """
SELECT question_index, o.k AS slot, cast((o.k + question_index) % 5 AS int) AS original
FROM questions_v CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS o(k)""",
    "prompts_v": """
SELECT doc_id AS question_index, text AS prompt, source AS Category, lang, n_chars FROM documents""",
    "clusters_v": """
SELECT vec_id, CASE WHEN vec_id % 17 = 0 THEN -1 ELSE label END AS cluster,
       CASE WHEN vec_id % 17 = 0 THEN cast(0 AS double) ELSE cast(vec_id % 100 AS double) / 100 END AS probability
FROM embeddings""",
    "training_v": """
SELECT q.question_index, q.prompt, q.Category, q.Answer, round(d.llm_difficulty, 12) AS llm_difficulty,
       ascii(substr(md5(q.prompt), 1, 1)) % 8 AS cluster_label
FROM questions_v q LEFT JOIN difficulty_v d ON d.question_index = q.question_index""",
    "levels_v": """
SELECT *, CASE WHEN llm_difficulty <= CAST(0.66 AS DOUBLE) THEN 0
               WHEN llm_difficulty <= CAST(0.80 AS DOUBLE) THEN 1
               WHEN llm_difficulty > CAST(0.80 AS DOUBLE) THEN 2 END AS lvl
FROM training_v""",
}

_ORDER = list(_CTES)


def with_views(body: str) -> str:
    """Prefix ``body`` with the fixture CTEs it references (transitively)."""
    needed: set[str] = set()

    def visit(text: str):
        for name in _ORDER:
            if name not in needed and name in text:
                needed.add(name)
                visit(_CTES[name])

    visit(body)
    ctes = [f"{n} AS ({_CTES[n]}\n)" for n in _ORDER if n in needed]
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


def _h(seed: int) -> str:
    return f"md5('{seed}:' || cast(question_index AS varchar))"


def _rollup_key(col: str = "Category") -> str:
    return f"CASE WHEN grouping({col}) = 1 THEN 'All' ELSE {col} END"


def _category_sql(metric: str) -> str:
    cols = []
    for m in ["m1", "m2", "m3", "m4"]:
        n = f"nullif(count(*) FILTER (WHERE model = '{m}'), 0)"
        raw = f"count(*) FILTER (WHERE model = '{m}' AND coalesce(correct_answer = response, false)) / {n}"
        exp_ = f"coalesce(sum(p) FILTER (WHERE model = '{m}'), 0) / {n}"
        val = {"raw": raw, "expected": exp_, "gap": f"({raw}) - ({exp_})"}[metric]
        cols.append(f"{val} AS {m}")
    human = """,
hum AS (SELECT {key} AS Category, coalesce(sum(h.pct / 100), 0) / count(*) AS Human
        FROM questions_v q LEFT JOIN human_v h ON h.question_index = q.question_index AND h.option = q.Answer
        GROUP BY ROLLUP (q.Category))""".format(key=_rollup_key("q.Category"))
    sel_h = ", round(hum.Human, 9) AS Human" if metric != "gap" else ""
    join_h = " LEFT JOIN hum ON hum.Category = cnt.Category" if metric != "gap" else ""
    cnt_col = ", cnt.Count" if metric != "gap" else ""
    return f"""
, scored AS (SELECT p.question_index, p.model, p.correct_answer, p.response, q.Category, exp(l.cll) AS p
             FROM predictions_v p JOIN questions_v q ON q.question_index = p.question_index
             JOIN resp_long_v l ON l.question_index = p.question_index AND l.model = p.model AND l.option = l.correct_answer),
acc AS (SELECT {_rollup_key()} AS Category, {", ".join(cols)} FROM scored GROUP BY ROLLUP (Category)),
cnt AS (SELECT {_rollup_key()} AS Category, count(*) AS Count FROM questions_v GROUP BY ROLLUP (Category)){human if metric != "gap" else ""}
SELECT cnt.Category{cnt_col}, round(acc.m1, 9) AS m1, round(acc.m2, 9) AS m2, round(acc.m3, 9) AS m3,
       round(acc.m4, 9) AS m4{sel_h}
FROM cnt LEFT JOIN acc ON acc.Category = cnt.Category{join_h}"""


def _ordering_sql(source: str, where: str, order: str) -> str:
    return (f"SELECT question_index, row_number() OVER (ORDER BY {order}) - 1 AS position "
            f"FROM {source}" + (f" WHERE {where}" if where else ""))


def _interleaved_sql(order_in_block: str) -> str:
    return f"""
SELECT question_index, row_number() OVER (ORDER BY third, cluster_label, rnk) - 1 AS position
FROM (SELECT *, CASE WHEN rnk < n // 3 + CASE WHEN n % 3 > 0 THEN 1 ELSE 0 END THEN 0
                     WHEN rnk < 2 * (n // 3) + CASE WHEN n % 3 > 0 THEN 1 ELSE 0 END
                                + CASE WHEN n % 3 > 1 THEN 1 ELSE 0 END THEN 1
                     ELSE 2 END AS third
      FROM (SELECT *, row_number() OVER (PARTITION BY cluster_label ORDER BY {order_in_block}) - 1 AS rnk,
                   count(*) OVER (PARTITION BY cluster_label) AS n
            FROM training_v WHERE cluster_label IS NOT NULL) b) t"""


_ORDER_SQL = {
    "order_original": _ordering_sql("training_v", "", "question_index"),
    "order_random": _ordering_sql("training_v", "", f"{_h(42)}, question_index"),
    "order_curriculum_strict": _ordering_sql("training_v", "", "llm_difficulty ASC NULLS LAST, question_index"),
    "order_curriculum_emh": _ordering_sql("levels_v", "lvl IS NOT NULL", f"lvl, {_h(42)}, question_index"),
    "order_blocked": _ordering_sql("training_v", "cluster_label IS NOT NULL",
                                   f"cluster_label, {_h(1)}, question_index"),
    "order_blocked_strict": _ordering_sql("training_v", "cluster_label IS NOT NULL",
                                          "cluster_label, llm_difficulty ASC NULLS LAST, question_index"),
    "order_blocked_emh": _ordering_sql("levels_v", "cluster_label IS NOT NULL AND lvl IS NOT NULL",
                                       f"cluster_label, lvl, {_h(1)}, question_index"),
    "order_interleaved": _interleaved_sql(f"{_h(1)}, question_index"),
    "order_interleaved_strict": _interleaved_sql("llm_difficulty ASC NULLS LAST, question_index"),
    "order_interleaved_emh": _ordering_sql("levels_v", "cluster_label IS NOT NULL AND lvl IS NOT NULL",
                                           f"lvl, cluster_label, {_h(1)}, question_index"),
}

_ALL_NAMES = [("original", "order_original"), ("random_shuffle", "order_random"),
              ("curriculum_strict", "order_curriculum_strict"), ("curriculum_emh", "order_curriculum_emh"),
              ("blocked", "order_blocked"), ("blocked_curriculum_strict", "order_blocked_strict"),
              ("blocked_emh", "order_blocked_emh"), ("interleaved", "order_interleaved"),
              ("interleaved_curriculum_strict", "order_interleaved_strict"),
              ("interleaved_emh", "order_interleaved_emh")]

SQL: dict[str, str] = {
    "llm_difficulty": "SELECT question_index, Category, round(llm_difficulty, 9) AS llm_difficulty FROM difficulty_v",
    "expected_by_question": """
SELECT question_index, model, round(exp(cll), 9) AS p_correct FROM resp_long_v WHERE option = correct_answer""",
    "accuracy_by_model": """
SELECT model, count(*) FILTER (WHERE coalesce(correct_answer = response, false)) AS n_correct,
       round(count(*) FILTER (WHERE coalesce(correct_answer = response, false)) / count(*), 9) AS raw_accuracy
FROM predictions_v GROUP BY model""",
    "expected_accuracy_by_model": """
SELECT model, round(sum(exp(cll)), 9) AS expected_correct, round(sum(exp(cll)) / count(*), 9) AS expected_accuracy
FROM resp_long_v WHERE option = correct_answer GROUP BY model""",
    "model_means": """
SELECT model AS "column", round(avg(exp(cll)), 9) AS mean FROM resp_long_v WHERE option = correct_answer GROUP BY model
UNION ALL
SELECT 'mean_expected_accuracy', round(avg(mea), 9) FROM
  (SELECT question_index, avg(exp(cll)) AS mea FROM resp_long_v WHERE option = correct_answer GROUP BY question_index)
UNION ALL
SELECT 'llm_difficulty', round(avg(1 - mea), 9) FROM
  (SELECT question_index, avg(exp(cll)) AS mea FROM resp_long_v WHERE option = correct_answer GROUP BY question_index)""",
    "difficulty_histogram": """
, s AS (SELECT min(llm_difficulty) AS lo0, max(llm_difficulty) AS hi0 FROM difficulty_v),
e AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM s),
c AS (SELECT cast(least(9, floor((d.llm_difficulty - e.lo) * 10 / (e.hi - e.lo))) AS int) AS bin, count(*) AS cnt
      FROM difficulty_v d, e WHERE d.llm_difficulty IS NOT NULL GROUP BY 1)
SELECT cast(b.bin AS int) AS bin, round(e.lo + b.bin * ((e.hi - e.lo) / 10), 9) AS lo,
       round(e.lo + (b.bin + 1) * ((e.hi - e.lo) / 10), 9) AS hi, coalesce(c.cnt, 0) AS count
FROM (SELECT cast(range AS int) AS bin FROM range(10)) b CROSS JOIN e LEFT JOIN c ON c.bin = b.bin""",
    "accuracy_by_category": _category_sql("raw"),
    "expected_by_category": _category_sql("expected"),
    "accuracy_gap": _category_sql("gap"),
    "human_baseline": f"""
SELECT {_rollup_key("q.Category")} AS Category,
       round(coalesce(sum(h.pct / 100), 0), 9) AS n_correct,
       round(coalesce(sum(h.pct / 100), 0) / count(*), 9) AS raw_accuracy,
       round(coalesce(sum(h.pct / 100), 0), 9) AS expected_correct,
       round(coalesce(sum(h.pct / 100), 0) / count(*), 9) AS expected_accuracy
FROM questions_v q LEFT JOIN human_v h ON h.question_index = q.question_index AND h.option = q.Answer
GROUP BY ROLLUP (q.Category)""",
    "weight_distribution": """
, ranked AS (SELECT l.model, l.question_index, exp(l.cll) AS w,
                    row_number() OVER (PARTITION BY l.question_index, l.model ORDER BY l.cll DESC) AS rank,
                    coalesce(p.correct_answer = p.response, false) AS correct
             FROM resp_long_v l JOIN predictions_v p ON p.question_index = l.question_index AND p.model = l.model),
subs AS (SELECT 'all' AS subset, * FROM ranked
         UNION ALL SELECT 'correct', * FROM ranked WHERE correct
         UNION ALL SELECT 'incorrect', * FROM ranked WHERE NOT correct),
tot AS (SELECT subset, model, count(DISTINCT question_index) AS n FROM subs GROUP BY subset, model),
m AS (SELECT DISTINCT model FROM resp_long_v),
grid AS (SELECT m.model, s.subset, r.rank FROM m
         CROSS JOIN (VALUES ('all'), ('correct'), ('incorrect')) s(subset)
         CROSS JOIN (VALUES (1),(2),(3),(4),(5)) r(rank))
SELECT g.model, g.subset, cast(g.rank AS int) AS rank, round(sum(s.w) / max(t.n), 9) AS weight
FROM grid g LEFT JOIN subs s ON s.model = g.model AND s.subset = g.subset AND s.rank = g.rank
LEFT JOIN tot t ON t.model = g.model AND t.subset = g.subset
GROUP BY g.model, g.subset, g.rank""",
    "top3_options": """
SELECT question_index, model, max(option) FILTER (WHERE rn = 1) AS response,
       string_agg(option, ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS top3
FROM (SELECT *, row_number() OVER (PARTITION BY question_index, model ORDER BY cll DESC, k) AS rn FROM resp_long_v) t
GROUP BY question_index, model""",
    "choice_log_likelihood": """
SELECT question_index, model, option, round(cll, 9) AS cll FROM resp_long_v""",
    "join_on_index": """
SELECT p.question_index, p.model, q.Category, q.Answer, p.response
FROM predictions_v p JOIN questions_v q ON q.question_index = p.question_index""",
    "expected_by_model": """
SELECT question_index,
       round(max(exp(cll)) FILTER (WHERE model = 'm1'), 9) AS m1, round(max(exp(cll)) FILTER (WHERE model = 'm2'), 9) AS m2,
       round(max(exp(cll)) FILTER (WHERE model = 'm3'), 9) AS m3, round(max(exp(cll)) FILTER (WHERE model = 'm4'), 9) AS m4
FROM resp_long_v WHERE option = correct_answer GROUP BY question_index""",
    "training_table": """
SELECT question_index, prompt, Category, Answer, llm_difficulty, cluster_label FROM training_v""",
    "all_orderings": "\nUNION ALL\n".join(
        f"SELECT '{n}' AS ordering, question_index, position FROM ({_ORDER_SQL[k]})" for n, k in _ALL_NAMES),
    "difficulty_levels": """
SELECT question_index, CASE lvl WHEN 0 THEN 'E' WHEN 1 THEN 'M' WHEN 2 THEN 'H' END AS level FROM levels_v""",
    "split_three": """
SELECT question_index, cluster_label, third FROM (""" + _interleaved_sql(f"{_h(1)}, question_index").replace(
        "SELECT question_index, row_number() OVER (ORDER BY third, cluster_label, rnk) - 1 AS position",
        "SELECT question_index, cluster_label, cast(third AS int) AS third", 1) + ")",
    "batch_assignment": """
SELECT question_index, cast(floor((row_number() OVER (ORDER BY question_index) - 1) / 8) AS bigint) AS batch FROM training_v""",
    "step_plan": f"""
SELECT question_index, position, cast(floor(position / 8) AS bigint) AS step
FROM ({_ORDER_SQL["order_blocked"]})""",
}
SQL.update(_ORDER_SQL)


# --- batch 2: prompts, evaluation, filters, statistics ---------------------

def _lit(s: str) -> str:
    """SQL string literal; newlines become chr(10)."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted)


_INSTR = "Answer the following multiple choice question by giving the most appropriate response."
_BASE_HEAD = _INSTR + " The answer should be one of ['A', 'B', 'C', 'D', 'E']. Question: "
_SCORE_HEAD = _INSTR + " The answer should be one of [A, B, C, D, E]. Question: "
_TRAIN5 = _INSTR + " Answer should be one among [A, B, C, D, E].\n\nQuestion: "
_TRAIN4 = _INSTR + " Answer should be one among [A, B, C, D].\n\nQuestion: "
_OPT = "CASE i WHEN 0 THEN A WHEN 1 THEN B WHEN 2 THEN C WHEN 3 THEN D ELSE E END"
_LET = "substr('ABCDE', cast({x} AS int) + 1, 1)"
_IDX = "(strpos('ABCDE', {x}) - 1)"


def _train_sql(fine_tune: bool, five: bool) -> str:
    letters = "ABCDE" if five else "ABCD"
    opts = " || ".join(f"{_lit(chr(10) + x + ') ')} || {x}" for x in letters)
    ans = " || Answer" if fine_tune else ""
    return f"{_lit(_TRAIN5 if five else _TRAIN4)} || prompt || {opts} || {_lit(chr(10) + chr(10) + '### Answer: ')}{ans}"


_NLL = """
, nll AS (SELECT question_index, option, k, round(-avg(logprob), 12) AS v FROM token_logprobs_v GROUP BY question_index, option, k),
pick AS (SELECT question_index, max(option) FILTER (WHERE rn = 1) AS Prediction,
                cast(count(*) FILTER (WHERE v = vmin) AS int) AS n_tied
         FROM (SELECT *, row_number() OVER (PARTITION BY question_index ORDER BY v, k) AS rn,
                      min(v) OVER (PARTITION BY question_index) AS vmin FROM nll) t
         GROUP BY question_index),
att AS (SELECT q.question_index, q.Category, q.Answer, p.Prediction
        FROM questions_v q LEFT JOIN pick p ON p.question_index = q.question_index)"""

_UNSHUF = """
, slots AS (SELECT question_index, option, k, cll, correct_answer,
                   ((k - question_index) % 5 + 5) % 5 AS slot FROM resp_long_v WHERE model = 'm2'),
unr AS (SELECT question_index, max(correct_answer) AS correct_answer,
               max(option) FILTER (WHERE rn = 1) AS response,
               string_agg(option, ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS top3
        FROM (SELECT *, row_number() OVER (PARTITION BY question_index ORDER BY cll DESC, slot) AS rn FROM slots) t
        GROUP BY question_index)"""

_PAIRS = """
, pc AS (SELECT question_index, model, exp(cll) AS p FROM resp_long_v WHERE option = correct_answer),
pairs AS (SELECT a.model AS m1, b.model AS m2, corr(a.p, b.p) AS r, count(*) AS n
          FROM pc a JOIN pc b ON a.question_index = b.question_index GROUP BY a.model, b.model)"""

_SHUF_PERM = """
, perm AS (SELECT question_index, i,
                  row_number() OVER (PARTITION BY question_index
                                     ORDER BY md5('0:' || cast(question_index AS varchar) || ':' || cast(i AS varchar)), i) - 1 AS slot
           FROM questions_v CROSS JOIN (SELECT cast(range AS int) AS i FROM range(5)) r)"""

SQL.update({
    "format_baseline_prompt": f"""
SELECT question_index, {_lit(_BASE_HEAD)} || prompt || ' A) ' || A || ' B) ' || B || ' C) ' || C || ' D) ' || D || ' E) ' || E
       AS question, Answer AS answer FROM questions_v""",
    "shuffle_options": _SHUF_PERM + f"""
SELECT p.question_index,
       {_lit(_BASE_HEAD)} || max(q.prompt) || ' ' ||
         string_agg({_LET.format(x='p.slot')} || ') ' || ({_OPT.replace('i ', 'p.i ')}), ' ' ORDER BY p.slot) AS question,
       max({_LET.format(x='p.slot')}) FILTER (WHERE p.i = {_IDX.format(x='q.Answer')}) AS answer,
       string_agg(cast(p.i AS varchar), ',' ORDER BY p.slot) AS shuffle
FROM perm p JOIN questions_v q ON q.question_index = p.question_index
GROUP BY p.question_index""",
    "format_scoring_prompt": f"""
SELECT question_index, {_lit(_SCORE_HEAD)} || prompt || ' A) ' || A || ' B) ' || B || ' C) ' || C || ' D) ' || D || ' E) ' || E
       AS question FROM questions_v""",
    "format_train_prompt": f"SELECT question_index, {_train_sql(True, True)} AS text FROM questions_v",
    "format_test_prompt": f"SELECT question_index, {_train_sql(False, False)} AS text FROM questions_v",
    "format_train_prompt_4": f"SELECT question_index, {_train_sql(True, False)} AS text FROM questions_v",
    "format_test_prompt_5": f"SELECT question_index, {_train_sql(False, True)} AS text FROM questions_v",
    "completion_split": f"""
SELECT question_index, left(text, length(text) - length(string_split(text, 'Answer:')[-1])) AS prompt_part,
       string_split(text, 'Answer:')[-1] AS completion, strpos(text, 'Answer:') > 0 AS has_marker,
       cast(len(regexp_extract_all(text, '\\S+')) AS bigint) AS n_words,
       len(regexp_extract_all(text, '\\S+')) > 512 AS over_budget
FROM (SELECT question_index, {_train_sql(True, True)} AS text FROM questions_v) t""",
    "word_count": r"""
SELECT question_index, cast(len(regexp_extract_all(prompt, '\S+')) AS bigint) AS n_words FROM prompts_v""",
    "unshuffle_responses": _UNSHUF + "\nSELECT question_index, response, correct_answer, top3 FROM unr",
    "shuffle_agreement": _UNSHUF + """
, j AS (SELECT coalesce(u.response = u.correct_answer, false) AS uc, coalesce(b.response = b.correct_answer, false) AS bc
        FROM unr u JOIN predictions_v b ON b.question_index = u.question_index AND b.model = 'm1')
SELECT count(*) FILTER (WHERE uc AND bc) AS n_both_correct, count(*) FILTER (WHERE uc AND NOT bc) AS n_unrand_only,
       count(*) FILTER (WHERE NOT uc AND bc) AS n_base_only, count(*) FILTER (WHERE NOT uc AND NOT bc) AS n_both_wrong,
       round(count(*) FILTER (WHERE uc = bc) / count(*), 9) AS diagonal_share FROM j""",
    "option_perplexity": """
SELECT question_index, option, round(-avg(logprob), 9) AS mean_nll FROM token_logprobs_v GROUP BY question_index, option""",
    "min_perplexity_choice": _NLL + "\nSELECT question_index, Prediction, n_tied FROM pick",
    "attach_predictions": _NLL + "\nSELECT question_index, Category, Answer, Prediction FROM att",
    "eval_metrics": _NLL + """,
lab AS (SELECT Answer AS label, 1 AS is_true, 0 AS is_pred, CASE WHEN coalesce(Answer = Prediction, false) THEN 1 ELSE 0 END AS tp FROM att
        UNION ALL SELECT Prediction, 0, 1, 0 FROM att),
per AS (SELECT label, sum(is_true) AS s, sum(is_pred) AS p, sum(tp) AS tp FROM lab GROUP BY label)
SELECT round(sum(tp) / sum(s), 9) AS Accuracy,
       round(sum(s * CASE WHEN s + p > 0 THEN CAST(2 AS DOUBLE) * tp / (s + p) ELSE 0 END) / sum(s), 9) AS "F1 Score"
FROM per""",
    "category_filter": "SELECT question_index, model, response FROM predictions_v WHERE Category = '2-HIGH'",
    "correct_filter": "SELECT question_index, model FROM predictions_v WHERE coalesce(correct_answer = response, false)",
    "limit_questions": "SELECT question_index, prompt FROM questions_v ORDER BY question_index LIMIT 1000",
    "distinct_prompts": """
SELECT min(question_index) AS first_index, count(*) AS n_copies, md5(prompt) AS prompt_md5
FROM prompts_v WHERE prompt IS NOT NULL GROUP BY prompt""",
    "normalise_nested": "SELECT question_index, prompt, A, B, C, D, E, Answer FROM questions_v",
    "normalise_flat": """
SELECT question_index, prompt, A, B, C, D, substr('ABCD', cast(question_index % 4 AS int) + 1, 1) AS Answer FROM questions_v""",
    "difficulty_index": "SELECT cast(row_number() OVER (ORDER BY question_index) - 1 AS bigint) AS Index, "
                        "round(llm_difficulty, 9) AS llm_difficulty, question_index FROM difficulty_v",
    "incorrect_filter": "SELECT question_index, model FROM predictions_v "
                        "WHERE NOT coalesce(correct_answer = response, false)",
    "join_on_text": """SELECT q.doc_id AS question_index, r.model, r.response, r.n_responses FROM documents q JOIN (
    SELECT text, 'm' || cast(doc_id % 2 + 1 AS varchar) AS model, substr('ABCDE', cast(doc_id % 5 + 1 AS int), 1) AS response,
           count(*) AS n_responses
    FROM documents GROUP BY 1, 2, 3) r ON q.text = r.text""",
    "human_and_models": """
SELECT 'Human' AS name, round(coalesce(sum(h.pct / 100), 0), 9) AS n_correct,
       round(coalesce(sum(h.pct / 100), 0) / count(*), 9) AS raw_accuracy,
       round(coalesce(sum(h.pct / 100), 0), 9) AS expected_correct,
       round(coalesce(sum(h.pct / 100), 0) / count(*), 9) AS expected_accuracy
FROM questions_v q LEFT JOIN human_v h ON h.question_index = q.question_index AND h.option = q.Answer
UNION ALL
SELECT p.model, cast(count(*) FILTER (WHERE coalesce(p.correct_answer = p.response, false)) AS double),
       round(count(*) FILTER (WHERE coalesce(p.correct_answer = p.response, false)) / count(*), 9),
       round(sum(exp(l.cll)), 9), round(sum(exp(l.cll)) / count(*), 9)
FROM predictions_v p JOIN resp_long_v l ON l.question_index = p.question_index AND l.model = p.model
     AND l.option = l.correct_answer
GROUP BY p.model""",
    "context_cap": """
, reg AS (SELECT * FROM (VALUES ('Mistral_8x7B', 32768), ('Meditron_7B', 4096), ('Meditron_70B', 4096),
                                ('Llama_2_7B', 4096), ('Llama_2_13B', 4096), ('Llama_2_70B', 4096),
                                ('Gemma_7B', 8192), ('Jamba', 256000), ('DBRX', 32768)) AS r(model, context)),
mx AS (SELECT max(length(""" + f"{_lit(_BASE_HEAD)} || prompt || ' A) ' || A || ' B) ' || B || ' C) ' || C || ' D) ' || D || ' E) ' || E" + """)) AS m FROM questions_v)
SELECT reg.model, cast(reg.context AS bigint) AS context, cast(least(mx.m, reg.context) AS bigint) AS max_length
FROM reg CROSS JOIN mx""",
    "difficulty_corr": """
, j AS (SELECT l.model, exp(l.cll) AS p, q.IOD, q.MD, h.pct AS hp
        FROM resp_long_v l JOIN questions_v q ON q.question_index = l.question_index
        LEFT JOIN human_v h ON h.question_index = q.question_index AND h.option = q.Answer
        WHERE l.option = l.correct_answer),
c AS (SELECT model, count(IOD) AS n_iod, count(MD) AS n_di, count(hp) AS n_hum, corr(IOD, p) AS iod, corr(MD, p) AS di, corr(hp, p) AS hum
      FROM j GROUP BY model)
SELECT model, n_iod AS n, 'IOD' AS metric, round(iod, 9) AS r FROM c
UNION ALL SELECT model, n_di, 'DI', round(di, 9) FROM c
UNION ALL SELECT model, n_hum, 'Human', round(hum, 9) FROM c""",
    "pairwise_corr": _PAIRS + "\nSELECT m1, m2, round(r, 9) AS r, n FROM pairs",
    "best_peer": _PAIRS + """
SELECT m1 AS model, m2 AS best_peer, r FROM
  (SELECT m1, m2, round(r, 9) AS r, row_number() OVER (PARTITION BY m1 ORDER BY round(r, 9) DESC, m2 DESC) AS rn
   FROM pairs WHERE m1 <> m2) t WHERE rn = 1""",
    "calibration": """
, y AS (SELECT l.question_index, l.model, exp(max(l.cll)) AS y FROM resp_long_v l GROUP BY l.question_index, l.model),
g AS (SELECT y.model, avg(y.y) FILTER (WHERE c) AS p1, count(*) FILTER (WHERE c) AS n1,
             avg(y.y) FILTER (WHERE NOT c) AS p0, count(*) FILTER (WHERE NOT c) AS n0
      FROM y JOIN (SELECT question_index, model, coalesce(correct_answer = response, false) AS c FROM predictions_v) p
           ON p.question_index = y.question_index AND p.model = y.model
      GROUP BY y.model)
SELECT model, round(ln(p0 / (1 - p0)), 9) AS intercept, round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 9) AS slope,
       round(sqrt(1 / (n1 * p1 * (1 - p1)) + 1 / (n0 * p0 * (1 - p0))), 9) AS se,
       round((ln(p1 / (1 - p1)) - ln(p0 / (1 - p0))) / sqrt(1 / (n1 * p1 * (1 - p1)) + 1 / (n0 * p0 * (1 - p0))), 9) AS z
FROM g""",
})

# p-values by Simpson's rule with 4,000 steps: cos(a)^(df - 1) beyond a = asin(|r|)
# for Student's t, exp(-z u - u^2 / 2) for the normal tail; ``rows`` has r and n, or z.
_SIMPSON = """, k AS (SELECT i / 4000.0::double AS u, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w
       FROM range(4001) t(i))"""
_T_TAIL = _SIMPSON + """,
a AS (SELECT *, asin(least(abs(r), 1)) AS s, 12 / sqrt(greatest(n - 2, 1)) AS wd, n - 2 AS df FROM rows_p),
b AS (SELECT *, least(pi() / 2 - s, wd) AS l1, least(pi() / 2, wd) AS l0 FROM a),
tail AS (SELECT id, CASE WHEN any_value(r) IS NULL OR any_value(df) <= 0 THEN NULL WHEN abs(any_value(r)) >= 1 THEN 0
              ELSE least(1, any_value(l1) * sum(w * pow(abs(cos(s + l1 * u)), df - 1))
                            / (any_value(l0) * sum(w * pow(abs(cos(l0 * u)), df - 1)))) END AS p
         FROM b CROSS JOIN k GROUP BY id)
"""
_CELL = "printf('%.2f%s', round({0}, 2) + 0, CASE WHEN p < 0.05 THEN '*' ELSE ' ' END) AS cell"
SQL["difficulty_corr_p"] = (
    SQL["difficulty_corr"].split("\nSELECT model, n_iod")[0] + """,
rows_p AS (SELECT model || m AS id, * FROM (
    SELECT model, n_iod AS n, 'IOD' AS m, iod AS r FROM c UNION ALL SELECT model, n_di, 'DI', di FROM c
    UNION ALL SELECT model, n_hum, 'Human', hum FROM c) t)""" + _T_TAIL
    + "SELECT model, n, m AS metric, round(r, 9) AS r, round(p, 9) AS pvalue, " + _CELL.format("r") + " FROM rows_p JOIN tail USING (id)")
SQL["pairwise_corr_p"] = (
    _PAIRS + ",\nrows_p AS (SELECT m1 || ' ' || m2 AS id, m1, m2, r, n FROM pairs)" + _T_TAIL
    + "SELECT m1, m2, round(r, 9) AS r, n, round(p, 9) AS pvalue, " + _CELL.format("r") + " FROM rows_p JOIN tail USING (id)")
_cal = SQL["calibration"].split("\nSELECT model, round(ln(p0")
SQL["calibration_p"] = _cal[0] + """,
h AS (SELECT model, ln(p0 / (1 - p0)) AS b0, ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)) AS b1,
             sqrt(1 / (n1 * p1 * (1 - p1)) + 1 / (n0 * p0 * (1 - p0))) AS se FROM g),
q AS (SELECT *, b1 / se AS z, abs(b1 / se) AS az, least(12, 40 / greatest(abs(b1 / se), 1)) AS l FROM h)""" + _SIMPSON + """,
tail AS (SELECT model, least(1, sqrt(2 / pi()) * exp(-any_value(az * az) / 2) * any_value(l) / 12000
                                * sum(w * exp(-az * l * u - l * u * l * u / 2))) AS p FROM q CROSS JOIN k GROUP BY model)
SELECT model, round(b0, 9) AS intercept, round(b1, 9) AS slope, round(se, 9) AS se, round(z, 9) AS z, round(p, 9) AS pvalue,
       """ + _CELL.format("z") + " FROM q JOIN tail USING (model)"

_oc = _category_sql("raw").strip("\n")
SQL["ordered_category_table"] = _oc.replace(
    "\nSELECT cnt.Category, cnt.Count,",
    ",\nord AS (SELECT * FROM (VALUES (0, '5-LOW'), (1, '4-NOT SPECIFIED'), (2, '3-MEDIUM'), (3, '2-HIGH'), "
    "(4, '1-URGENT'), (5, '0-NONE'), (6, 'All')) AS o(sort_order, Category)),\n"
    "tab AS (SELECT cnt.Category, cnt.Count,", 1) + ")\nSELECT ord.Category, cast(ord.sort_order AS int) AS sort_order, " \
    "tab.Count, tab.m1, tab.m2, tab.m3, tab.m4, tab.Human FROM ord LEFT JOIN tab ON tab.Category = ord.Category"


# --- clustering ---------------------------------------------------------------

def _top_words_sql() -> str:
    stop = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"
    return f"""
, toks AS (SELECT question_index AS doc, Category AS cluster,
                  list_filter(regexp_extract_all(lower(coalesce(prompt, '')), '[\\pL\\pN_]{{2,}}'),
                              lambda t: NOT list_contains({stop}, t)) AS t
           FROM prompts_v),
terms AS (SELECT doc, cluster, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term
          FROM toks),
tf AS (SELECT cluster, doc, term, count(*) AS tf FROM terms GROUP BY cluster, doc, term),
nd AS (SELECT Category AS cluster, count(*) AS n FROM prompts_v GROUP BY Category),
dfq AS (SELECT cluster, term, count(*) AS df FROM tf GROUP BY cluster, term),
idf AS (SELECT dfq.cluster, term, ln((n + 1) / (df + 1)) + 1 AS idf FROM dfq JOIN nd ON nd.cluster = dfq.cluster WHERE n > 1),
w AS (SELECT tf.cluster, tf.doc, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf ON idf.cluster = tf.cluster AND idf.term = tf.term),
norms AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc),
sc AS (SELECT cluster, term, round(sum(w / norm), 9) AS score FROM w JOIN norms ON norms.doc = w.doc GROUP BY cluster, term),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rank FROM sc)
SELECT cluster, cast(rank AS int) AS rank, term, score FROM rk WHERE rank <= 10"""


SQL.update({
    "knn_graph": """
, comp AS (SELECT vec_id, cast(unnest(embedding) AS double) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
nrm AS (SELECT vec_id, sqrt(sum(x * x)) AS nx FROM comp GROUP BY vec_id),
dots AS (SELECT a.vec_id AS id, b.vec_id AS nbr, sum(a.x * b.x) AS dot
         FROM comp a JOIN comp b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id),
d AS (SELECT dots.id, dots.nbr, 1 - dot / (na.nx * nb.nx) AS dist
      FROM dots JOIN nrm na ON na.vec_id = dots.id JOIN nrm nb ON nb.vec_id = dots.nbr),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rank FROM d)
SELECT id, nbr, round(dist, 9) AS dist, cast(rank AS int) AS rank FROM r WHERE rank <= 10""",
    "cluster_top_words": _top_words_sql,
    "cluster_score": """
SELECT count(DISTINCT cluster) AS label_count, round(count(*) FILTER (WHERE probability < 0.05) / count(*), 9) AS cost
FROM clusters_v""",
    "cluster_objective": """
, s AS (SELECT count(DISTINCT cluster) AS label_count, count(*) FILTER (WHERE probability < 0.05) / count(*) AS cost
        FROM clusters_v)
SELECT label_count, round(cost, 9) AS cost,
       round(cost + CASE WHEN label_count < 6 OR label_count > 20 THEN 0.20 ELSE 0.0 END, 9) AS loss FROM s""",
})


def oracle_sql() -> dict[str, str]:
    out = {}
    for k, body in SQL.items():
        body = (body() if callable(body) else body).strip("\n")
        if body.startswith(","):
            # the body continues the WITH list with its own CTEs
            prefix = with_views("SELECT 1 " + body).partition("\nSELECT 1 ")[0]
            out[k] = (prefix + "\n" + body) if prefix.startswith("WITH ") else "WITH " + body.lstrip(", ")
        else:
            out[k] = with_views(body)
    return out
