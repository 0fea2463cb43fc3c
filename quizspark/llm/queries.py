"""Registered queries of the corpus operators: thin reads of the operators'
results over whole tables, with production parameters, and their DuckDB SQL
where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizspark.llm import (alignment, decontamination, language, licenses, merkle, mixing, pii, quality, secrets, simhash,
                           tokens, toxicity, weighted_sampling)
from quizspark.llm.common import table

#: A deployment passes a secret of its own.
SURROGATE_KEY = "surrogate-key-1"


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op2_license(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf, "documents"))


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf, "documents"), shingle_words=3, max_bits=2)
    return found.select("doc_id", "fingerprint", "component_id")


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf, "documents"))  # at most two copies
    return plan.select("doc_id", "size", "source_size", "target", "taken",
                       *[F.round(F.get("positions", i), 9).alias(f"position_{i + 1}") for i in range(2)])


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    stats = quality.with_stats(table(spark, sf, "documents"))
    judged = quality.judge(stats, quality.fit_cutoffs(stats, table(spark, sf, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _is(kind: str):
    return lambda k: k == kind


def op6_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.replace_pii(table(spark, sf, "documents"), SURROGATE_KEY)
    counts = [F.size(F.filter("pii_kinds", _is(kind))).alias(f"n_{kind}") for kind, _ in pii.KINDS]
    return found.select("doc_id", *counts, "text")


def op7_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.secret_scan(table(spark, sf, "documents"))
    base = F.filter("found", lambda s: s["order"] < len(secrets.BASE))
    counts = [F.size(F.filter(F.transform("found", lambda s: s["kind"]), _is(r.kind))).cast("long").alias(f"n_{r.kind}")
              for r in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.written(base).cast("binary"), 256).alias("base_sha256"),
                        secrets.written(F.col("found")).alias("spans"))


def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return language.predict(docs, language.fit(docs))


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.benchmark_matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op10_tokens(spark: SparkSession, sf: str) -> DataFrame:
    count = tokens.token_counter(spark)
    return tokens.limits(tokens.histogram(table(spark, sf, "documents"), count(F.col("text"))))


def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.line_breaks_lost(table(spark, sf, "documents"))


def op12_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align(table(spark, sf, "documents"))


def op13_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return weighted_sampling.fingerprints(table(spark, sf, "documents"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_license, op3_simhash, op4_mixing, op5_quality, op6_pii, op7_secrets,
                            op8_language, op9_decontamination, op10_tokens, op11_merkle, op12_alignment,
                            op13_fingerprints, pipeline)}


def _text_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _license_sql() -> str:
    def canon(x: str) -> str:
        x = f"regexp_replace(lower({x}), {_text_literal(licenses.COPYRIGHT_LINE)}, '', 'g')"
        x = f"replace({x}, {_text_literal(licenses.RIGHTS)}, '')"
        x = rf"regexp_replace({x}, '[^\pL\pN]+', ' ', 'g')"
        for a, b in licenses.SPELLINGS:
            x = f"replace({x}, {_text_literal(a)}, {_text_literal(b)})"
        return f"sha256(trim({x}))"
    values = ", ".join(f"({_text_literal(i)}, {_text_literal(t)})" for i, t in licenses.KNOWN)
    return f"""
WITH known AS (SELECT {canon('t')} AS known_digest, min(i) AS license_id FROM (VALUES {values}) AS v(i, t) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit
          FROM documents),
units AS (SELECT doc_id, cast(-1 AS int) AS unit, {canon('text')} AS digest FROM documents)
SELECT doc_id, unit, digest, license_id FROM units LEFT JOIN known ON digest = known_digest
UNION ALL
SELECT doc_id, cast(unit AS int), known_digest, license_id FROM lines JOIN known ON {canon('line')} = known_digest"""


def _mixing_sql() -> str:
    return r"""
WITH rows AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                     md5(coalesce(cast(doc_id AS varchar), '')) AS o1, md5(coalesce(text, '')) AS o2 FROM documents),
src AS (SELECT source, cast(sum(size) AS bigint) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM src),
filled AS (SELECT *, 3 * sum(source_size) OVER () AS need2,
                  coalesce(sum(2 * source_size) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
                  sum(w) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from FROM ranked),
lvl AS (SELECT need2 - 2 * full_before AS num, 2 * w_from AS den FROM filled
        WHERE (need2 - 2 * full_before) * w <= 2 * source_size * 2 * w_from ORDER BY full_before, w_from DESC LIMIT 1),
targets AS (SELECT source, source_size, CASE w WHEN 5 THEN 0.5 WHEN 2 THEN 1.0 ELSE 2.0 END::DOUBLE AS tilt, least(cast(2 * source_size AS double), cast(w * num AS double) / cast(den AS double)) AS target
            FROM ranked CROSS JOIN lvl),
placed AS (SELECT doc_id, size, source_size, target, tilt,
                  coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY o1, o2, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
           FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT *, size > 0 AND 2 * start + size < 2 * target AS in_1, size > 0 AND 2 * (start + source_size) + size < 2 * target AS in_2,
                  cast(start + size / 2 AS double) / target * (1 + tilt) / 2 AS x_1,
                  cast(start + source_size + size / 2 AS double) / target * (1 + tilt) / 2 AS x_2 FROM placed)
SELECT doc_id, cast(size AS bigint) AS size, source_size, target, cast(size * (cast(in_1 AS int) + cast(in_2 AS int)) AS bigint) AS taken,
       CASE WHEN in_1 THEN round(CASE WHEN tilt = 1 THEN x_1 ELSE 2 * x_1 / (1 + sqrt(greatest(1 + 2 * (tilt - 1) * x_1, 0))) END, 9) END AS position_1,
       CASE WHEN in_2 THEN round(CASE WHEN tilt = 1 THEN x_2 ELSE 2 * x_2 / (1 + sqrt(greatest(1 + 2 * (tilt - 1) * x_2, 0))) END, 9) END AS position_2
FROM copies"""


def _secrets_sql() -> str:
    def spans(i: int, r: secrets.Rule) -> str:
        p = _text_literal(r.pattern)
        return (f"SELECT n, doc_id, {i} AS ord, '{r.kind}' AS kind, regexp_extract_all(t, {p}) AS m, "
                f"regexp_extract_all(t, {p}, {r.group}) AS g, string_split_regex(t, {p}) AS parts, {r.min_length} AS least FROM d")
    each = " UNION ALL ".join(spans(i, r) for i, r in enumerate(secrets.BASE + secrets.MORE))
    base = len(secrets.BASE)
    counts = ", ".join(f"coalesce(count(*) FILTER (WHERE kind = '{r.kind}'), 0) AS n_{r.kind}" for r in secrets.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT * FROM ({each}) WHERE len(m) > 0),
placed AS (SELECT n, ord, kind, least, unnest(m) AS m, unnest(g) AS g, unnest(list_transform(range(1, len(m) + 1), lambda i:
              list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS s
       FROM found),
spans AS (SELECT n, ord, kind, s, kind || ':' || cast(s AS bigint) || ':' || cast(s + length(m) AS bigint) AS span FROM placed WHERE length(g) >= least),
agg AS (SELECT n, {counts}, string_agg(span, ',' ORDER BY s, ord) AS spans, string_agg(span, ',' ORDER BY s, ord) FILTER (WHERE ord < {base}) AS base
        FROM spans GROUP BY n)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans FROM d LEFT JOIN agg USING (n)"""


def _merkle_sql() -> str:
    def leaf(text: str) -> str:
        fields = [f"coalesce(strlen(cast({c} AS varchar)) || ':' || cast({c} AS varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(fields)})"
    bits = "flatten(list_transform(string_split(cast(doc_id AS varchar), ''), lambda c: list_transform(range(8), lambda i: (ascii(c) >> i) & 1)))"
    crc = (f"list_reduce(list_prepend(cast(4294967295 AS bigint), {bits}), lambda c, b: xor(xor(c, b) >> 1, "
           "CASE WHEN xor(c, b) & 1 = 1 THEN cast(3988292384 AS bigint) ELSE 0 END))")
    even = f"(doc_id IS NULL OR xor({crc}, 4294967295) & 1 = 0)"
    side = "coalesce(lag(dig, 2) OVER w, '') || coalesce(lag(dig, 1) OVER w, '') AS l, coalesce(lead(dig, 1) OVER w, '') || coalesce(lead(dig, 2) OVER w, '') AS r"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {leaf('text')} AS leaf,
                            CASE WHEN {even} THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS now FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
up(source, lvl, idx, n, dig) AS (
  SELECT source, 0, cast(pos AS bigint), cast(n AS bigint), leaf FROM placed
  UNION ALL
  SELECT source, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(dig, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY source, lvl, idx // 3, n),
subs AS (SELECT source, dig, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(lvl, idx, n, dig) AS (
  SELECT 0, cast(pos AS bigint), cast(n AS bigint), dig FROM subs
  UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(dig, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 3, n),
up_side AS (SELECT source, lvl, idx, {side} FROM up WHERE n > 1 WINDOW w AS (PARTITION BY source, lvl, idx // 3 ORDER BY idx)),
top_side AS (SELECT lvl, idx, {side} FROM top WHERE n > 1 WINDOW w AS (PARTITION BY lvl, idx // 3 ORDER BY idx)),
high AS (SELECT s.source, s.dig AS subroot, list(t.l || '|' || t.r ORDER BY t.lvl) FILTER (WHERE t.l IS NOT NULL) AS path
         FROM subs s LEFT JOIN top_side t ON t.idx = s.pos // cast(pow(3, t.lvl) AS bigint) GROUP BY s.source, s.dig),
low AS (SELECT p.source, p.pos, list(u.l || '|' || u.r ORDER BY u.lvl) FILTER (WHERE u.l IS NOT NULL) AS path
        FROM placed p LEFT JOIN up_side u ON u.source IS NOT DISTINCT FROM p.source AND u.idx = p.pos // cast(pow(3, u.lvl) AS bigint) GROUP BY p.source, p.pos),
whole AS (SELECT p.doc_id, p.leaf, p.now, h.subroot, (SELECT dig FROM top WHERE n = 1) AS root,
                 list_concat(coalesce(l.path, []), coalesce(h.path, [])) AS path
          FROM placed p JOIN low l ON l.source IS NOT DISTINCT FROM p.source AND l.pos = p.pos JOIN high h ON h.source IS NOT DISTINCT FROM p.source),
folded AS (SELECT *, list_reduce(list_prepend(now, path), lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2))) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license": _license_sql(), "op4_mixing": _mixing_sql(), "op7_secrets": _secrets_sql(), "op11_merkle": _merkle_sql()}
