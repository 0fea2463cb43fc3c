"""Secret scans through a trigram inverted index (SQL functions only).

From each rule's regular expression a Boolean trigram query is derived on the
driver (``trigram_query``, over Python's own parse of the pattern): strings
that every match must contain, as a conjunction of alternatives, each a set of
trigrams. Then

1. index: postings (trigram, text key) of lower-cased texts, for the trigrams
   that occur in some query; the key is a hash of the text, so copies share
   their postings;
2. intersect: postings meet the query table (fixed size) on the trigram; an
   alternative holds if all its trigrams were found, a rule's text is a
   candidate if every conjunct has an alternative that holds;
3. verify: the regular expression runs on the candidates, which are joined to
   the texts by key (broadcast only if their counted number is small).

Rules without a mandatory trigram, such as runs of hex digits, scan every text.

A case-insensitive index and a hashed key can only add candidates, never lose
one. Spans are in code points, end exclusive.

Defined results: null texts count as empty; texts without a secret have the
digest of the empty string and empty spans; overlapping spans of different
kinds are all kept; repeated rows are scanned row by row; an empty table gives
an empty result. Only ``doc_id`` and ``text`` are read by the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizspark.llm.common import fresh, shared_table, small_enough
from quizspark.llm.spans import matches, no_matches


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str          # read alike by Java and Python
    group: int = 0
    min_length: int = 0   # code points of the group


#: The base kinds, in the order in which their spans are listed.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs of 24 and more only: the shorter runs of [0-9a-f]+ fail anyway
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds that the method adds.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_login", r"[a-z]{3,10}://[A-Za-z0-9._-]+:[^\x20\x09-\x0D@/]{3,}@[A-Za-z0-9.-]+"),
)
_MOST = 64  # strings or alternatives held at once while deriving a query


def _strings(parsed) -> tuple[set[str] | None, list[set[str]]]:
    """(all strings the pattern can match, or None; sets of strings of which every
    match contains one). Strings are in lower case."""
    exact: set[str] | None = {""}
    known: list[set[str]] = []

    def cut() -> None:
        nonlocal exact
        if exact is not None and exact != {""}:
            known.append(exact)
        exact = None

    def put(one: set[str] | None) -> None:
        nonlocal exact
        if one is None or len(one) > _MOST:
            cut()
        elif exact is None:
            exact = one
        elif len(exact) * len(one) > _MOST:
            cut()
            exact = one
        else:
            exact = {a + b for a, b in product(exact, one)}

    whole = True
    for op, arg in parsed:
        if op is sre.LITERAL:
            put({chr(arg).lower()})
        elif op is sre.IN:
            chars = {chr(a[1]).lower() for a in arg if a[0] is sre.LITERAL}
            plain = all(a[0] is sre.LITERAL for a in arg)
            put(chars if plain else None)
            whole &= plain
        elif op is sre.SUBPATTERN:
            one, inner = _strings(arg[3])
            if one is None:
                cut()
                known += inner
                whole = False
            else:
                put(one)
        elif op is sre.BRANCH:
            each = [_strings(b) for b in arg[1]]
            if all(o is not None for o, _ in each):
                put(set().union(*(o for o, _ in each)))
            else:
                cut()
                whole = False
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, body = arg
            one, inner = _strings(body)
            if one is not None and (least, most) == (0, 1):
                put(one | {""})
            else:
                cut()
                whole = False
                if least and one is not None:
                    known.append(one)
                elif least:
                    known += inner
        else:
            cut()
            whole = False
    if whole and exact is not None:
        return exact, known
    cut()
    return None, known


def trigram_query(pattern: str) -> list[list[set[str]]]:
    """Conjunction of alternatives, each a set of trigrams; empty if the pattern
    has no mandatory trigram."""
    exact, known = _strings(_parser.parse(pattern))
    out = []
    for strings in known + ([exact] if exact is not None else []):
        if strings and all(len(s) >= 3 for s in strings):
            out.append([{s[i:i + 3] for i in range(len(s) - 2)} for s in sorted(strings)])
    return out


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): texts, by hash, that hold the mandatory trigrams of rules."""
    spark = docs.sparkSession
    query = [(r.kind, i, j, len(alt), t) for r in rules for i, clause in enumerate(trigram_query(r.pattern))
             for j, alt in enumerate(clause) for t in sorted(alt)]
    clauses = {r.kind: len(trigram_query(r.pattern)) for r in rules}
    wanted = sorted({q[-1] for q in query})
    text = docs.select(F.xxhash64("text").alias("key"), F.lower("text").alias("low"))
    postings = text.select("key", F.explode(F.array_compact(F.array(
        *[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))).alias("tri")).distinct()
    asked = spark.range(1).select(F.inline(F.array(*[F.struct(
        F.lit(r).alias("rule"), F.lit(i).alias("clause"), F.lit(j).alias("alt"), F.lit(n).alias("need"), F.lit(t).alias("tri"))
        for r, i, j, n, t in query])))
    held = (postings.join(F.broadcast(asked), "tri")  # a row per trigram of the rules
            .groupBy("key", "rule", "clause", "alt", "need").agg(F.count(F.lit(1)).alias("n")).where("n = need")
            .groupBy("key", "rule").agg(F.count_distinct("clause").alias("n")))
    needed = F.create_map(*[F.lit(x) for kv in clauses.items() for x in kv])
    return held.where(F.col("n") == needed[F.col("rule")]).groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    found = matches(text, rule.pattern, rule.group)
    if rule.min_length:
        found = F.filter(found, lambda m: F.length(m["part"]) >= rule.min_length)
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(rule.kind).alias("kind")))


def with_spans(docs: DataFrame, column: str, rules: tuple[Rule, ...] = BASE + MORE, broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` and a column of all spans (start, order, end, kind), by start, then
    in the order of the rules."""
    key, hit = fresh(docs, "text_key"), fresh(docs, "text_rules")
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    found = shared_table(candidates(docs, indexed)).toDF(key, hit)
    found = F.broadcast(found) if small_enough(found, broadcast_rows) else found
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.withColumn(key, F.xxhash64("text")).join(found, key, "left")
    parts = []
    for i, r in enumerate(rules):
        scan = F.array_contains(F.col(hit), r.kind) if r in indexed else text.rlike(r.pattern)
        parts.append(F.when(scan, _spans(text, r, i)).otherwise(
            F.transform(no_matches(), lambda m: F.struct(m["start"].alias("start"), F.lit(0).alias("order"), m["end"].alias("end"), F.lit("").alias("kind")))))
    return joined.withColumn(column, F.array_sort(F.concat(*parts))).drop(key, hit)


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id, spans, and the count of each base kind, per document."""
    found = with_spans(docs.select("doc_id", "text"), "found", rules)
    return found.select("doc_id", "found")


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` (overlapping
    spans by one), and ``n_chars`` brought up to date where that column exists."""
    col = fresh(docs, "secret_spans")
    found = with_spans(docs, col, rules)
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                        F.when((s["start"] >= acc["at"]), F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(F.col(col), zero, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
    out = found.withColumn("text", F.when(F.size(col) > 0, masked).otherwise(text))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.size(col) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
