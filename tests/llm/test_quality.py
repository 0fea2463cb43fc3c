import math
import random
import re
from collections import Counter

from quizspark.llm import quality as q


def brute_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cover = {i + j for i in range(len(w) - 2) if win[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines, dup = text.split("\n"), 0
    for i, x in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover))


def _texts():
    r = random.Random(5)
    out = ["", None, " \n \n", "a b c a b c", "x\nx\n\n\nx y\nx y", "ä€😀 b\x85c d\xa0e", "a b a b a b a", "#*$ %&| <> ok"]
    for _ in range(60):
        out.append("".join(r.choice(["a ", "b ", "c\n", "dd\t", "#", "\n", "é "]) for _ in range(r.randrange(0, 200))))
    return out


def test_statistics_against_brute_force(monkeypatch):
    from quizspark.llm import common
    for size in (1 << 20, 7):
        monkeypatch.setattr(q, "pieces", lambda t, size=size: common.pieces(t, size))
        for t in _texts():
            assert q.text_stats(t)[:5] == brute_stats(t), t


def test_large_vocabulary_codes():
    import numpy as np
    ids = np.array([5, 3_000_000, 7, 5, 3_000_000, 7, 1])
    assert q._repeat_words(ids) == 6


def test_exact_bound():
    def tail(k, n, p):
        return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
    for n in (10, 300, 1000):
        for k in range(0, 12):
            for limit in (0.01, 0.05, 0.2):
                assert q.upper_bound_holds(k, n, limit, 0.01) == (tail(k, n, limit) <= 0.01)
    assert not q.upper_bound_holds(0, 0, 0.1, 0.5)


def _labelled(n):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = [f"w{r.randrange(500)}" + ("" if good else "###") for _ in range(r.randrange(60, 150))]
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_cutoffs_need_enough_labels(spark, docs_of):
    rows, labels = _labelled(2000)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    stats = q.with_stats(docs_of(rows)).cache()
    cut = q.fit_cutoffs(stats, lab)
    kept = {r.doc_id: r.kept for r in q.judge(stats, cut).collect()}
    assert all(kept[i] == bool(g) for i, g, _ in labels)
    few = q.fit_cutoffs(stats, lab.where("doc_id < 300"))
    assert few == {} and all(r.kept for r in q.judge(stats, few).collect())
    # a rule that also hits good documents is never used beyond its limit
    mixed = spark.createDataFrame([(i, 1, 0) for i, _, _ in labels], "doc_id long, quality int, toxic int")
    assert q.fit_cutoffs(stats, mixed) == {}
    stats.unpersist()


def test_base_rule_and_odd_rows(spark, docs_of, odd, empty):
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, "a b c " * 30), (2, " ".join(f"u{i}" for i in range(60))), (3, "short")]
    got = {r.doc_id: (r.base_failed, r.kept) for r in q.judge(q.with_stats(docs_of(rows)), q.fit_cutoffs(q.with_stats(docs_of(rows)), none)).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (True, False)}
    s = q.with_stats(odd)
    assert s.count() == 8 and all(r.base_failed and not r.kept for r in q.judge(s, q.fit_cutoffs(s, none)).collect())
    assert q.judge(q.with_stats(empty), q.fit_cutoffs(q.with_stats(empty), none)).count() == 0
