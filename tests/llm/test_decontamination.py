import random
import re
from collections import Counter

import pytest

from quizspark.llm import decontamination as dc


def _words(r, n):
    return [r.choice("ra se ti no pu ka lo mi de fu".split()) + r.choice("ba ne so ti".split()) + r.choice(["", "n", "st"]) for _ in range(n)]


def brute(doc, item, s=0.8):
    """Best similarity of an item-sized window, if it reaches s."""
    w, it = re.findall(r"\w+", (doc or "").lower()), re.findall(r"\w+", (item or "").lower())
    if not it:
        return None
    def sh(x):
        k = min(5, len(x))
        return Counter(tuple(x[i:i + k]) for i in range(len(x) - k + 1))
    best = 0.0
    for i in range(len(w) - len(it) + 1):
        a, b = sh(w[i:i + len(it)]), sh(it)
        best = max(best, sum((a & b).values()) / sum((a | b).values()))
    return best if best >= s else None


@pytest.fixture(scope="module")
def planted():
    r = random.Random(6)
    items = [(i, " ".join(_words(r, n))) for i, n in enumerate([16, 20, 30, 30, 45, 58, 5, 3, 1, 0])] + [(20, None), (21, "")]
    items.append((22, items[2][1].upper().replace(" ", ", ")))   # the same words again
    docs = []
    for d in range(120):
        w = _words(r, r.randrange(0, 150))
        at = r.randrange(0, len(w) + 1)
        it = items[d % 7][1].split()
        if d % 3 == 0:
            it = list(it)
            if d % 2 and len(it) > 25:
                it[r.choice([0, len(it) - 1])] = "changed"       # one shingle fewer
            w[at:at] = [x.upper() if d % 4 == 0 else x for x in it]
        elif d % 3 == 1 and len(it) > 20:
            it = list(it)
            for p in range(3, len(it), 6):
                it[p] = "other"                                   # too different
            w[at:at] = it
        docs.append((d, (", " if d % 5 == 0 else " ").join(w)))
    return items, docs + [(500, docs[0][1]), (500, docs[0][1])]


def test_against_brute_force(spark, docs_of, planted):
    items, docs = planted
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.benchmark_matches(docs_of(docs), bench).collect()}
    want = {}
    for d, t in docs:
        for i, x in items:
            if (s := brute(t, x)) is not None:
                want[d, i] = s
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert len(want) > 40


def test_blocks_of_items_and_small_pieces(spark, docs_of, planted, monkeypatch):
    items, docs = planted
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id, r.similarity) for r in dc.benchmark_matches(docs_of(docs[:40]), bench).collect()}
    assert whole == {(r.doc_id, r.item_id, r.similarity) for r in dc.benchmark_matches(docs_of(docs[:40]), bench, block_words=120).collect()}
    from quizspark.llm import common
    it = dc._Items([dc_text for _, t in items if (dc_text := " ".join(dc.words_of(t)))], 0.8)
    before = [it.windows(t) for _, t in docs]
    monkeypatch.setattr(dc, "pieces", lambda t: common.pieces(t, 40))
    assert [it.windows(t) for _, t in docs] == before


def test_radius_is_guaranteed(spark):
    r = random.Random(1)
    base = r.getrandbits(63)
    near = [base ^ sum(1 << b for b in r.sample(range(64), n)) for n in list(range(20)) * 5]
    near = [x - (1 << 64) if x >> 63 else x for x in near]
    items = spark.createDataFrame([(4, "x", base)], "n int, item_text string, item_fp long")
    from pyspark.sql import functions as F
    probes = spark.createDataFrame([(i, 4, x) for i, x in enumerate(near)], "i int, n int, fp long").select(
        "i", "n", F.posexplode(F.array(*dc._blocks(F.col("fp")))).alias("block", "value"))
    assert probes.join(dc._index(items), ["n", "block", "value"]).select("i").distinct().count() == len(near)


def test_odd_rows_and_drop(spark, odd, empty, docs_of, planted):
    items, docs = planted
    bench = spark.createDataFrame(items[:8], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.benchmark_matches(odd, none).count() == 0 and dc.benchmark_matches(empty, bench).count() == 0
    assert dc.drop_contaminated(odd, bench).count() == 8
    frame = docs_of(docs)
    left = dc.drop_contaminated(frame, bench)
    bad = {d for d, t in docs if any(brute(t, x) is not None for _, x in items[:8])}
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs if d not in bad) and left.columns == frame.columns


def brute_whole(doc, item, s=0.8):
    """As ``brute``; a text with fewer words than the item is compared whole."""
    w, it = re.findall(r"\w+", (doc or "").lower()), re.findall(r"\w+", (item or "").lower())
    if not w or len(w) >= len(it):
        return brute(doc, item, s)
    def sh(x):
        k = min(5, len(x))
        return Counter(tuple(x[i:i + k]) for i in range(len(x) - k + 1))
    a, b = sh(w), sh(it)
    best = sum((a & b).values()) / sum((a | b).values())
    return best if best >= s else None


def test_texts_shorter_than_an_item(spark, docs_of, monkeypatch):
    """Items cut by 1 to 10 words at either end are whole documents."""
    r = random.Random(8)
    items = [(i, " ".join(_words(r, n))) for i, n in enumerate([4, 5, 6, 9, 14, 25, 30, 44, 60, 100, 100])]
    items += [(20, items[9][1] + " and three more"), (21, ("pa lo mi " * 20).strip())]  # near another item; the same shingles again and again
    docs = []
    for i, t in items:
        w = t.split()
        for cut in range(0, min(11, len(w))):
            docs += [(100 * i + cut, " ".join(w[cut:])), (100 * i + cut + 20, ", ".join(w[:len(w) - cut]).upper()),
                     (100 * i + cut + 40, " ".join(w[cut // 2:len(w) - (cut - cut // 2)]))]
    docs += [(9000, None), (9001, ""), (9001, docs[400 % len(docs)][1])]
    want = {}
    for d, t in docs:
        for i, x in items:
            if (s := brute_whole(t, x)) is not None:
                want[d, i] = max(s, want.get((d, i), 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in dc.benchmark_matches(docs_of(docs), bench).collect()}
    assert set(got) == set(want) and all(abs(got[k].similarity - want[k]) < 1e-12 for k in want)
    text = dict(docs)
    short = [k for k in want if len(text[k[0]].split()) < len(dict(items)[k[1]].split())]
    assert len(short) > 100 and got[905, 9].similarity == 91 / 96 and got[905, 9].n_windows == 1
    left = {x.doc_id for x in dc.drop_contaminated(docs_of(docs), bench).collect()}
    assert left == {d for d, _ in docs if not any(k[0] == d for k in want)}
    from quizspark.llm import common
    cut = dc._Items([" ".join(dc.words_of(t)) for _, t in items], 0.8)
    before = [cut.windows(t) for _, t in docs]
    monkeypatch.setattr(dc, "pieces", lambda t: common.pieces(t, 40))
    assert [cut.windows(t) for _, t in docs] == before
