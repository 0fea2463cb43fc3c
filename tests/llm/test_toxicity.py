"""Held-out accuracy on planted words and pairs, and defined results."""
import math
import random
import zlib

from quizspark.llm import toxicity as tox
from quizspark.llm.common import held_out
from pyspark.sql import functions as F


def _corpus(n=1500):
    r = random.Random(3)
    words = [a + b + c for a in "ba de ki lo mu".split() for b in "ra se ti no pu".split() for c in ("n", "s", "t")]
    rows, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randrange(20, 60))]
        bad = i % 6 == 0
        if bad:
            text.insert(r.randrange(len(text)), "grumpf" + r.choice(words))
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_finds_stems_on_held_out_rows(spark, docs_of):
    rows, labels = _corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tox.score_documents(docs_of(rows), lab).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 200
    assert {i for i in got if got[i].held_out} == set(held)
    assert all(got[i].predicted == labels[i][2] for i in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_pairs_have_weights_of_their_own():
    import numpy as np
    rng = np.random.default_rng(0)
    x = (rng.random((3000, 6)) < 0.4).astype(np.uint8)
    y = (x[:, 0] & x[:, 1]).astype(float)       # toxic only together
    w0, w, v = tox._fit(x, y, 4, 60, 0.05, 1e-5)
    m = tox.ToxicityModel(18, np.arange(6), w0, w, v)
    z = m.logits(x.astype(float))
    assert ((z > 0) == (y > 0)).all()
    assert np.allclose(1 / (1 + np.exp(-z)), m.score_rows([set(np.flatnonzero(r).tolist()) for r in x]))


def _matched(n=3000):
    """Each text names one of four insults and one of four groups; it is toxic
    if the two belong together, so that no term alone tells anything."""
    r = random.Random(8)
    insults, groups = ["grumpf", "zwackel", "plonker", "fuddle"], ["quilters", "harpists", "joggers", "vintners"]
    fill = [a + b + c for a in "ba de ki lo mu".split() for b in "ra se ti no pu".split() for c in ("n", "s", "t")]
    rows, labels = [], []
    for i in range(n):
        a, b = r.randrange(4), r.randrange(4)
        text = [r.choice(fill) for _ in range(r.randrange(10, 30))] + [insults[a], groups[b]]
        r.shuffle(text)
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 1, int(a == b)))
    return rows, labels


def test_fit_learns_pairs_whose_terms_are_flat_alone(spark, docs_of):
    rows, labels = _matched()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tox.score_documents(docs_of(rows), lab).collect()}
    held = [y == got[i].predicted for i, _, y in labels if got[i].held_out]
    assert len(held) > 500 and sum(held) >= 0.98 * len(held)
    # without the pairs nothing is learnt
    alone = tox.fit(docs_of(rows), lab, min_z=1e9)
    assert len(alone.buckets) == 0


def test_pair_scores_equal_the_definition(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    x = (rng.random((400, 300)) < 0.3).astype(np.uint8)
    y = (x[:, 3] & x[:, 270]).astype(float)
    p = np.full(400, y.mean())
    got = {(r.i, r.j): r.z for r in tox._pair_scores(spark, np.packbits(x, axis=1), 300, y, p, 2.0).itertuples()}
    want = {}
    for i in range(300):
        for j in range(i + 1, 300):
            both = (x[:, i] & x[:, j]) == 1
            z = (y - p)[both].sum() / math.sqrt((p * (1 - p))[both].sum() + 1)
            if abs(z) >= 2.0:
                want[i, j] = z
    assert max(got, key=got.get) == (3, 270)
    assert {k for k in set(got) ^ set(want) if abs(abs(got.get(k, want.get(k))) - 2) > 1e-4} == set()
    assert all(abs(got[k] - want[k]) < 1e-4 for k in set(got) & set(want))


def test_scores_equal_the_definition_pair_by_pair():
    import numpy as np
    rng = np.random.default_rng(4)
    m = tox.ToxicityModel(18, np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    for row in ([], [2], [0, 4, 8], list(range(9))):
        z = m.w0 + sum(m.w[i] for i in row) + sum(float(m.v[i] @ m.v[j]) for i in row for j in row if i < j)
        assert abs(m.score_rows([set(row)])[0] - 1 / (1 + math.exp(-z))) < 1e-12


def test_odd_rows_and_no_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = tox.score_documents(odd, none).collect()
    assert len(got) == 8 and len({round(r.score, 12) for r in got}) == 1
    odd_labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (2, 0, 0), (4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert tox.score_documents(odd, odd_labels).count() == 8
    assert tox.score_documents(empty, odd_labels).count() == 0


def test_long_text_is_read_whole(spark, docs_of):
    rows, labels = _corpus(900)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = tox.fit(docs_of(rows), lab)
    long_text = "baran " * 400_000 + "grumpfdeset"
    got = docs_of([(1, long_text), (2, "baran " * 400_000)]).select("doc_id", tox.score(model, F.col("text")).alias("s")).collect()
    assert {r.doc_id: r.s > 0.5 for r in got} == {1: True, 2: False}


def test_held_out_rule(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h"))
    assert all(r.h == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in df.collect())
    assert not math.isnan(0.0)
