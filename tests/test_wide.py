"""Wide embeddings against a dense singular value decomposition."""
import numpy as np

from quizspark.operators import wide as W

SF_SMALL = "/root/testdata/sf0.001"


def _dense(entries, ids):
    feats = sorted({e["feature"] for e in entries})
    a = np.zeros((len(ids), len(feats)))
    at = {f: j for j, f in enumerate(feats)}
    for e in entries:
        a[ids.index(e["id"]), at[e["feature"]]] = e["value"]
    return a


def _texts(spark, n=300):
    """Eight topics over a common vocabulary, ids from 100."""
    r = np.random.default_rng(2)
    rows = [(100 + i, " ".join([f"topic{i % 8}w{r.integers(12)}" for _ in range(r.integers(3, 30))] + [f"common{r.integers(400)}" for _ in range(12)]))
            for i in range(n)]
    return spark.createDataFrame([*rows, (1, ""), (2, None)], "id long, text string").repartition(4)


def test_subspace_is_that_of_a_dense_decomposition(spark):
    df = _texts(spark)
    entries = W.tfidf_entries(df, "id", "text").cache()
    ids = sorted(r["id"] for r in df.collect())
    a = _dense(entries.collect(), ids)
    assert np.allclose(np.linalg.norm(a[2:], axis=1), 1) and not a[:2].any()
    got, singular = W.leading_directions(entries, df.select("id"), 6, rounds=8)
    x = np.array([r["embedding"] for r in sorted(got.collect(), key=lambda r: r["id"])])
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(singular, s[:6], rtol=1e-3)
    assert not x[:2].any()
    q = np.linalg.qr(x)[0]
    assert np.linalg.svd(q.T @ u[:, :6])[1].min() > 0.999   # the same subspace
    again = {r["id"]: r["embedding"] for r in W.leading_directions(entries.repartition(3), df.select("id"), 6, rounds=8)[0].collect()}
    assert max(np.abs(np.array(again[i]) - x[j]).max() for j, i in enumerate(ids)) < 1e-6


def test_low_rank_and_empty(spark):
    df = spark.createDataFrame([(i, "same words here") for i in range(5)], "id long, text string")
    rows = W.embed_wide(df, "id", "text", k=3).collect()
    assert len(rows) == 5 and all(abs(r["embedding"][0] - 1) < 1e-9 and np.abs(r["embedding"][1:]).max() < 1e-6 for r in rows)
    assert W.embed_wide(df.limit(0), "id", "text", k=3).count() == 0


def test_a_block_too_large_to_broadcast_gives_the_same(spark, monkeypatch):
    """Repeated and null ids too; the matrix is saved once and never shuffled again."""
    df = _texts(spark, 120)
    df = df.union(df.where("id < 110")).union(spark.createDataFrame([(None, "topic1w1 lost")], "id long, text string"))

    def sums(rows):
        return sorted((r["id"] is not None, r["id"] or 0, [round(x, 5) for x in r["embedding"]]) for r in rows)
    pulled = []
    whole = W._pull
    monkeypatch.setattr(W, "_pull", lambda *a: pulled.append(1) or whole(*a))
    got = sums(W.embed_wide(df, "id", "text", k=4).collect())
    assert not pulled and len(got) == df.count()
    monkeypatch.setattr(W, "BLOCK_BYTES", 0)
    want = sums(W.embed_wide(df, "id", "text", k=4).collect())
    assert pulled and [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-5)
