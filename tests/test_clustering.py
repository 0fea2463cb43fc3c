"""Clustering: exact kNN vs brute force, planted groups, scores."""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quizspark.operators import clustering as C


def _planted(spark, n_groups=4, per=40, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n_groups, dim)) * 10
    rows, labels = [], []
    for g in range(n_groups):
        for j in range(per):
            rows.append((g * per + j, (centers[g] + rng.normal(size=dim)).tolist()))
            labels.append(g)
    noise = [(10_000 + j, (rng.normal(size=dim) * 40).tolist()) for j in range(8)]
    df = spark.createDataFrame(rows + noise, "id long, vec array<double>")
    return df, dict(zip([r[0] for r in rows], labels))


def test_knn_matches_brute_force(spark):
    df, _ = _planted(spark)
    got = C.knn_graph(df, 5, "id", "vec", metric="euclidean", block_size=37).collect()
    ids = [r["id"] for r in df.collect()]
    X = np.array([r["vec"] for r in df.collect()])
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    want = {}
    for a, i in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda b: (D[a, b], ids[b]))[:5]
        want[i] = [ids[b] for b in order]
    have = {}
    for r in sorted(got, key=lambda r: (r["id"], r["rank"])):
        have.setdefault(r["id"], []).append(r["nbr"])
    assert have == want


def test_density_clusters_recover_planted_groups(spark):
    df, labels = _planted(spark)
    g = C.knn_graph(df, 10, "id", "vec", metric="euclidean")
    cl = {r["id"]: r for r in C.density_clusters(g, min_samples=5, min_cluster_size=10, eps_quantile=0.9).collect()}
    found = {}
    for i, lab in labels.items():
        found.setdefault(lab, set()).add(cl[i]["cluster"])
    # each planted group maps to one cluster, different groups to different clusters
    assert all(len(s - {-1}) == 1 for s in found.values())
    assert len({next(iter(s - {-1})) for s in found.values()}) == 4
    assert sum(1 for i in labels if cl[i]["cluster"] == -1) <= 0.15 * len(labels)
    assert all(0 <= r["probability"] <= 1 for r in cl.values())


def test_connected_components_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "src long, dst long")
    v = spark.createDataFrame([(i,) for i in range(51)] + [(100,), (101,), (200,)], "id long")
    lab = {r["id"]: r["label"] for r in C.connected_components(e, v).collect()}
    assert all(lab[i] == 0 for i in range(51)) and lab[101] == 100 and lab[200] == 200


def test_scores_and_objective(spark):
    df = spark.createDataFrame([(0, 0.9), (0, 0.01), (1, 0.5), (-1, 0.0)], "cluster int, probability double")
    s = C.cluster_objective(C.cluster_score(df), label_lower=6).first()
    assert s["label_count"] == 3 and abs(s["cost"] - 0.5) < 1e-12 and abs(s["loss"] - 0.7) < 1e-12
    s2 = C.cluster_score(df, count_noise=False).first()
    assert s2["label_count"] == 2


def test_embed_prompts_unit_norm(spark):
    df = spark.createDataFrame([("the cat sat",), ("a dog ran far",), ("the cat ran",)], "prompt string")
    from pyspark.ml.functions import vector_to_array
    e = C.embed_prompts(df).select(vector_to_array("embedding").alias("v")).collect()
    for r in e:
        assert abs(sum(x * x for x in r["v"]) - 1.0) < 1e-9


def test_top_words_of_many_chunks_are_those_of_one_table(spark):
    """Repeated and null ids, null and single-text clusters, chunks of a few texts;
    term counts stay in their chunk."""
    import math
    import re
    from collections import Counter, defaultdict
    r = np.random.default_rng(7)
    words = [f"w{i}" for i in range(40)] + ["the", "Éa", "x"]
    rows = [(i % 50 if i % 11 else None, " ".join(r.choice(words, r.integers(0, 25))), ["a", "b", None][i % 3]) for i in range(90)]
    rows += [(1000, "alone in here", "c"), (1001, None, "a"), (1002, "", "b")]
    tf, n = defaultdict(Counter), Counter(c for _, _, c in rows)
    for doc, text, c in rows:
        t = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w != "the"]
        tf[c, doc].update(t + [f"{x} {y}" for x, y in zip(t, t[1:])])
    df = Counter((c, t) for (c, _), counts in tf.items() for t in counts)
    w = {(c, d, t): x * (math.log((n[c] + 1) / (df[c, t] + 1)) + 1) for (c, d), counts in tf.items() if c and n[c] > 1 for t, x in counts.items()}
    norm, score = Counter(), Counter()
    for (_, d, _), x in w.items():
        norm[d] += x * x
    for (c, d, t), x in w.items():
        if d is not None:
            score[c, t] += x / math.sqrt(norm[d])
    want = [(c, i + 1, t, -s) for c in "ab" for i, (s, t) in
            enumerate(sorted((-round(s, 6), t) for (k, t), s in score.items() if k == c)[:10])]
    frame = spark.createDataFrame(rows, "id long, prompt string, cluster string").repartition(4)
    for chars in (100, 10 ** 6):
        got = C.cluster_top_words(frame, stop_words=["the"], digits=6, chunk_chars=chars)
        assert [(x["cluster"], x["rank"], x["term"]) for x in got.orderBy("cluster", "rank").collect()] == [x[:3] for x in want]
        assert np.allclose([x["score"] for x in got.orderBy("cluster", "rank").collect()], [x[3] for x in want], atol=2e-6)
        plan = got._jdf.queryExecution().toString()
        assert not re.search(r"Exchange hashpartitioning\([^)]*doc#", plan)
    assert C.cluster_top_words(frame.limit(0)).count() == 0


def test_chunks_of_top_words_tell_hashes_and_return_frequent_terms(spark):
    """Of many rare terms a chunk sends some bytes, and only those that may be among
    the best as text; a bound that was too high is noticed and the scores are made again."""
    r = np.random.default_rng(1)
    texts = [" ".join(["often"] * 3 + [f"t{x}" for x in r.integers(0, 4000, 60)]) for _ in range(200)]
    frame = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "id long, prompt string, cluster string")
    want = C.cluster_top_words(frame, chunk_chars=10 ** 9).collect()
    chunks = [pa.table({"cluster": ["a"] * 50, "n": pa.array([200] * 50, pa.int64()), "doc": range(i, i + 50), "tok": [t.split() for t in texts[i:i + 50]]}) for i in range(0, 200, 50)]
    told = pa.concat_tables([C._tell(i, t, 0) for i, t in enumerate(chunks)])
    entries = len({(i // 50, w) for i, t in enumerate(texts) for s in [t.split()] for w in [*s, *map(" ".join, zip(s, s[1:]))]})
    assert sum(len(x) for x in told["keys"].to_pylist()) == 8 * entries and told.nbytes < 16 * entries
    back = C._reply(told)
    parts = [C._chunk_scores(t, back.filter(pa.array([c == i for c in back["to_chunk"].to_pylist()])), 0, 10, 0.0, None) for i, t in enumerate(chunks)]
    assert sum(p.num_rows for p in parts) < entries / 2 and all("often" in p["term"].to_pylist() for p in parts)
    real = C._chunk_scores

    def too_high(t, replies, bits, n_top, slack, least):
        out = real(t, replies, bits, n_top, slack, least)
        return out if least is not None else out.slice(0, 0) if not out.num_rows else out.filter(pa.array([x == "often" for x in out["term"].to_pylist()])).set_column(3, "least", pa.array([1e9] * out["term"].to_pylist().count("often"), pa.float64()))
    C._chunk_scores = too_high
    try:
        got = C.cluster_top_words(frame, chunk_chars=4000).collect()
    finally:
        C._chunk_scores = real
    for rows in (got, C.cluster_top_words(frame, chunk_chars=4000).collect()):
        assert sorted((x["rank"], x["term"], round(x["score"], 6)) for x in rows) == sorted((x["rank"], x["term"], round(x["score"], 6)) for x in want)
