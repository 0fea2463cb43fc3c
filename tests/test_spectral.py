"""Coordinates of the neighbour graph: nearer to a curved set than PCA's."""
import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from quizspark.operators import clustering as C
from quizspark.operators.spectral import spectral_coordinates


def _trustworthiness(x, y, k):
    """Share of kept neighbourhoods: penalises new neighbours by their true rank."""
    n = len(x)
    true = np.argsort(np.argsort(((x[:, None] - x[None]) ** 2).sum(-1), axis=1), axis=1)
    near = np.argsort(((y[:, None] - y[None]) ** 2).sum(-1) + np.eye(n) * 1e18, axis=1)[:, :k]
    bad = np.maximum(np.take_along_axis(true, near, axis=1) - k, 0).sum()
    return 1 - bad * 2 / (n * k * (2 * n - 3 * k - 1))


def _roll(n=300):
    rng = np.random.default_rng(1)
    t = 1.5 * np.pi * (1 + 1.6 * rng.random(n))
    return np.column_stack([t * np.cos(t), 4 * rng.random(n), t * np.sin(t)])


def _frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(5)


def test_trustworthiness_above_pca_and_rerun_stable(spark):
    x = _roll()
    df = _frame(spark, x)
    knn = C.knn_graph(df, 10, metric="euclidean").cache()
    got = {r["id"]: r["reduced"] for r in spectral_coordinates(knn, 2, max_rounds=12).collect()}
    y = np.array([got[i] for i in range(len(x))])
    pca = C.reduce_dims(df.withColumn("features", array_to_vector("vec")), 2).select("id", vector_to_array("reduced").alias("r")).collect()
    flat = np.array([r["r"] for r in sorted(pca, key=lambda r: r["id"])])
    assert _trustworthiness(x, y, 10) > _trustworthiness(x, flat, 10)
    again = {r["id"]: r["reduced"] for r in spectral_coordinates(knn.repartition(3), 2, max_rounds=12).collect()}
    assert max(np.abs(np.array(again[i]) - np.array(got[i])).max() for i in got) < 1e-6


def test_eigenvectors_of_a_small_graph(spark):
    x = np.random.default_rng(4).normal(size=(40, 3))
    knn = C.knn_graph(_frame(spark, x), 6, metric="euclidean").cache()
    rows = knn.collect()
    far, w = {}, np.zeros((40, 40))
    for r in rows:
        far[r["id"]] = max(far.get(r["id"], 0), r["dist"])
    for r in rows:
        a, b = r["id"], r["nbr"]
        w[a, b] = w[b, a] = np.exp(-r["dist"] ** 2 / (far[a] * far[b]))
    d = w.sum(1)
    values, vectors = np.linalg.eigh(w / np.sqrt(np.outer(d, d)))
    want = vectors[:, ::-1][:, 1:3] / np.sqrt(d)[:, None]
    got = np.array([r["reduced"] for r in sorted(spectral_coordinates(knn, 2, tol=1e-9).collect(), key=lambda r: r["id"])])
    for j in range(2):
        assert abs(np.corrcoef(got[:, j], want[:, j])[0, 1]) > 0.999
        assert got[np.abs(got[:, j]).argmax(), j] > 0


def test_tiny_and_empty(spark):
    none = spark.createDataFrame([], "id long, nbr long, dist double")
    assert spectral_coordinates(none, 3).count() == 0
    two = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "id long, nbr long, dist double")
    assert all(len(r["reduced"]) == 3 and r["reduced"][1:] == [0.0, 0.0] for r in spectral_coordinates(two, 3).collect())


def test_power_steps_shuffle_no_edges(spark):
    """A row of the block goes once to each part; what a step makes is a row per point, not one per edge."""
    from quizspark.operators import spectral as S
    n = 1200
    rng = np.random.default_rng(2)
    knn = spark.createDataFrame([(i, int(j), float(d)) for i in range(n) for j, d in zip((i + 1 + rng.choice(n - 1, 12, replace=False)) % n, rng.random(12))],
                                "id long, nbr long, dist double").repartition(4).cache()
    s, _ = S._matrix(knn)
    rows, parts = S._parts(s, n)
    x = rows.select("id", "targets", (F.col("id") % 7).cast("double").alias("x0"), (F.col("id") % 5 - 2).cast("double").alias("x1"))
    made = S._times(rows, parts, x, ["x0", "x1"], ["y0", "y1"]).collect()
    w = np.zeros((n, n))
    for r in s.collect():
        w[r["src"], r["dst"]] += r["s"]
    ids = np.arange(n)
    block = np.column_stack([ids % 7, ids % 5 - 2]).astype(float)
    got = {r["id"]: (r["x0"], r["x1"], r["y0"], r["y1"]) for r in made}
    assert len(made) == n and parts > 1
    assert np.allclose([got[i] for i in range(n)], np.hstack([w @ block, block]))
    assert x.select(F.explode("targets")).count() <= n * parts < s.count()
