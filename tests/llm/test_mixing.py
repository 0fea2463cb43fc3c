import random
from fractions import Fraction

from pyspark.sql import functions as F

from quizspark.llm import mixing as mx


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: Fraction((5, 2, 1)[i % 3]) for i, s in enumerate(names)}
    total, capped = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return {s: Fraction(2 * sizes[s]) for s in names}
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            return {s: Fraction(2 * sizes[s]) if s in capped else level * w[s] for s in names}
        capped |= over


def _rows(seed=1, n=400):
    r = random.Random(seed)
    return [(i, " ".join("w" for _ in range(r.randrange(0, 30))), "en", r.choice(["a"] * 6 + ["B", "c", "ä", None, "zz"])) for i in range(n)]


def test_targets_and_taken(docs_of, monkeypatch):
    monkeypatch.setattr(mx, "_ROWS_PER_RANGE", 50)   # several hash ranges
    for seed in (1, 2):
        rows = _rows(seed)
        got = mx.plan_mix(docs_of(rows)).collect()
        assert len(got) == len(rows)
        sizes = {}
        for _, t, _, s in rows:
            sizes[s] = sizes.get(s, 0) + len(t.split())
        want = brute_targets(sizes)
        words, largest = {}, {}
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - float(want[r.source])) < 1e-6
            assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) and len(r.positions) * r.size == r.taken
            assert all(0 <= p <= 1 for p in r.positions)
            words[r.source] = words.get(r.source, 0) + r.taken
            largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert all(abs(words[s] - float(want[s])) <= largest[s] for s in words)
        again = mx.plan_mix(docs_of(rows).repartition(7)).collect()
        assert sorted((r.doc_id, r.taken, r.positions) for r in got) == sorted((r.doc_id, r.taken, r.positions) for r in again)


def test_demand_is_inverted(spark):
    for tilt in (0.25, 1.0, 3.0):
        got = spark.range(11).select(mx._position((F.col("id") * 10).cast("double"), F.lit(100.0), F.lit(tilt)).alias("t")).collect()
        for i, r in enumerate(got):   # D(t) = target * (t + (tilt - 1) t^2 / 2) * 2 / (1 + tilt)
            assert abs(100 * (r.t + (tilt - 1) * r.t ** 2 / 2) * 2 / (1 + tilt) - 10 * i) < 1e-9


def test_order_is_global_and_whole(docs_of):
    out = mx.mix(docs_of(_rows()))
    parts = out.withColumn("part", F.spark_partition_id()).collect()
    assert [r.mix_position for r in sorted(parts, key=lambda r: r.part)] == sorted(r.mix_position for r in parts)
    assert len(parts) == sum(len(r.positions) for r in mx.plan_mix(docs_of(_rows())).collect())
    assert out.columns[:12] == docs_of([]).columns


def test_odd_rows(odd, empty):
    got = mx.plan_mix(odd).collect()
    assert len(got) == 8 and all(r.taken == 0 and r.positions == [] for r in got if r.size == 0)
    assert mx.plan_mix(empty).count() == 0 and mx.mix(empty).count() == 0 and mx.mix(odd).count() > 0
