"""Fingerprints against the exact generalised Jaccard similarity, and the
neighbours against a sorted list."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quizspark.llm import queries as q
from quizspark.llm import weighted_sampling as ws

SF_SMALL = "/root/testdata/sf0.001"


def jaccard(a, b):
    x, y = Counter(ws.term_hashes(a).tolist()), Counter(ws.term_hashes(b).tolist())
    every = set(x) | set(y)
    return sum(min(x[i], y[i]) for i in every) / sum(max(x[i], y[i]) for i in every) if every else 1.0


def slow_signature(text):
    """The definition, term by term and sample by sample."""
    terms = Counter(ws.term_hashes(text).tolist())
    out = np.zeros(ws.SAMPLES, np.uint16)
    for k in range(ws.SAMPLES):
        best = None
        for h, w in terms.items():
            r, rest, log_c = (x[0, k] for x in ws._draws(np.array([h], np.uint64)))
            t = np.floor(np.float32(np.log(w)) / r + (1 - rest))
            a = log_c - r * rest - r * t
            if best is None or a < best[0]:
                best = (a, h, int(t))
        if best:
            out[k] = int(ws.mix(np.array([(best[1] + best[2]) % 2 ** 64], np.uint64), 3)[0]) & 0xFFFF
    return out


def _prose(r, n, words=400):
    return " ".join(f"w{int(r.paretovariate(0.7)) % words}" for _ in range(n))


def test_signature_by_its_definition():
    r = random.Random(2)
    for text in ["", "one", "one two", "a b a b a b a b", _prose(r, 120, 9), _prose(r, 700), "x" * 90, "short " + "長い" * 40]:
        assert (ws.signatures([text])[0] == slow_signature(text)).all()
    texts = [_prose(r, 50), "", _prose(r, 900, 30)]
    assert all((a == ws.signatures([t])[0]).all() for a, t in zip(ws.signatures(texts), texts))


def test_collision_rate_is_the_generalised_jaccard():
    r, errors = random.Random(5), []
    for i in range(300):
        base = _prose(random.Random(i), 200, 3000 * (i + 1)).split()
        a = [f"{w}_{i}" for w in base]
        b = list(a)
        for _ in range(r.randrange(0, 120)):
            b[r.randrange(len(b))] = r.choice([f"n{r.random()}", *a])
        a, b = " ".join(a), " ".join(b)
        x, y = ws.signatures([a, b])
        errors.append(ws.likeness(x, y) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.5 / np.sqrt(ws.SAMPLES) * 1.2


def brute(rows):
    """``rows``: (doc_id, text)."""
    import xxhash
    def h(t):
        x = xxhash.xxh64_intdigest((t or "").encode(), seed=42)
        return x - (1 << 64) if x >> 63 else x
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h(r[1])))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        new = text[:len(text) - len(text) // 4] + after[:len(text) // 4]
        x, y, z = (ws.signatures([t])[0] for t in (text, new, after))
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), ws.written(x), ws.written(y), ws.likeness(x, y), ws.likeness(x, z)))
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_against_brute_force(spark, docs_of, parts):
    r = random.Random(parts)
    rows = [(i * 3 - 50, r.choice([None, "", "é😀 x", _prose(r, r.randrange(1, 40)), "same text here again"])) for i in range(120)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert _got(ws.fingerprints(docs_of(rows).repartition(5))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_alike_rows_are_sent_once_and_dealt_out_again(docs_of):
    rows = [(7, "the same row every time")] * 700 + [(i, f"text number {i}") for i in range(30)] + [(None, "no id")] * 300
    assert _got(ws.fingerprints(docs_of(rows).repartition(9))) == brute(rows)


def test_odd_rows_empty_and_single(docs_of, odd, empty):
    assert _got(ws.fingerprints(odd)) == brute([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert ws.fingerprints(empty).count() == 0
    (only,) = ws.fingerprints(docs_of([(1, "one text that is its own next one")])).collect()
    assert only.near_next == 1.0


def test_query_on_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert _got(q.op13_fingerprints(spark, SF_SMALL)) == brute(rows)


def test_terms_that_a_text_shares_with_its_edit_are_hashed_once(monkeypatch):
    import random
    from quizspark.llm import weighted_sampling as W
    rng = random.Random(2)
    odd = ["".join(rng.choice(" ab\n\t\x0b\x0c\ré" + "x" * k) for _ in range(rng.randint(0, 60))) for k in (0, 3, 40, 80) * 100]
    for a, b in zip(odd, odd[1:]):
        new = W.edited(a, b)
        got = W.edited_hashes(a, new, len(a) - len(a) // 4)
        assert [x.tolist() for x in got] == [W.term_hashes(a).tolist(), W.term_hashes(new).tolist()]
    made, hashed = [], W.xxhash.xxh3_64_intdigest

    class Counted:
        xxh3_64_intdigest = staticmethod(lambda x: made.append(x) or hashed(x))
    monkeypatch.setattr(W, "xxhash", Counted)
    text = " ".join(f"w{i}" for i in range(400))
    W.edited_hashes(text, W.edited(text, "z " * 500), len(text) - len(text) // 4)
    assert len(made) < 650  # about 800 where each text is hashed by itself
