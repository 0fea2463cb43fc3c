import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from quizspark.llm import simhash as sh
from quizspark.llm.graph import components


def brute_fingerprint(text, k=3):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, r):
    fps, root = sorted(fps), {f: f for f in fps}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= r:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


TEXTS = ["", "one", "One TWO", "a b c", "a b c a b c a b c", "Ünïcode ÄÖ \x85 nbsp\xa0word x", "tab\tnew\nline\x0bvt\x0cff\rcr end",
         "words " * 5000, " ".join(str(i % 97) for i in range(3000))]


@pytest.mark.parametrize("k", [1, 3, 5])
def test_fingerprint_against_brute_force(k, monkeypatch):
    for size in (1 << 20, 50):       # also in small pieces
        monkeypatch.setattr(sh, "pieces", lambda t, size=size: __import__("quizspark.llm.common", fromlist=["pieces"]).pieces(t, size))
        assert [sh.fingerprint(t, k) for t in TEXTS] == [brute_fingerprint(t, k) for t in TEXTS]
    assert sh.fingerprint(None) == 0


def _clouds(seed):
    r = random.Random(seed)
    out = {0, 1, 3, 2 ** 63, 2 ** 63 + 1, 2 ** 64 - 1}
    for _ in range(30):
        base = r.getrandbits(64)
        out.add(base)
        for _ in range(r.randrange(0, 12)):
            base ^= sum(1 << b for b in r.sample(range(64), r.randrange(1, 4)))
            out.add(base)
    dense = r.getrandbits(64)        # many near copies of one text
    out |= {dense ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 4))) for _ in range(150)}
    return out


@pytest.mark.parametrize("bits,cell", [(2, 1000), (2, 4), (1, 4), (3, 1000)])
def test_components_against_brute_force(spark, bits, cell):
    fps = _clouds(bits)
    want = brute_components({signed(f) for f in fps}, bits)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in components(sh.links(df, bits, max_cell=cell)).collect()}
    assert {f: got.get(f, f) for f in want} == want


def test_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300)) and len(got) == 501
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(odd, empty, docs_of):
    got = sh.simhash_components(odd).collect()
    assert len(got) == 8
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.fingerprint for r in by[1] + by[2] + by[3]} == {"0" * 16}
    assert {r.component_id for r in by[1] + by[2] + by[3]} == {1}
    assert sorted(r.fingerprint for r in by[4]) == sorted(format(brute_fingerprint(t), "016x") for t in ("same row twice", "same row twice", "same id"))
    assert sh.simhash_components(empty).count() == 0


def test_one_document_of_each_group_stays(odd, empty, docs_of):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(10, base, "en", "a"), (11, base.upper(), "en", "b"), (12, base, "en", "c"), (13, "quite another text it is", "en", "a")]
    kept = sh.drop_near_duplicates(docs_of(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [10, 13]
    assert kept.columns == docs_of(rows).columns
    left = sh.drop_near_duplicates(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in left) == [
        (False, 1, ""), (False, 4, "same id"), (False, 4, "same row twice"), (True, 0, "some words here")]
    assert sh.drop_near_duplicates(empty).count() == 0
