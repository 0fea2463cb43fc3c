"""The manifest against a tree built level by level in plain Python."""
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quizspark.llm import merkle
from quizspark.llm import queries as q


def _field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def _leaf(r, text):
    return merkle.H(*[_field(x) for x in (r[0], r[3], r[2], r[4], text)])


def _tree(digests, arity):
    path, own = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, held = [], []
        for s in range(0, len(digests), arity):
            run = digests[s:s + arity]
            for k in range(len(run)):
                for i in own[s + k]:
                    path[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            above.append(merkle.H(*run))
            held.append(sum(own[s:s + arity], []))
        digests, own = above, held
    return digests[0], path


def brute(rows, arity=3):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1])))
        trees[s] = _tree([_leaf(r, r[1]) for r in by[s]], arity)
    root, top = _tree([trees[s][0] for s in order], arity)
    out = []
    for s, high in zip(order, top):
        for r, low in zip(by[s], trees[s][1]):
            text, name = r[1], "" if r[0] is None else str(r[0])
            if text is not None and zlib.crc32(name.encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = _leaf(r, text)
            for left, right in low + high:
                now = merkle.H(left, now, right)
            out.append((r[0], _leaf(r, r[1]), trees[s][0], root, merkle.H(*[a + b for a, b in low + high]), now, now == root))
    return sorted(out, key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("depth,arity", [(1, 3), (2, 3), (5, 3), (2, 2)])
def test_against_brute_force(docs_of, depth, arity):
    rnd = random.Random(depth)
    sources = [None, "", "é", "z", "Z", "hot", "hot", "hot"] + [f"only{i}" for i in range(30)]
    rows = [(i - 20, rnd.choice([None, "", "a\nb", f"text {i}", "über\n😀"]), rnd.choice([None, "en"]), rnd.choice(sources)) for i in range(300)]
    docs = docs_of(rows)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = _rows(merkle.manifest(docs, F.translate("text", "\n", ""), even, arity, depth))
    assert got == brute([(*r, None if r[1] is None else len(r[1])) for r in rows], arity)


def test_odd_rows_and_empty(odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert _rows(merkle.line_breaks_lost(odd)) == brute(rows)
    assert merkle.line_breaks_lost(empty).count() == 0


def test_one_document_is_its_own_root(docs_of):
    r = merkle.line_breaks_lost(docs_of([(7, "no break", "en", "a")])).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == merkle.H()


def test_tampering_is_found_and_nothing_else(docs_of):
    rows = [(i, f"line {i}\nend", "en", f"s{i % 4}") for i in range(100)]
    for r in merkle.line_breaks_lost(docs_of(rows)).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 2 == 1)


def test_queue_order_is_children_first():
    order = [(level, i) for level, i, _ in merkle.forward([str(i) for i in range(14)], 3, 3)]
    assert order == [(1, 0), (1, 1), (1, 2), (2, 0), (1, 3), (1, 4), (2, 1), (3, 0)]


def test_sql_on_odd_rows(odd):
    rows = odd.select("doc_id", "text", "lang", "source", "n_chars").toArrow()
    con = duckdb.connect()
    con.register("documents", rows)
    got = con.sql(q.oracle_sql()["op11_merkle"]).fetchall()
    assert sorted(got, key=repr) == brute([tuple(r.values()) for r in rows.to_pylist()])
