import random
import zlib

import numpy as np

from quizspark.llm import language as lg

SYLLABLES = {"en": "th he in er an re on at en nd", "de": "en er ch sch ei ie te ung ge ü", "fr": "es le re ou ai eau é è que la"}


def _rows(n=900):
    r = random.Random(2)
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        s = SYLLABLES[lang].split()
        rows.append((i, " ".join("".join(r.choice(s) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(15, 60))), lang, "s"))
    return rows


def brute_presence(text, n_max):
    t = " " + "".join(c.lower() if c.isalpha() else " " for c in text) + " "
    t = " ".join(t.split(" ")) if False else __import__("re").sub(" +", " ", t)
    return {t[i:i + n] for n in range(1, n_max + 1) for i in range(len(t) - n + 1)}


def test_presence_counts_distinct_grams():
    for text in ("Hello, hello WORLD!", "a", "ä-ß 12 x", "x" * 50):
        got = lg.presence(text, 20, 3).sum()
        want = len(brute_presence(text, 3))
        assert abs(int(got) - want) <= 1   # a hash collision at most
    assert lg.presence("123 !?", 13, 3) is None and lg.presence(None, 13, 3) is None and lg.presence("", 13, 3) is None
    long_text = "the then " * 300_000 + "zxqj"
    assert (lg.presence(long_text, 13, 4) == lg.presence("the then the then zxqj", 13, 4)).all()


def test_held_out_accuracy(spark, docs_of):
    rows = _rows()
    docs = docs_of(rows)
    model = lg.fit(docs, per_language=150, landmarks=60)
    got = {r.doc_id: r for r in lg.predict(docs, model).collect()}
    assert len(got) == 900
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert len(held) > 100 and all(got[i].held_out for i, *_ in held)
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in held]) >= 0.99
    assert all(0 <= r.score <= 1 for r in got.values())


def test_learns_only_from_allowed_rows(docs_of):
    held = [r for r in _rows(200) if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert lg.fit(docs_of(held)).languages == []
    assert lg.fit(docs_of([(1, "text", None), (2, "123", "en"), (None, "abc", "en")])).languages == []


def test_odd_rows(docs_of, odd, empty):
    model = lg.fit(docs_of(_rows(120)))
    got = lg.predict(odd, model).collect()
    assert len(got) == 8 and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert {r.lang_pred for r in lg.predict(odd, lg.fit(empty)).collect()} == {"und"}
    assert lg.predict(empty, model).count() == 0
