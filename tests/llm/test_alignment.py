"""Alignment against loops over bytes, with both tokenizers' own libraries."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quizspark.llm import alignment as al
from quizspark.llm import perfect_hash
from quizspark.llm import queries as q

SF_SMALL = "/root/testdata/sf0.001"
TEXTS = ["", None, "hello world", " two  spaces ", "tabs\tand\n\nlines", "<|endoftext|> is text", "a <0x41> b", "under▁score", "\x00nul",
         "日本語のテキスト 😀😀 é é", "ﬁne ligature", "x" * 500, "=" * 300 + "-" * 301, "don't 12345 'll", "hello world", " ", "\n",
         "ab " * 400, " nbsp", "▁", "Größe naïve Ελλάδα привет"]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(al.VOCABULARY_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=al.VOCABULARY_B)


def brute(rows, tools):
    a_tok, b_tok = tools
    letters = al._byte_letters()
    seen, docs = Counter(), []
    for doc_id, text in rows:
        groups = []
        if text:
            raw = (" " + text).encode()
            enc = a_tok.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(letters[c] for c in a_tok.id_to_token(i))) for i in enc.ids]
            b = []
            for i in b_tok.encode(text):
                p = b_tok.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                i = j = at_a = at_b = 0
                group = ([], [])
                while i < len(a) or j < len(b):
                    if at_a <= at_b:
                        group[0].append(a[i][0])
                        at_a += len(a[i][1])
                        i += 1
                    else:
                        group[1].append(b[j][0])
                        at_b += len(b[j][1])
                        j += 1
                    if at_a == at_b:
                        groups.append(group)
                        group = ([], [])
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        seen.update(set(links))
        docs.append((doc_id, groups, links))
    best = Counter()
    for (x, _), n in seen.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                    sum(seen[p] == best[p[0]] for p in links), sum(seen[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _made_up(n, seed=4):
    r = random.Random(seed)
    pool = ["hello", "World", "tokenization", "überall", "слово", "数据", "1234", "  ", "\n", "foo_bar", "https://x.y/z?q=1", "😀", "<|endoftext|>", "▁"]
    return [" ".join(r.choice(pool) + r.choice(["", "s", "ing", "."]) for _ in range(r.randrange(0, 60))) for _ in range(n)]


def test_against_brute_force(docs_of, tools):
    rows = list(enumerate(TEXTS + _made_up(60)))
    got = _got(al.align(docs_of(rows).repartition(7)))
    want = brute(rows, tools)
    assert got == want
    assert sum(r[1] == 0 for r in want) >= 4 and any(r[4] > r[1] for r in want)


def test_several_slabs_shards_and_tree_levels(docs_of, tools, monkeypatch):
    rows = [(i % 70, t) for i, t in enumerate(TEXTS + _made_up(60))] + [(1, "hello world"), (1, "hello world"), (None, None)]
    for name, value in (("SHARD_KEYS", 64), ("SLAB_KEYS", 256), ("FAN", 2), ("BATCH_BYTES", 100), ("CHUNK_CHARS", 3)):
        monkeypatch.setattr(al, name, value)
    assert _got(al.align(docs_of(rows).repartition(7))) == brute(rows, tools)


def test_links_in_pieces_are_the_same(monkeypatch):
    class Two:
        n_a, n_b, kind = 50, 40, np.dtype("<u2")
        a_len, b_len = np.ones(50, np.int64), np.ones(40, np.int64)
    r = random.Random(1)
    a = [r.randrange(1, 50) for _ in range(300)]
    Two.a_len[0], Two.b_len[0] = 300, 200
    # one group of 100 x 200 tokens that cannot be cut, then single ones
    coded = [([0] + a[:5], [0] + [1] * 100 + [r.randrange(1, 40) for _ in range(5)]), (a[:9], [2] * 9)]
    coded = [tuple(np.array(x, "<u2").tobytes() for x in c) for c in coded]
    whole = [x.tolist() for x in al.Aligned(Two, coded).links()]
    monkeypatch.setattr(al, "MAX_LINKS", 7)
    assert [x.tolist() for x in al.Aligned(Two, coded).links()] == whole
    assert sum(whole[2]) == int(al.Aligned(Two, coded).n_links.sum())


def test_odd_rows_and_empty(odd, empty, tools):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert _got(al.align(odd)) == brute(rows, tools)
    assert al.align(empty).count() == 0


def test_query_on_the_small_table(spark, tools):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert _got(q.op12_alignment(spark, SF_SMALL)) == brute(rows, tools)


def test_perfect_hash_is_minimal_and_knows_its_keys():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 1 << 40, 20_000))
    shard = keys % 5
    table = perfect_hash.Table([perfect_hash.build(keys[shard == s]) for s in range(5)])
    at = table.number(keys, shard)
    assert sorted(at) == list(range(len(keys))) and (table.keys[at] == keys).all()
    assert (table.number(keys + (1 << 41), shard) == -1).all()
    assert (perfect_hash.Table([]).number(keys[:3], shard[:3] * 0) == -1).all()
    assert all(len(x) == 0 for x in perfect_hash.build(keys[:0]))


def test_pieces_by_part_are_those_of_the_text(tools, monkeypatch):
    monkeypatch.setattr(al, "CHUNK_CHARS", 5)
    tok = al.Tokenizers(open(al.VOCABULARY_A, "rb").read(), open(al.VOCABULARY_B, "rb").read())
    r = random.Random(6)
    texts = [t for t in TEXTS if t] + ["".join(r.choice("   \n\tab\u00e9\u3000e\u0301.\u2581日😀0") for _ in range(r.randrange(1, 90))) for _ in range(600)]
    for text in texts:
        if "▁" in text:
            assert tok.encode(text) is None
            continue
        assert tok.encode_b(" " + text) == tools[1].encode(text), text


def test_byte_bpe_equals_its_library(tools):
    tok = al.Tokenizers(open(al.VOCABULARY_A, "rb").read(), open(al.VOCABULARY_B, "rb").read())
    for text in [t for t in TEXTS if t] + _made_up(200, 9):
        assert tok.a.encode_ordinary(" " + text) == tools[0].encode(" " + text, add_special_tokens=False).ids
