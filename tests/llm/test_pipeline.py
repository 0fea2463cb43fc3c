"""Each stage on its own input against brute force, on planted rows; the
registered queries have the contract's columns."""
import random

import pytest

import corpus_pipeline as cp
from quizspark.llm import queries as q
from llm.test_decontamination import brute as leak
from llm.test_simhash import brute_components, brute_fingerprint, signed


@pytest.fixture(scope="module")
def planted(spark, docs_of, tmp_path_factory):
    r = random.Random(12)
    word = lambda: r.choice("ra se ti no pu ka".split()) + r.choice("ba ne so lu".split()) + r.choice("n st r".split()) + r.choice(["", "e", "a"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    rows = [(i, text(r.randrange(40, 120)), "en", r.choice(["a", "a", "b", None])) for i in range(240)]
    labels = [(i, 1, int(i % 5 == 2)) for i in range(240)]
    rows = [(i, t + " blargh" if i % 5 == 2 else t, a, b) for i, t, a, b in rows]
    rows += [(1000 + i, rows[i][1].upper() if i % 2 else rows[i][1], "en", "b") for i in range(0, 60, 3)]
    rows += [(2000 + i, text(30) + " " + items[i][1] + " " + text(20), "en", "a") for i in range(5)]
    rows += [(3000, text(50) + " token=abcdef1234567890 " + text(5), "en", "a"), (None, None, None, None)]
    sf = tmp_path_factory.mktemp("sf")
    docs_of(rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return str(sf), rows, items


def test_stages(spark, planted):
    sf, rows, items = planted
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "secrets", "mixing"]
    kept = stage["toxicity"](spark, docs, sf)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted((i or -1) for i, t, *_ in rows if "blargh" not in (t or "").lower())
    alone = stage["simhash_near_dedup"](spark, docs, sf)
    fps = {i: signed(brute_fingerprint(t)) for i, t, *_ in rows}
    comp, least = brute_components(set(fps.values()), 2), {}
    for i, f in fps.items():
        least[comp[f]] = min(least.get(comp[f], (True, 0)), (i is None, i or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in alone.collect()) == sorted(least.values())
    clean = stage["decontamination"](spark, docs, sf)
    assert sorted(r.doc_id or -1 for r in clean.collect()) == sorted((i or -1) for i, t, *_ in rows if not any(leak(t, x) for _, x in items))
    masked = {r.doc_id: r.text for r in stage["secrets"](spark, docs, sf).collect()}
    assert len(masked) == len(rows) and "[SECRET]" in masked[3000] and "abcdef1234567890" not in masked[3000]
    assert all(masked[i] == t for i, t, *_ in rows if i != 3000)
    for f in (kept, alone, clean):
        assert f.columns == docs.columns


def test_run(spark, planted):
    sf, rows, items = planted
    out = cp.run(spark, sf).collect()
    ids = {r.doc_id for r in out}
    assert ids and not ids & set(range(2000, 2006)) and not any("blargh" in r.text for r in out)
    assert all(i < 1000 or i == 3000 for i in ids)
    assert all(0 <= r.mix_position <= 1 for r in out)
    assert cp.ORACLE_SQL is None


def test_query_columns(spark, planted):
    sf = planted[0]
    want = {
        "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op3_simhash": ["doc_id", "fingerprint", "component_id"],
        "op4_mixing": ["doc_id", "size", "source_size", "target", "taken", "position_1", "position_2"],
        "op5_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op7_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op8_language": ["doc_id", "held_out", "lang_pred", "score"],
        "op11_merkle": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        "op12_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
        "op13_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]}
    n = len(planted[1])
    for name, columns in want.items():
        df = q.QUERIES[name](spark, sf)
        assert df.columns == columns and df.count() == n, name
