import random

from pyspark.sql import functions as F

from quizspark.llm import tokens as tk


def test_limits_against_brute_force(spark):
    r = random.Random(8)
    lengths = [r.choice([0, 1, 5, 5, 5, 900, r.randrange(0, 20_000)]) for _ in range(600)]
    df = spark.createDataFrame([(n,) for n in lengths], "n long")
    out = tk.limits(tk.histogram(df, F.col("n")), width=500).collect()
    assert {x.length for x in out} == set(lengths)
    for x in out:
        assert x.n_docs == lengths.count(x.length) and x.docs == 600 and x.total == sum(lengths)
        assert x.docs_at_least == sum(n >= x.length for n in lengths) and x.docs_up_to == sum(n <= x.length for n in lengths)
        assert x.tokens_up_to == sum(n for n in lengths if n <= x.length) and x.truncated_total == sum(min(n, x.length) for n in lengths)
    table = tk.limits(tk.histogram(df, F.col("n"))).cache()
    for limit in (0, 1, 3, 1000, 12345, 10 ** 6):
        assert tk.truncated_total(table, limit) == sum(min(n, limit) for n in lengths)


def test_counts_are_exact(spark, docs_of, odd, empty):
    import tiktoken
    count = tk.token_counter(spark)
    texts = ["", None, "Hello world's <|endoftext|> end", "é😀 ümlaut\n\n  x", "12345 abc" * 50, "word " * 200_000]
    got = {r.doc_id: r.n for r in docs_of(list(enumerate(texts))).select("doc_id", count(F.col("text")).alias("n")).collect()}
    enc = tk._encoder(open(tk.VOCABULARY, "rb").read())
    assert isinstance(enc, tiktoken.Encoding)
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i] == len(ids) and enc.decode(ids) == (t or "")
    assert tk.limits(tk.histogram(odd, count(F.col("text")))).agg(F.sum("n_docs")).first()[0] == 8
    assert tk.limits(tk.histogram(empty, count(F.col("text")))).count() == 0
