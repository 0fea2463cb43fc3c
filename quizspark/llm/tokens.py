"""Token counts as an exact length histogram.

Every whole text is encoded once; documents are then only their token count,
aggregated to a histogram by length (combined on the map side, so a hot length
costs one row per task). Suffix sums over the histogram answer every question
about context limits: for a limit L, the documents with at least L tokens, the
total of min(length, L) and the quantiles.

Suffix sums run over ranges of ``width`` lengths: a window inside each range
and a small window over the range totals, so no task holds the whole table.

Defined results: null and empty texts have length 0; strings of special tokens
are ordinary text; repeated rows count each; an empty table gives an empty
result. Only ``text`` is read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizspark.llm.common import shared_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict = {}


def _encoder(ranks_text: bytes):
    import tiktoken
    key = hash(ranks_text)
    if key not in _LOADED:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks_text.splitlines() if x)}
        _LOADED[key] = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


def token_counter(spark: SparkSession, vocabulary: str = VOCABULARY):
    """Column function: tokens of a text (null: 0). The vocabulary file (under a
    megabyte) is read once by the driver and broadcast."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    if len(ranks) > 64 << 20:
        raise ValueError("vocabulary file over 64 MB: too large to broadcast")
    sent = spark.sparkContext.broadcast(ranks)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(sent.value).encode_ordinary
        for s in texts:
            yield pd.Series([len(encode(t)) if t else 0 for t in s], dtype="int64")
    udf = F.pandas_udf(run, "long")
    return lambda text: udf(text.cast("string"))


def histogram(lengths: DataFrame, length: Column) -> DataFrame:
    return lengths.groupBy(length.cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def limits(hist: DataFrame, width: int = 4096) -> DataFrame:
    """For every length L that occurs: n_docs of it, docs_at_least (length >= L),
    docs_up_to, tokens_up_to (all tokens of documents with length <= L),
    truncated_total (sum of min(length, L)) and total (sum of lengths).
    Between two neighbouring lengths truncated_total is a straight line, so the
    rows answer every limit; the p-quantile is the least L with
    docs_up_to >= p * docs."""
    h = shared_table(hist.withColumn("range", F.floor(F.col("length") / width)).withColumn("tokens", F.col("length") * F.col("n_docs")))
    per = h.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    past = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of lengths
    base = per.select("range", F.coalesce(F.sum("d").over(past), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(past), F.lit(0)).alias("t0"))
    s = per.agg(F.sum("d"), F.sum("t")).first()
    inside = Window.partitionBy("range").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = (h.withColumn("d1", F.sum("n_docs").over(inside)).withColumn("t1", F.sum("tokens").over(inside))
           .join(base, "range").withColumn("docs", F.lit(s[0] or 0)).withColumn("total", F.lit(s[1] or 0)))
    up_docs, up_tokens = F.col("d0") + F.col("d1"), F.col("t0") + F.col("t1")
    return out.select(
        "length", "n_docs", (F.col("docs") - up_docs + F.col("n_docs")).alias("docs_at_least"),
        up_docs.alias("docs_up_to"), up_tokens.alias("tokens_up_to"),
        (up_tokens + (F.col("docs") - up_docs) * F.col("length")).alias("truncated_total"),
        F.col("docs").cast("long").alias("docs"), F.col("total").cast("long").alias("total"))


def truncated_total(limits_table: DataFrame, limit: int) -> int:
    """Sum of min(length, limit) over all documents, for any limit."""
    at = limits_table.where(F.col("length") <= limit).orderBy(F.desc("length")).first()
    if at is None:
        docs = limits_table.select("docs").first()
        return docs["docs"] * limit if docs else 0
    return at["tokens_up_to"] + (at["docs"] - at["docs_up_to"]) * limit
