"""Corpus preparation in five stages, each calling one operator of
``quizspark.llm``. Each stage works on all that its predecessor kept; all but
the last return the columns of ``documents``, with as many rows as they keep:

1. toxicity: documents that the factorization machine scores one half or more go;
2. SimHash near-duplicates: the document with the smallest id of each
   component stays (shingles of 3 words, 2 bits);
3. decontamination: documents with a window like a benchmark item go;
4. secrets: documents stay, with every secret in their text masked;
5. mixing: the training order, copies and positions of the curriculum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quizspark.llm import decontamination, mixing, secrets, simhash, toxicity
from quizspark.llm.common import fresh, shared_table, table
from quizspark.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "toxicity")
    return docs.withColumn(name, toxicity.score(model, docs["text"])).where(f"`{name}` < 0.5").drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.drop_near_duplicates(docs, shingle_words=3, max_bits=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("decontamination", drop_contaminated),
          ("secrets", mask_secrets), ("mixing", mix_sources)]

#: Learnt models and fingerprints are beyond SQL; the tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared_table(docs)   # written as Parquet and read again
    return docs
