import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from quizspark.session import ship_package
    ship_package(spark)


@pytest.fixture(scope="session")
def docs_of(spark):
    """DataFrame like ``documents`` from (doc_id, text, lang, source) rows, with
    extra columns whose names operators use inside."""
    def make(rows):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                               T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                               T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
                               T.StructField("fp", T.StringType()), T.StructField("row_number", T.StringType()),
                               T.StructField("Key", T.StringType()), T.StructField("node", T.StringType()),
                               T.StructField("size", T.StringType()), T.StructField("label", T.StringType())])
        full = [(r + (None, None))[:4] for r in rows]
        return spark.createDataFrame([(d, t, la, so, None if t is None else len(t)) + ("x",) * 7 for d, t, la, so in full], schema)
    return make


#: Nulls in any column, empty texts, white space only, repeated rows and ids.
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (None, "some words here", "de", "b"),
       (4, "same row twice", "en", "a"), (4, "same row twice", "en", "a"), (4, "same id", None, "a"), (None, None, None, None)]


@pytest.fixture
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture
def empty(docs_of):
    return docs_of([])
