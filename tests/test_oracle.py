"""Every registered query against its DuckDB SQL on the smallest tables
(the driver runs the same comparison at sf0.01)."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from quizspark.plans.catalog import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SLOW = {"cluster_search", "density_clusters", "length_regression", "embed_prompts", "prompt_categories",
        "knn_approximate", "neighbour_coords", "embed_wide"}


# the corpus subpackage has tests of its own
CORE = {k: v for k, v in E.queries().items() if k in QUERIES}
CORE_SQL = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(rows):
    def n(v):
        if isinstance(v, float):
            return "NaN" if math.isnan(v) else round(v, 6) + 0.0
        return v
    return sorted((tuple(n(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(CORE_SQL))
def test_matches_duckdb(spark, con, name):
    df = CORE[name](spark, SF_SMALL)
    cols = df.columns
    rel = con.execute(CORE_SQL[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(dcols)
    a = _norm([tuple(r[c] for c in sorted(cols)) for r in df.collect()])
    dr = rel.fetchall()
    b = _norm([tuple(r[dcols.index(c)] for c in sorted(cols)) for r in dr])
    assert a == b


def test_every_query_has_sql_or_is_iterative():
    assert set(CORE) - set(CORE_SQL) <= SLOW | {"reduce_dims"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["question_index", "Category", "llm_difficulty"]
    assert df.count() > 0


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.mark.parametrize("name", sorted(set(CORE) - SLOW - {"reduce_dims"}))
def test_plan_has_no_pair_explosion_or_row_udf(spark, name):
    plan = CORE[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in FORBIDDEN if p in plan]
