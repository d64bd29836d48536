"""Text queries that SQL can express against their DuckDB statement."""

import duckdb
import pytest

from feefloor.llm.queries import QUERIES, SQL
from tests.test_oracles import SF, rows

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert set(names) <= set(df.columns)
    found = rows(names, df.select(*names).collect())
    assert found and found == rows(names, result.fetchall())


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_pairwise_join(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, f"{bad} in {name}"
