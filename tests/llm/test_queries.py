"""The queries with SQL against DuckDB on sf0.01, and registration."""

import duckdb
import pytest

import __spark_entry__ as E
from tabscope import llm
from tabscope.sources.tables import TABLES
from tools.check import rows_of

from ..conftest import SF01


def test_one_query_per_operator():
    keys = [k for k in E.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in keys) == list(range(1, 14))
    assert "pipeline" in E.queries()


@pytest.mark.parametrize("key", sorted(llm.oracle_sql()))
def test_matches_duckdb(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    df = llm.queries()[key](spark, SF01)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(llm.oracle_sql()[key])
    names = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, got) == rows_of(names, res.fetchall())
