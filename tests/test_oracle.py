"""Every catalog query with oracle SQL must equal DuckDB on the same Parquet
(sf0.01): same columns, same row count, same multiset of values."""

import duckdb
import pytest

import __spark_entry__ as E
from tabscope.sources.tables import TABLES
from tools.check import rows_of

from .conftest import SF01

KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(KEYS) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, con, key):
    sdf = E.queries()[key](spark, SF01)
    srows = [tuple(r) for r in sdf.collect()]
    con.execute(f"CREATE OR REPLACE VIEW oracle AS {E.oracle_sql()[key]}")  # as the gate does
    res = con.execute("SELECT * FROM oracle")
    onames = [c[0] for c in res.description]
    orows = res.fetchall()
    assert sorted(sdf.columns) == sorted(onames)
    assert len(srows) == len(orows)
    assert rows_of(sdf.columns, srows) == rows_of(onames, orows)


def test_entry_smoke(spark):
    out = E.entry(spark)
    assert out.count() == 8
    assert out.columns[:3] == ["column", "position", "n"]
