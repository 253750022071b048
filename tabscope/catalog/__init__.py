"""Query catalog: one entry per operator of SURVEY §2, each with the DuckDB
SQL that must give the same rows (``None`` where only rows/invariants are
checked). Keys start with the lower-case op id.

Derived fixtures follow FIXTURES.md (B) and are built the same way on both
sides; every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Decorator: add a query (and its oracle SQL, if any) to the catalog."""
    def wrap(fn: Query) -> Query:
        if key in _QUERIES:
            raise KeyError(f"duplicate query key {key}")
        _QUERIES[key] = fn
        if sql is not None:
            _ORACLE[key] = sql.strip()
        return fn
    return wrap


def _load_all() -> None:
    from . import (  # noqa: F401 - registration side effects
        q_browse,
        q_features,
        q_insights,
        q_models,
        q_profile,
        q_sources,
    )


def queries() -> dict[str, Query]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)
