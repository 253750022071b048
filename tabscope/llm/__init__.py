"""Operators of a training-data pipeline, one module each, and their queries.

Nothing else in the library imports this package. ``queries()`` and
``oracle_sql()`` are picked up by ``__spark_entry__.py``.
"""

from __future__ import annotations

from importlib import import_module

_MODULES = ("mixing", "sharding", "fingerprint", "near_dup", "token_files", "quality", "line_dedup", "pieces", "substring_dedup", "pii",
            "language", "divergence", "dual_tree")


def _all() -> dict:
    out = {}
    for name in _MODULES:
        out |= import_module(f".{name}", __name__).QUERIES
    return out


def queries() -> dict:
    return {k: fn for k, (fn, _) in _all().items()}


def oracle_sql() -> dict:
    return {k: sql.strip() for k, (_, sql) in _all().items() if sql}
