"""Filters, browsing and column choice: B4–B9 and S8.

Row order only exists through an explicit ``order_by`` key: ``orderBy`` +
``limit`` plans as ``TakeOrderedAndProject`` (a per-partition top-k, then a
merge of k rows per partition), so no step gathers the table in one task.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import date, datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.order import PLACE, placed
from ._long import col


def _text(name: str) -> Column:
    return F.lower(col(name).cast("string"))


_NOTHING = object()


def _typed(dt: T.DataType, v: str):
    """Literal of the column's own type for the text ``v``; ``_NOTHING`` if no
    value of that type reads so; None for types that are compared as text."""
    try:
        if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            d = Decimal(v)
            bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}[type(dt)]
            fits = d == d.to_integral_value() and -(2 ** (bits - 1)) <= d < 2 ** (bits - 1)
            return int(d) if fits else _NOTHING
        if isinstance(dt, T.DecimalType):
            return Decimal(v) if Decimal(v).is_finite() else _NOTHING
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            return F.lit(float(v)).cast(dt)
        if isinstance(dt, T.DateType):
            return date.fromisoformat(v) if len(v) == 10 else _NOTHING
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            datetime.fromisoformat(v)
            return F.lit(v).cast(dt) if len(v) >= 19 and v[10] == " " else _NOTHING
    except (ArithmeticError, ValueError):
        return _NOTHING
    return None


def eq_filter(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Keep rows where, for every ``column → value``, the column's text
    form equals the value case-insensitively. A column that does not exist
    reads as ``''``. Numeric, date and timestamp columns are compared as such
    (engines print floats differently, and a typed comparison reaches the
    scan); a value that is no such number or time matches no row."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    conds = []
    for name, value in filters.items():
        v = str(value).lower()
        if name not in dtypes:
            conds.append(F.lit(v == ""))
            continue
        typed = _typed(dtypes[name], v)
        if typed is not None:
            conds.append(F.lit(False) if typed is _NOTHING
                         else col(name) == (typed if isinstance(typed, Column) else F.lit(typed)))
        else:
            conds.append(_text(name) == F.lit(v))
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def isin_filter(df: DataFrame, filters: Mapping[str, Sequence[object]]) -> DataFrame:
    """Keep rows whose value is in the column's list, for every listed
    column that exists (unknown columns are ignored). Pushed into the scan."""
    conds = [col(c).isin(list(vals)) for c, vals in filters.items() if c in df.columns]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def preview(df: DataFrame, order_by: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """First ``n`` rows in key order (``TakeOrderedAndProject``), or without
    keys the first rows of a file scan in file order: those of its first file, if
    it has enough of them, else of all."""
    if order_by is not None:
        return df.orderBy(*[col(c) for c in order_by]).limit(n)
    rows = placed(df)
    # The scan's metadata spell a local path with one slash.
    first = re.sub("^file:/+", "file:/", min(df.inputFiles(), default=""))
    head = rows.where(F.col("__file") == F.lit(first))
    rows = head if head.limit(n).count() == n else rows
    return rows.orderBy(*PLACE).limit(n).drop(*PLACE)


def _search_cond(df: DataFrame, term: str, column: str | None) -> Column:
    t = term.strip().lower()
    cols = [column] if column is not None else df.columns
    conds = [F.coalesce(_text(c).contains(t), F.lit(False)) for c in cols if c in df.columns]
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def search(df: DataFrame, term: str, column: str | None = None) -> DataFrame:
    """Rows whose text form contains the trimmed, lower-cased ``term`` in
    ``column`` (or in any column). An empty term keeps every row."""
    if not term.strip():
        return df
    return df.where(_search_cond(df, term, column))


def search_page(df: DataFrame, term: str, order_by: Sequence[str], page: int = 0,
                column: str | None = None, page_size: int = 10) -> DataFrame:
    """One page (0-based) of the search result in key order."""
    hits = search(df, term, column).orderBy(*[col(c) for c in order_by])
    return hits.offset(page * page_size).limit(page_size) if page else hits.limit(page_size)


def search_after(df: DataFrame, term: str, order_by: Sequence[str], after: Sequence[object] | None = None,
                 column: str | None = None, page_size: int = 10) -> DataFrame:
    """The page behind the row whose ``order_by`` values are ``after`` (the
    last row of the page before; None: the first page). Its cost does not grow
    with the page number: each page is one top-k of ``page_size`` rows."""
    hits = search(df, term, column)
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for name, value in zip(order_by, after):
            beyond = beyond | (equal & (col(name) > F.lit(value)))
            equal = equal & (col(name) == F.lit(value))
        hits = hits.where(beyond)
    return hits.orderBy(*[col(c) for c in order_by]).limit(page_size)


def search_summary(df: DataFrame, term: str, column: str | None = None,
                   page_size: int = 10) -> DataFrame:
    """``(matches, pages)`` with pages = ceil(matches / page_size)."""
    return (search(df, term, column).agg(F.count(F.lit(1)).alias("matches"))
            .select("matches", F.ceil(F.col("matches") / F.lit(page_size)).cast("bigint")
                    .alias("pages")))


def hash_order(key: str) -> Column:
    """Deterministic pseudo-random order of rows: md5 of the key's text."""
    return F.md5(col(key).cast("string"))


def scatter_sample(df: DataFrame, x: str, y: str, key: str, category: str | None = None,
                   n: int = 50) -> DataFrame:
    """``n`` real (x, y[, category]) points – rows with both values,
    picked by md5 order of the key, so the sample is reproducible and spread
    over the table."""
    cols = [col(x).alias(x), col(y).alias(y)] + ([col(category).alias(category)] if category else [])
    return (df.where(col(x).isNotNull() & col(y).isNotNull())
              .orderBy(hash_order(key), col(key)).limit(n).select(*cols))


def choose_columns(df: DataFrame, target: str | None = None,
                   exclude: Sequence[str] = ()) -> DataFrame:
    """Drop the target and excluded columns; missing names are ignored."""
    drop = [c for c in ([target] if target else []) + list(exclude) if c in df.columns]
    return df.drop(*drop)


def recent_top(df: DataFrame, ts: str, key: str, k: int = 5,
               group: str | None = None) -> DataFrame:
    """Newest-first top ``k`` (ties by key), optionally per ``group``.

    Without a group this is ``TakeOrderedAndProject``; per group it is a
    ``row_number`` filter that Spark plans with a partial ``WindowGroupLimit``
    before the shuffle, so a hot group sends ≤ k rows per task."""
    order = [col(ts).desc(), col(key).asc()]
    if group is None:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(col(group)).orderBy(*order)
    return (df.withColumn("rank", F.row_number().over(w))
              .where(F.col("rank") <= k))
