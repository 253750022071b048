"""Cleaning B1–B3: drop all-null rows, median fill of numeric
columns, ``'Unknown'`` fill of the rest – the order the source tool applies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import PROFILE, classify
from ._long import clean_number, col
from .profile import medians, numeric_stats

# Fixed value: the fill text of non-numeric columns.
UNKNOWN = "Unknown"


def drop_all_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """B1: drop rows where every column (of ``columns``) is null (NaN counts as
    null)."""
    conds = []
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        c = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            conds.append(c.isNotNull() & ~F.isnan(c))
        else:
            conds.append(c.isNotNull())
    if not conds:
        return df
    keep = conds[0]
    for c in conds[1:]:
        keep = keep | c
    return df.where(keep)


def median_fill(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """B2: fill nulls (and NaN) of numeric columns with the column's exact
    interpolated median. A column that gets filled becomes double, as a pandas
    integer column holding NaN is float; untouched columns keep their type."""
    cols = list(columns) if columns is not None else list(classify(df, PROFILE).numeric)
    if not cols:
        return df
    stats = numeric_stats(df, cols)
    rows = stats[None]
    holes = [c for c in cols if stats[c][0] < rows]
    if not holes:
        return df
    med = medians(df, holes, stats)
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in df.schema.fields:
        if f.name in holes:
            fill = med.get(f.name)
            c = clean_number(f.name, dtypes[f.name])
            if fill is not None:
                c = F.coalesce(c, F.lit(float(fill)))
            out.append(c.alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)


def unknown_fill(df: DataFrame, columns: Sequence[str] | None = None,
                 value: str = UNKNOWN) -> DataFrame:
    """Fill nulls of non-numeric columns with ``'Unknown'``. Temporal
    columns are turned into their text form first (the filled column holds
    text, as in pandas)."""
    cls = classify(df, PROFILE)
    cols = set(columns if columns is not None else cls.categorical)
    out = []
    for f in df.schema.fields:
        if f.name in cols:
            out.append(F.coalesce(col(f.name).cast("string"), F.lit(value)).alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)


def clean(df: DataFrame) -> DataFrame:
    """B1 → B2 → B3 as one lazy chain (plus the median jobs of B2)."""
    return unknown_fill(median_fill(drop_all_null(df)))
