"""Profiling aggregations C1–C9.

Design: algebraic statistics (count, min, max, mean, sample std) for all
numeric columns go in one wide ``agg`` (partial + final hash aggregate, one
row out). Everything that needs distinct values – distinct counts, value
counts, medians, filter options – comes from one ``(column, value)`` group-by
(:func:`_long.histogram`), which is distributed by value. Exact medians use
:func:`rank.bracketed_quantiles` instead of the ``median`` aggregate, whose final
buffer would hold every distinct value of a column in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import PROFILE, classify
from ._long import bounded_broadcast, clean_number, col, histogram, order_expr, text_form, to_long
from .rank import bracketed_quantiles

NUMERIC_PROFILE_SCHEMA = (
    "column string, position int, n bigint, min double, max double, mean double, "
    "median double, std double, unique_values bigint")


def _numeric_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return list(columns) if columns is not None else list(classify(df, PROFILE).numeric)


def _categorical_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return list(columns) if columns is not None else list(classify(df, PROFILE).categorical)


def numeric_stats(df: DataFrame, columns: Sequence[str]) -> dict:
    """One wide aggregate → ``{column: (n, min, max, mean, std)}`` (driver-sized:
    five numbers per column); the table's row count is under key ``None``."""
    if not columns:
        return {None: df.count()}
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    exprs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(columns):
        x = clean_number(c, dtypes[c])
        exprs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                  F.avg(x).alias(f"mu{i}"), F.stddev_samp(x).alias(f"sd{i}")]
    row = df.agg(*exprs).first()
    out = {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"], row[f"mu{i}"], row[f"sd{i}"])
           for i, c in enumerate(columns)}
    out[None] = row["_rows"]
    return out


def medians(df: DataFrame, columns: Sequence[str], stats: dict | None = None) -> dict:
    """Exact interpolated median per numeric column (pandas ``median``), by two
    scans (:func:`rank.bracketed_quantiles`): no value is shuffled but the few that
    lie near the middle. Columns that ``stats`` shows to be constant need none."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    stats = stats or {}
    known = {c: _f(stats[c][1]) for c in columns if c in stats and (not stats[c][0] or stats[c][1] == stats[c][2])}
    rest = [c for c in columns if c not in known]
    if not rest:
        return known
    wide = df.select(*[clean_number(c, dtypes[c]).alias(c) for c in rest])
    return known | bracketed_quantiles(wide)


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """``(column, position, n, min, max, mean, median, std, unique_values)``.

    ``std`` is the sample standard deviation (NULL for one value), as pandas.
    ``exact=False`` takes one scan and shuffles nothing: ``median`` and
    ``unique_values`` then come from sketches, within the bounds of
    :mod:`tabscope.operators.states`; the others stay exact.
    """
    spark = df.sparkSession
    cols = _numeric_columns(df, columns)
    if cols and not exact:
        from . import states as S
        return S.profile_of(S.column_states(df.select(*[col(c) for c in cols]))).drop("numeric")
    if not cols:
        return spark.createDataFrame([], NUMERIC_PROFILE_SCHEMA)
    stats = numeric_stats(df, cols)
    med = medians(df, cols, stats)
    # The one shuffle of values: distinct counts need it.
    distinct = {r["column"]: r["count"] for r in
                histogram(df, cols, numeric=True).groupBy("column").count().collect()}
    distinct |= _wide_distinct(df, cols, stats)
    rows = []
    for i, c in enumerate(cols):
        n, lo, hi, mu, sd = stats[c]
        rows.append((c, i, int(n), _f(lo), _f(hi), _f(mu), _f(med.get(c)), _f(sd),
                     int(distinct.get(c, 0))))
    return spark.createDataFrame(rows, NUMERIC_PROFILE_SCHEMA)


def _wide_distinct(df: DataFrame, cols: Sequence[str], stats: dict) -> dict:
    """Distinct counts of integer and decimal columns that a double cannot hold
    (beyond 2**53, or more than 15 digits): counted on their own text."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}

    def wide(c: str) -> bool:
        if isinstance(dtypes[c], T.DecimalType):
            return dtypes[c].precision > 15
        _, lo, hi, *_ = stats[c]
        return isinstance(dtypes[c], T.LongType) and lo is not None and max(abs(lo), abs(hi)) >= 2.0 ** 53

    found = [c for c in cols if wide(c)]
    if not found:
        return {}
    return {r["column"]: r["count"] for r in
            histogram(df, found, numeric=False).groupBy("column").count().collect()}


def _f(x):
    return None if x is None else float(x)


def value_counts(df: DataFrame, columns: Sequence[str] | None = None,
                 top: int | None = None) -> DataFrame:
    """``(column, value, count)`` for every non-null value (text form).

    ``top`` keeps the ``top`` most frequent values per column (ties by value);
    Spark plans this as a partial ``WindowGroupLimit`` before the shuffle, so a
    near-unique column does not land in one task.
    """
    cols = _categorical_columns(df, columns)
    hist = histogram(df, cols, numeric=False).withColumnRenamed("cnt", "count")
    if top is None:
        return hist
    from pyspark.sql import Window
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return hist.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None,
                    numeric: bool = False) -> DataFrame:
    """``(column, unique_values)``; nulls are not a value (pandas ``nunique``)."""
    cols = (_numeric_columns if numeric else _categorical_columns)(df, columns)
    return (histogram(df, cols, numeric=numeric).groupBy("column")
            .agg(F.count(F.lit(1)).alias("unique_values")))


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, position, unique_values, value, count)`` – the value
    counts with the distinct count of their column attached."""
    cols = _categorical_columns(df, columns)
    vc = value_counts(df, cols)
    nd = vc.groupBy("column").agg(F.count(F.lit(1)).alias("unique_values"))
    return (vc.join(bounded_broadcast(nd), "column")
              .select("column", order_expr(cols).alias("position"), "unique_values",
                      "value", "count"))


def filter_options(df: DataFrame, columns: Sequence[str] | None = None,
                   max_distinct: int = 20) -> DataFrame:
    """``(column, options)``: sorted distinct values of categorical columns
    with fewer than ``max_distinct`` of them. Each collected list is bounded by
    the guard."""
    cols = _categorical_columns(df, columns)
    vc = value_counts(df, cols)
    nd = (vc.groupBy("column").agg(F.count(F.lit(1)).alias("nd"))
            .where(F.col("nd") < max_distinct))
    return (vc.join(bounded_broadcast(nd), "column")
              .groupBy("column")
              .agg(F.array_sort(F.collect_list("value")).alias("options")))


def table_card(df: DataFrame) -> DataFrame:
    """C4: ``(rows, columns, numeric_columns, categorical_columns)``."""
    cls = classify(df, PROFILE)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(len(cls.numeric)).cast("bigint").alias("numeric_columns"),
        F.lit(len(cls.categorical)).cast("bigint").alias("categorical_columns"))


def chart_series(profile: DataFrame) -> DataFrame:
    """Numeric chart series ``(column, stat, value)`` with stat in
    Min/Mean/Median/Max, from a C1 profile."""
    return profile.select(
        "column", "position",
        F.expr("stack(4, 'Min', min, 'Mean', mean, 'Median', median, 'Max', max) "
               "as (stat, value)"))


def category_share(df: DataFrame, columns: Sequence[str] | None = None,
                   decimals: int = 1) -> DataFrame:
    """``(column, value, count, share)`` with share = percent of the
    column's non-null rows, rounded to ``decimals``. The per-column total is a
    small join, not a window, so no column is gathered into one task."""
    vc = value_counts(df, columns)
    tot = vc.groupBy("column").agg(F.sum("count").alias("_total"))
    return (vc.join(bounded_broadcast(tot), "column")
              .select("column", "value", "count",
                      F.round(F.col("count") * 100.0 / F.col("_total"), decimals).alias("share")))


def multi_select_counts(df: DataFrame, column: str, sep: str = r",\s*") -> DataFrame:
    """Split list-valued text on ``sep`` and count each trimmed option:
    ``(option, count)``."""
    return (df.select(F.explode(F.split(col(column), sep)).alias("option"))
              .select(F.trim("option").alias("option"))
              .where(F.col("option") != "")
              .groupBy("option").agg(F.count(F.lit(1)).alias("count")))


# The provider labels of the domain chart; everything else is
# "Other".
PROVIDERS = {"gmail": "Gmail", "outlook": "Outlook", "yahoo": "Yahoo"}
OTHER = "Other"

EMAIL_DOMAIN = r"@([A-Za-z0-9.-]+)"
URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


def domain_share(df: DataFrame, column: str, kind: str = "email",
                 providers: dict | None = PROVIDERS, decimals: int = 1) -> DataFrame:
    """``(domain, count, share)``: domain of an e-mail address or URL host,
    mapped to a provider label by its first label (``providers``) or ``Other``;
    with ``providers=None`` the lower-case host itself is the label. Rows
    without a domain are left out."""
    pattern = EMAIL_DOMAIN if kind == "email" else URL_HOST
    host = F.lower(F.regexp_extract(col(column), pattern, 1))
    if providers is None:
        label = host
    else:
        first = F.substring_index(host, ".", 1)
        label = F.lit(OTHER)
        for key, name in reversed(list(providers.items())):
            label = F.when(first == key, F.lit(name)).otherwise(label)
    counts = (df.select(host.alias("_h"), label.alias("domain"))
                .where(F.col("_h") != "")
                .groupBy("domain").agg(F.count(F.lit(1)).alias("count")))
    total = counts.agg(F.sum("count").alias("_total"))
    return (counts.crossJoin(bounded_broadcast(total))
                  .select("domain", "count",
                          F.round(F.col("count") * 100.0 / F.col("_total"), decimals).alias("share")))


def text_columns(df: DataFrame) -> list[str]:
    return list(classify(df, PROFILE).categorical)


__all__ = [
    "numeric_stats", "medians", "numeric_profile", "value_counts", "distinct_counts",
    "categorical_profile", "filter_options", "table_card", "chart_series",
    "category_share", "multi_select_counts", "domain_share", "text_form",
]
