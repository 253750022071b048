"""Long-form helpers shared by the profile, insight and cleaning operators.

Many columns are handled in one pass by turning a wide frame into
``(column, value)`` rows (``unpivot`` → ``Expand``) and grouping on
``(column, value)``. The group-by runs with partial aggregation on the map
side, so a value that fills a third of the table costs one partial row per
task, not a third of the table in one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import quote


def col(name: str) -> Column:
    """Column by exact name (names may hold dots, blanks or ``?``)."""
    return F.col(quote(name))


def clean_number(name: str, dt: T.DataType) -> Column:
    """Numeric column as double with NaN turned into NULL (pandas has one null)."""
    c = col(name)
    if isinstance(dt, T.BooleanType):
        return c.cast("double")
    c = c.cast("double")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)
    return c


def text_form(name: str, dt: T.DataType) -> Column:
    """Text form of any flat column; NaN of a floating column becomes NULL."""
    c = col(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
    return c.cast("string")


def to_long(df: DataFrame, columns: Sequence[str], numeric: bool,
            keep: Sequence[str] = (), drop_nulls: bool = True) -> DataFrame:
    """Unpivot ``columns`` to ``(*keep, column, value)``.

    ``numeric=True`` gives ``value double`` (NaN → NULL), else ``value string``.
    """
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    conv = clean_number if numeric else text_form
    values = [conv(c, dtypes[c]).alias(c) for c in columns]
    # Id columns get private names: a key may also be one of the values.
    ids = [col(k).alias(f"__id{i}") for i, k in enumerate(keep)]
    wide = df.select(*ids, *values)
    long = wide.unpivot(
        ids=[F.col(f"__id{i}") for i in range(len(keep))], values=[col(c) for c in columns],
        variableColumnName="column", valueColumnName="value",
    )
    for i, k in enumerate(keep):
        long = long.withColumnRenamed(f"__id{i}", k)
    if drop_nulls:
        long = long.where(F.col("value").isNotNull())
    return long


def histogram(df: DataFrame, columns: Sequence[str], numeric: bool) -> DataFrame:
    """``(column, value, cnt)``: one row per distinct non-null value per column.

    This is the single shuffle behind distinct counts, value counts, medians,
    modes and filter options.
    """
    if not columns:
        vt = "double" if numeric else "string"
        return df.sparkSession.createDataFrame(
            [], f"column string, value {vt}, cnt bigint")
    return (to_long(df, columns, numeric)
            .groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("cnt")))


def order_expr(columns: Sequence[str], name: str = "column") -> Column:
    """Position of ``name`` within ``columns`` (schema order) as an int column,
    for ``first N columns`` cuts and stable output order."""
    if not columns:
        return F.lit(0)
    return F.array_position(F.array(*[F.lit(c) for c in columns]), F.col(name)).cast("int") - 1


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a frame whose row count is bounded by the schema (one row per
    column, per column pair or per bucket) – never by the data.

    Frames whose size depends on the data are joined without a hint; AQE turns
    such joins into broadcast joins only after it has measured the built side.
    """
    return F.broadcast(df)
