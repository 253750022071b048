"""Column type classes: the one place that decides which columns
count as numeric, categorical or temporal.

Two modes mirror the two rules of the source tool:

* ``"profile"`` – profiling and cleaning: booleans count as numeric (0/1).
* ``"insight"`` – validation, insights: booleans count as categorical.

Dates and timestamps are categorical in both modes (they are profiled by their
text form); ``temporal`` lists them separately so the trend step can use them.
Nested columns (array/map/struct/binary) cannot occur in CSV input; when a
Parquet input has them they are left out and listed in ``rejected``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PROFILE = "profile"
INSIGHT = "insight"


@dataclass(frozen=True)
class ColumnClasses:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    temporal: tuple[str, ...] = ()
    boolean: tuple[str, ...] = ()
    rejected: tuple[str, ...] = field(default=())

    @property
    def all(self) -> tuple[str, ...]:
        return self.numeric + self.categorical


def _is_nested(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_temporal_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def classify(df_or_schema: DataFrame | T.StructType, mode: str = PROFILE,
             strict: bool = False) -> ColumnClasses:
    """Split columns into type classes, keeping schema order.

    ``strict=True`` raises on nested columns instead of listing them.
    """
    schema = df_or_schema.schema if isinstance(df_or_schema, DataFrame) else df_or_schema
    numeric, categorical, temporal, boolean, rejected = [], [], [], [], []
    for f in schema.fields:
        dt = f.dataType
        if _is_nested(dt):
            if strict:
                raise TypeError(f"column {f.name!r} has nested type {dt.simpleString()}")
            rejected.append(f.name)
        elif isinstance(dt, T.BooleanType):
            boolean.append(f.name)
            (numeric if mode == PROFILE else categorical).append(f.name)
        elif is_numeric_type(dt):
            numeric.append(f.name)
        else:
            if is_temporal_type(dt):
                temporal.append(f.name)
            categorical.append(f.name)
    return ColumnClasses(tuple(numeric), tuple(categorical), tuple(temporal),
                         tuple(boolean), tuple(rejected))


def quote(name: str) -> str:
    """Backtick-quote a column name for SQL expressions (names may hold
    blanks, dots or ``?``)."""
    return "`" + name.replace("`", "``") + "`"
