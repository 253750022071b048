"""Helpers shared by the catalog modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure
from ..sources.tables import load

# Significant digits kept in compared doubles. Fixed decimals would put
# exact averages of 2-decimal money values right on a rounding tie, where the
# engines' last-bit differences pick different sides; 10 significant digits
# keep both the ties and the float noise (~1e-14 relative) away.
DIGITS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return load(spark, sf_dir, name)


def sig(c, digits: int = DIGITS):
    """Round a double column to ``digits`` significant digits."""
    c = c.cast("double")
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.format_string(f"%.{digits}g", c).cast("double"))


def rounded(df: DataFrame, digits: int = DIGITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column to ``digits`` significant digits so both
    engines' last-bit differences (summation order) vanish before hashing."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in keep:
            c = sig(c, digits)
        out.append(c.alias(f.name))
    return df.select(*out)


def r(expr: str, digits: int = DIGITS) -> str:
    """DuckDB side of :func:`rounded`."""
    return f"printf('%.{digits}g', ({expr})::DOUBLE)::DOUBLE"
