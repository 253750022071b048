"""Row records out S4: one JSON object per row (``to_json(struct(*))``), or a
JSON-lines folder written by the executors – never gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators._long import col


def to_records(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """``(record)`` with one compact JSON object per row; a missing value
    is a ``null`` field, so every record has every key. ``order_by`` is kept
    alongside for ordered reads."""
    rec = F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("record")
    return df.select(col(order_by).alias(order_by), rec) if order_by else df.select(rec)


def write_records(df: DataFrame, path: str) -> None:
    """S4 sink: JSON lines, one file per task."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
