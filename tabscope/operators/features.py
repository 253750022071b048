"""Feature preparation F1–F7."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.order import PLACE, placed, with_row_order
from ..types import PROFILE, classify
from ._long import bounded_broadcast, col, to_long
from .encoding import label_codes  # noqa: F401  (F2)
from .rank import row_index

# Fixed value: text columns with fewer distinct values than this get encoders.
ENCODER_MAX_DISTINCT = 20


def first_appearance_codes(df: DataFrame, order_by: str | None = None, columns: Sequence[str] | None = None,
                           max_distinct: int | None = ENCODER_MAX_DISTINCT) -> DataFrame:
    """``(column, value, code)``: codes 0, 1, … in order of first appearance
    (by ``order_by``, or without it in the row order of a file scan); NULL is a
    category of its own.

    With ``max_distinct`` only columns with fewer distinct values are encoded
    and the per-column numbering window is bounded by that guard. Without it
    (a target mapping of any size) exactly one column is allowed and the codes
    come from the distributed :func:`rank.row_index`.
    """
    cols = list(columns) if columns is not None else list(classify(df, PROFILE).categorical)
    by = [order_by] if order_by is not None else list(PLACE)
    long = to_long(df if order_by is not None else placed(df), cols, numeric=False, keep=by, drop_nulls=False)
    at = col(by[0]) if len(by) == 1 else F.struct(*[col(c) for c in by])
    first = long.groupBy("column", "value").agg(F.min(at).alias("_first"))
    if max_distinct is None:
        if len(cols) != 1:
            raise ValueError("unbounded codes need exactly one column")
        return (row_index(first, ["_first", "value"], "code")
                .select("column", "value", F.col("code").cast("int").alias("code")))
    nd = (first.groupBy("column").agg(F.count(F.lit(1)).alias("_nd"))
               .where(F.col("_nd") < max_distinct))
    w = Window.partitionBy("column").orderBy("_first", "value")
    return (first.join(bounded_broadcast(nd), "column")
                 .select("column", "value", (F.row_number().over(w) - 1).cast("int").alias("code")))


def one_hot(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``get_dummies``: numeric columns first, then one 0/1 column
    ``<column>_<value>`` per category of each text column (sorted by value);
    NULL sets all of its columns to 0. The categories become the schema, so
    they are known to the driver; :func:`tabscope.operators.encoding.one_hot_cells`
    and :class:`~tabscope.operators.encoding.TextEncoder` give the same cells
    with a schema that does not grow with the data."""
    cls = classify(df, PROFILE)
    cats = list(columns) if columns is not None else list(cls.categorical)
    if not cats:
        return df
    found: dict[str, list[str]] = {c: [] for c in cats}
    for r in to_long(df, cats, numeric=False).select("column", "value").distinct().toLocalIterator():
        found[r["column"]].append(r["value"])
    keep = [col(c) for c in df.columns if c not in cats]
    dummies = [F.when(col(c).cast("string") == F.lit(v), 1).otherwise(0).cast("int").alias(f"{c}_{v}")
               for c in cats for v in sorted(found[c])]
    return df.select(*keep, *dummies)


def split_bucket(key: str):
    """Deterministic 0..9999 bucket of a key: first 8 hex digits of md5(key)."""
    return F.conv(F.substring(F.md5(col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % 10000


def train_test_split(df: DataFrame, key: str, test_size: float = 0.2,
                     out: str = "split") -> DataFrame:
    """add ``split`` ∈ {train, test}: a row is test when its md5 bucket is
    below ``10000 * test_size``. Independent of partitioning and repeatable."""
    return df.withColumn(out, F.when(split_bucket(key) < int(round(10000 * test_size)), "test")
                         .otherwise("train"))


def kfold(df: DataFrame, order_by: str | None = None, k: int = 5, out: str = "fold") -> DataFrame:
    """``k`` contiguous folds in ``order_by`` order (without it in the row order
    of a file scan), the first ``n % k`` one row larger (same sizes as ``ntile``),
    numbered without a global window."""
    rows = with_row_order(df, "_i") if order_by is None else row_index(df, [order_by], "_i")
    n = df.count()
    q, r = divmod(n, k)
    idx = F.col("_i")
    big = r * (q + 1)
    fold = F.when(idx < big, F.floor(idx / F.lit(q + 1))).otherwise(
        F.lit(r) + F.floor((idx - F.lit(big)) / F.lit(max(q, 1))))
    return rows.withColumn(out, fold.cast("int")).drop("_i")


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """assemble numeric feature columns into one vector column."""
    return VectorAssembler(inputCols=list(features), outputCol=out,
                           handleInvalid="keep").transform(df)
