"""Row order of files: the position of every row, from scan metadata.

A file scan knows where each row comes from: a Parquet scan gives the row's number
in its file, a text scan (CSV) the file and the first byte of the block, inside
which rows come in order. With the number of rows per file, or per block, summed up
in front (one row per file or block of the scan, never per row), that is the row's
number in the whole table: files by path, rows in file order. No sort, no shuffle of
rows, no key column.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Hidden place of a row: file, first byte of the block, number inside the block.
PLACE = ("__file", "__block", "__at")


def placed(scan: DataFrame) -> DataFrame:
    """``scan``, a plain file scan (columns may be selected or cast, rows
    filtered), with each row's place in ``PLACE``. Raises ``ValueError`` for frames
    that are no scan of files: these have no row order of their own."""
    try:
        known = scan.select("_metadata").schema["_metadata"].dataType.names
    except AnalysisException:
        raise ValueError("rows have no file order here; name the columns to order by") from None
    file = F.col("_metadata.file_path").alias("__file")
    if "row_index" in known:
        return scan.select("*", file, F.lit(0).cast("long").alias("__block"), F.col("_metadata.row_index").alias("__at"))
    # Inside a block this id only counts up; where it starts does not matter.
    return scan.select("*", file, F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))


def numbered(df: DataFrame, out: str = "_row") -> DataFrame:
    """Replace the place of :func:`placed` by the row's 0-based number.

    The rows are written once (so that what follows does not parse them again);
    counts per block are read back from the narrow place columns. Rows filtered out
    before have no number: the remaining ones are numbered without gaps.
    """
    rows = materialize(df, "placed")
    blocks = rows.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"),
                                                   F.max("__at").alias("last"))
    files = blocks.groupBy("__file").agg(F.sum("n").alias("all"))
    # One row per file; then one per block, file by file.
    before_file = F.sum("all").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))
    before_block = F.sum("n").over(Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    start = (blocks.withColumn("before", before_block)
             .join(files.select("__file", before_file.alias("__f")), "__file")
             .select("__file", "__block", "n", "first", "last",
                     (F.coalesce("before", F.lit(0)) + F.coalesce("__f", F.lit(0))).alias("start")))
    start = materialize(start, "blocks")
    gaps = start.where(F.col("last") - F.col("first") + 1 != F.col("n")).limit(1).count()
    if gaps:  # rows were filtered out: number what is left of each block
        inside = F.row_number().over(Window.partitionBy("__file", "__block").orderBy("__at")) - 1
        rows = rows.withColumn("__at", inside)
        start = start.withColumn("first", F.lit(0))
    return (rows.join(start.select("__file", "__block", "first", "start"), ["__file", "__block"])
            .withColumn(out, F.col("start") + F.col("__at") - F.col("first")).drop(*PLACE, "first", "start"))


def with_row_order(scan: DataFrame, out: str = "_row") -> DataFrame:
    """``scan`` with its rows' numbers in file order."""
    return numbered(placed(scan), out)
