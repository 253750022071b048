"""CSV scan S1, type inference S2, validation S3.

The scan reads every field as text; S2 then decides each column's type in a
single aggregate over all columns (regex classes, counted with ``count_if``)
and casts in one ``select``. ``inferSchema`` would run its own pass and turn
date-like text into dates; the source tool keeps dates as text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import INSIGHT, classify
from ..operators._long import col
from .order import numbered, placed

# The text tokens read as missing (pandas ``read_csv`` defaults),
# the boolean spellings, and the number patterns.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
INT_PATTERN = r"^[+-]?[0-9]+$"
FLOAT_PATTERN = (r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
                 r"|^[+-]?(inf|Inf|INF|infinity|Infinity)$")


def _reader(spark: SparkSession, multi_line: bool):
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
                 .option("multiLine", multi_line).option("inferSchema", False))


def _parts(spark: SparkSession, path: str, multi_line: bool | None) -> list[tuple[object, bool]]:
    """The files of a CSV in one or two lots ``(paths, multi_line)``.

    With ``multi_line=None`` one scan of the lines looks for files with line breaks
    inside quotes: there a line has an odd number of quotes. Only those files are
    read as wholes (a task each); the others are split into blocks as usual."""
    if multi_line is not None:
        return [(path, multi_line)]
    lines = spark.read.text(path)
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    found = (lines.groupBy("_metadata.file_path").agg(F.max(quotes % 2).alias("odd")).collect())  # a row per file
    broken = sorted(r["file_path"] for r in found if r["odd"])
    if not broken:
        return [(path, False)]
    others = sorted(r["file_path"] for r in found if not r["odd"])
    return [(broken, True), *([(others, False)] if others else [])]


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None, row_order: str | None = None) -> DataFrame:
    """Header row, comma separated, ``"``-quoted fields (``""`` inside a
    quote, line breaks too), every field as text.

    Files with line breaks inside quotes are found by a scan of their own and read
    as wholes; ``multi_line=False`` spares that scan where it is known that there are
    none, ``True`` reads every file as a whole. ``row_order`` adds a column with the
    rows' 0-based numbers in file order (files by path)."""
    schema = _reader(spark, False).csv(path).schema
    out = None
    for paths, whole in _parts(spark, path, multi_line):
        part = _reader(spark, whole).schema(schema).csv(paths)
        part = placed(part) if row_order else part
        out = part if out is None else out.unionByName(part)
    return numbered(out, row_order) if row_order else out


def raw_header(spark: SparkSession, path: str) -> list[str]:
    """The header line as written (Spark renames duplicate names; S3 needs
    the originals). Reads one row."""
    row = (spark.read.option("header", False).option("quote", '"').option("escape", '"')
                .csv(path).limit(1).collect())
    return [] if not row else [v if v is not None else "" for v in row[0]]


def malformed_rows(spark: SparkSession, path: str, width: int, multi_line: bool | None = None) -> int:
    """Rows with more fields than the header (fewer are filled with NULL). The
    reader gets one column more than the header has; what lands there is extra."""
    fields = ", ".join(f"_{i} string" for i in range(width)) + ", __extra string"
    return sum(_reader(spark, whole).schema(fields).option("enforceSchema", True).csv(paths)
               .where(F.col("__extra").isNotNull()).count() for paths, whole in _parts(spark, path, multi_line))


def na_columns(columns: Sequence[str], tokens=NA_TOKENS) -> list:
    return [F.when(col(c).isin(list(tokens)), F.lit(None).cast("string")).otherwise(col(c)).alias(c) for c in columns]


def na_to_null(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    """Missing-value tokens → NULL in every text column."""
    return df.select(*na_columns(df.columns, tokens))


def infer_types(df: DataFrame) -> DataFrame:
    """``(column, position, type, nulls)`` for a frame of text columns:
    ``bigint`` if every present value is an integer of 64 bits, ``double`` if
    every one is a number (longer integers count as such) (or none is present), ``boolean`` if every one is a boolean
    spelling, else ``string``. One aggregate for all columns."""
    df = na_to_null(df)
    aggs = []
    for i, c in enumerate(df.columns):
        x = col(c)
        aggs += [F.count(x).alias(f"n{i}"),
                 F.count_if(x.rlike(INT_PATTERN) & x.try_cast("bigint").isNotNull()).alias(f"i{i}"),
                 F.count_if(x.rlike(INT_PATTERN) | x.rlike(FLOAT_PATTERN)).alias(f"f{i}"),
                 F.count_if(x.isin(*(TRUE_TOKENS + FALSE_TOKENS))).alias(f"b{i}"),
                 F.count_if(x.isNull()).alias(f"z{i}")]
    row = df.agg(*aggs)
    parts = []
    for i, c in enumerate(df.columns):
        n, ni, nf, nb = (F.col(f"{p}{i}") for p in "nifb")
        t = (F.when((n > 0) & (ni == n), "bigint").when(nf == n, "double")
             .when(nb == n, "boolean").otherwise("string"))
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                              t.alias("type"), F.col(f"z{i}").alias("nulls")))
    return row.select(F.explode(F.array(*parts)).alias("t")).select("t.*")


def apply_types(df: DataFrame, types: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Cast text columns to the inferred types (NA tokens → NULL first); columns in
    ``keep`` stay as they are, at the end."""
    names = [c for c in df.columns if c not in keep]
    df = df.select(*na_columns(names), *[col(c) for c in keep])
    out = [col(c) for c in keep]
    for c in reversed(names):
        t = types.get(c, "string")
        x = col(c)
        if t == "boolean":
            x = F.when(x.isin(*TRUE_TOKENS), True).when(x.isin(*FALSE_TOKENS), False)
        elif t == "double":
            low = F.lower(x)
            x = (F.when(low.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
                 .when(low.isin("-inf", "-infinity"), F.lit(float("-inf")))
                 .otherwise(x.try_cast("double")))
        elif t == "bigint":
            x = x.try_cast("bigint")
        out.insert(0, x.alias(c))
    return df.select(*out)


def load_csv(spark: SparkSession, path: str, multi_line: bool | None = None, row_order: str | None = None) -> DataFrame:
    """S1 + S2: read a CSV and type its columns (one inference job). ``row_order``
    as in :func:`read_csv`."""
    raw = read_csv(spark, path, multi_line, row_order)
    texts = raw.drop(row_order) if row_order else raw
    types = {r["column"]: r["type"] for r in infer_types(texts).collect()}
    return apply_types(raw, types, keep=[row_order] if row_order else [])


# The rule names and messages of the validation, in order.
RULES = ("exists", "not_empty", "has_rows", "two_columns", "unique_names",
         "no_empty_columns", "numeric_column")


def validate_frame(df: DataFrame, header: list[str] | None = None,
                   exists: bool = True, size: int | None = None) -> DataFrame:
    """S3 over a typed frame: ``(position, rule, passed, detail)``; the first
    failed rule is the verdict (see :func:`verdict`). One aggregate counts the
    rows and the present values of every column."""
    spark = df.sparkSession
    names = header if header is not None else df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count(col(c)).alias(f"c{i}")
                                                  for i, c in enumerate(df.columns)]
    row = df.agg(*aggs).first() if exists else None
    rows = row["_rows"] if row else 0
    empty = [c for i, c in enumerate(df.columns) if row and row[f"c{i}"] == 0]
    numeric = classify(df, INSIGHT).numeric
    checks = [
        ("exists", exists, "" if exists else "File not found."),
        ("not_empty", size is None or size > 0, "File is empty." if size == 0 else ""),
        ("has_rows", rows > 0, "" if rows else "No data found in the file."),
        ("two_columns", len(names) >= 2, "" if len(names) >= 2 else "File must contain at least 2 columns."),
        ("unique_names", len(names) == len(set(names)),
         "" if len(names) == len(set(names)) else "File contains duplicate column names."),
        ("no_empty_columns", not empty,
         "" if not empty else f"File contains empty columns: {', '.join(empty)}"),
        ("numeric_column", len(numeric) > 0,
         "" if numeric else "File must contain at least one numeric column for visualization."),
    ]
    return spark.createDataFrame([(i, r, bool(p), d) for i, (r, p, d) in enumerate(checks)],
                                 "position int, rule string, passed boolean, detail string")


def verdict(checks: DataFrame) -> DataFrame:
    """``(valid, message)``: the first failed rule wins."""
    failed = checks.where(~F.col("passed")).orderBy("position").limit(1)
    first = failed.collect()
    spark = checks.sparkSession
    if first:
        return spark.createDataFrame([(False, first[0]["detail"])], "valid boolean, message string")
    return spark.createDataFrame([(True, "File validation successful.")], "valid boolean, message string")


def checked_csv(spark: SparkSession, path: str, multi_line: bool | None = None,
                row_order: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """S3 for a CSV path with the table it has judged: existence and size from the
    file system, then the table rules on the typed frame (read once; None if there
    is nothing to read). Options as in :func:`read_csv`."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    nothing = spark.createDataFrame([], "x string")
    if not fs.exists(p):
        return validate_frame(nothing, [], exists=False), None
    size = fs.getContentSummary(p).getLength()
    if size == 0:
        return validate_frame(nothing, [], size=0), None
    header = raw_header(spark, path)
    table = load_csv(spark, path, multi_line, row_order)
    checks = validate_frame(table.drop(row_order) if row_order else table, header, size=size)
    extra = malformed_rows(spark, path, len(header), multi_line)
    if extra:
        checks = checks.union(spark.createDataFrame(
            [(1, "parses", False, f"Error validating file: {extra} rows have more fields than the header.")],
            checks.schema))
    return checks, table


def validate_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """S3 for a CSV path: the checks of :func:`checked_csv`."""
    return checked_csv(spark, path, multi_line)[0]
