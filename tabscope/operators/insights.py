"""Statistical insights I1–I11 plus the overview C10 and headline C11
(SURVEY §2.3–2.4). Insight mode: booleans count as categorical.

Scale notes: correlations are one wide algebraic aggregate (batched above
``PAIR_BATCH`` pairs); outliers join a one-row-per-column stats frame
(broadcast, bounded by the schema) to the long form; "first k in row order"
cuts use ``row_number`` per column, planned as a partial ``WindowGroupLimit``
before the shuffle; monthly trends window only over already aggregated
months.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import pearson, skew_class, skew_corrected, t_two_sided_p
from ..session import materialize
from ..sources.order import PLACE, placed
from ..types import INSIGHT, PROFILE, classify
from ._long import bounded_broadcast, clean_number, col, histogram, order_expr, to_long
from .profile import medians, numeric_stats

# Words that mark a date column by name, and prompt words that
# select the custom analyses.
DATE_WORDS = ("date", "time", "year", "month", "day")
DISTRIBUTION_WORDS = ("distribution", "histogram", "frequency")
COMPARE_WORDS = ("compare", "comparison", "versus", "vs")


def numeric_columns(df: DataFrame) -> list[str]:
    return list(classify(df, INSIGHT).numeric)


def categorical_columns(df: DataFrame) -> list[str]:
    return list(classify(df, INSIGHT).categorical)


# --------------------------------------------------------------------- I1–I3
#: Columns whose pairs (at most 32,000) are held by the driver.
FEW_COLUMNS = 250


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(i, j, col1, col2, r, abs_r)`` for every numeric pair i < j, over
    pairwise-complete rows; NULL r when a side is constant.

    One scan whatever the number of columns: each task adds up ``X'X``, ``X'M``,
    ``(X*X)'M`` and ``M'M`` batch by batch, ``M`` being the mask of present values
    and ``X`` the values less a mark near them (the mean of some first rows), and
    sends one row per pair, which are summed; the diagonal carries count, smallest
    and largest. A column whose mean turns out to be a thousand standard deviations
    from its mark (the sums would lose digits) is marked with its mean, and the
    scan is done again. An infinite value makes its column's r NULL.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    spark = df.sparkSession
    schema = "i int, j int, col1 string, col2 string, r double, abs_r double"
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    x = df.select(*[clean_number(c, dtypes[c]).alias(f"x{i}") for i, c in enumerate(cols)])
    some = np.array(x.limit(1000).toArrow().to_pandas(), dtype=float).reshape(-1, len(cols))
    finite = np.where(np.isfinite(some), some, np.nan)
    mark = np.array([float(np.nanmean(v)) if np.isfinite(v).any() else 0.0 for v in finite.T])
    while True:
        gram = x.mapInArrow(_gram(mark), GRAM).groupBy("i", "j").agg(
            *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "p")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        # A row per pair: few enough to come here, or else written.
        gram = spark.createDataFrame(gram.toArrow()) if len(cols) <= FEW_COLUMNS else materialize(gram, "gram")
        own = {r["i"]: r for r in gram.where("i = j").collect()}  # a row per column
        const = [i not in own or own[i]["n"] == 0 or own[i]["lo"] == own[i]["hi"] for i in range(len(cols))]
        far = {}
        for i, r in own.items():
            if r["n"] and math.isfinite(r["qa"]):
                off = r["sa"] / r["n"]
                if off * off > 1e6 * max(r["qa"] / r["n"] - off * off, 0.0) and not const[i]:
                    far[i] = mark[i] + off
        if not any(abs(mark[i] - v) > 1e-9 * abs(v) for i, v in far.items()):
            break
        for i, v in far.items():
            mark[i] = v
    gram = gram.where("i < j")
    cov = F.col("p") - F.col("sa") * F.col("sb") / F.col("n")
    va, vb = (F.col(q) - F.col(s) * F.col(s) / F.col("n") for q, s in (("qa", "sa"), ("qb", "sb")))
    names = spark.createDataFrame([(i, c, const[i]) for i, c in enumerate(cols)], "k int, name string, const boolean")
    left = names.select(F.col("k").alias("i"), F.col("name").alias("col1"), F.col("const").alias("ci"))
    right = names.select(F.col("k").alias("j"), F.col("name").alias("col2"), F.col("const").alias("cj"))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(va * vb)))
    ok = (F.col("n") > 0) & ~F.col("ci") & ~F.col("cj") & (va > 0) & (vb > 0) & ~F.isnan(va) & ~F.isnan(vb)
    out = (gram.join(bounded_broadcast(left), "i").join(bounded_broadcast(right), "j")
               .select("i", "j", "col1", "col2", F.when(ok, r).alias("r")))
    return out.withColumn("abs_r", F.abs("r"))


GRAM = "i int, j int, n double, sa double, sb double, qa double, qb double, p double, lo double, hi double"


def _gram(mark: np.ndarray):
    """Partial Gram sums of one task, one row per pair i <= j."""
    def run(batches):
        d = len(mark)
        n, s, q, p = (np.zeros((d, d)) for _ in range(4))
        lo, hi = np.full(d, np.inf), np.full(d, -np.inf)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            m = ~np.isnan(x)
            if len(x):
                lo, hi = np.minimum(lo, np.where(m, x, np.inf).min(0)), np.maximum(hi, np.where(m, x, -np.inf).max(0))
            z = np.where(m, x - mark, 0.0)
            m = m.astype(float)
            with np.errstate(invalid="ignore", over="ignore"):
                n += m.T @ m
                s += z.T @ m
                q += (z * z).T @ m
                p += z.T @ z
        i, j = np.triu_indices(d)
        none = np.where((i == j) & (lo[i] <= hi[i]), 0.0, np.nan)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
             *[pa.array(v) for v in (n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j])],
             *[pa.array(np.where(np.isnan(none), np.nan, v), from_pandas=True) for v in (lo[i], hi[i])]],
            names=["i", "j", "n", "sa", "sb", "qa", "qb", "p", "lo", "hi"])
    return run


def strong_pairs(corr: DataFrame, threshold: float = 0.7, k: int = 5) -> DataFrame:
    """First ``k`` pairs (column order) with |r| > threshold, |r| to 2 decimals."""
    return (corr.where(F.col("abs_r") > threshold).orderBy("i", "j").limit(k)
                .select("col1", "col2", F.round("abs_r", 2).alias("correlation")))


def weak_pairs(corr: DataFrame, threshold: float = 0.3, k: int = 5) -> DataFrame:
    """First ``k`` pairs with 0 < |r| < threshold."""
    return (corr.where((F.col("abs_r") > 0) & (F.col("abs_r") < threshold))
                .orderBy("i", "j").limit(k)
                .select("col1", "col2", F.round("abs_r", 2).alias("correlation")))


# --------------------------------------------------------------------- I4–I5
def _column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: ``(column, mu, sd_pop, sd_samp, rows)`` – a wide
    one-row aggregate exploded to long form (bounded by the schema)."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        x = clean_number(c, dtypes[c])
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"p{i}"),
                 F.stddev_samp(x).alias(f"s{i}")]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mu"),
                 F.col(f"p{i}").alias("sd_pop"), F.col(f"s{i}").alias("sd_samp"),
                 F.col("_rows").alias("rows"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")


def outlier_rows(df: DataFrame, key: str | None = None, columns: Sequence[str] | None = None,
                 z: float = 3.0) -> DataFrame:
    """The flagged values themselves: ``(column, key, value, z)`` where
    |value − mean| / population std > z. Columns whose sample std is 0 are
    skipped. Without ``key``, a file scan's rows carry their place instead
    (``sources.order.PLACE``)."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    keys = [key] if key is not None else list(PLACE)
    stats = _column_stats(df, cols).where(F.col("sd_samp") != 0)
    long = to_long(df if key is not None else placed(df), cols, numeric=True, keep=keys)
    zc = (F.col("value") - F.col("mu")) / F.col("sd_pop")
    return (long.join(bounded_broadcast(stats), "column")
                .select("column", *[col(k) for k in keys], "value", zc.alias("z"), "rows")
                .where(F.abs("z") > z))


def outliers(df: DataFrame, columns: Sequence[str] | None = None, z: float = 3.0,
             key: str | None = None) -> DataFrame:
    """I4: ``(column, position, count, percent)`` per numeric column with at
    least one |z| > z value; percent of all rows (nulls included), 2 decimals."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    # Two wide aggregates: the columns' moments, then counts against them.
    stats = {r["column"]: r for r in _column_stats(df, cols).collect()} if cols else {}
    cols_on = [c for c in cols if stats[c]["sd_samp"]]
    if not cols_on:
        return df.sparkSession.createDataFrame([], "column string, position int, count bigint, percent double")
    hits = []
    for c in cols_on:
        zc = (clean_number(c, dtypes[c]) - F.lit(stats[c]["mu"])) / F.lit(stats[c]["sd_pop"])
        hits.append(F.struct(F.lit(c).alias("column"), F.count_if(F.abs(zc) > z).alias("count"),
                             F.lit(stats[c]["rows"]).alias("rows")))
    long = df.agg(F.array(*hits).alias("h")).select(F.explode("h").alias("h")).select("h.*")
    return (long.where(F.col("count") > 0)
                .select("column", order_expr(cols).alias("position"), "count",
                        F.round(F.col("count") * 100.0 / F.col("rows"), 2).alias("percent")))


def outlier_examples(df: DataFrame, key: str | None = None, columns: Sequence[str] | None = None,
                     z: float = 3.0, k: int = 5) -> DataFrame:
    """First ``k`` outlier values per column in ``key`` order (without it in the
    row order of a file scan), 2 decimals: ``(column, rank, value)``."""
    flagged = outlier_rows(df, key, columns, z)
    w = Window.partitionBy("column").orderBy(*[col(c) for c in ([key] if key is not None else PLACE)])
    return (flagged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                   .select("column", "rank", F.round("value", 2).alias("value")))


# --------------------------------------------------------------------- I6–I9
def _date_candidates(df: DataFrame, words: Sequence[str]) -> list[str]:
    return [c for c in df.columns if any(w in c.lower() for w in words)]


# Formats tried for date text, in this order; the first that reads every value
# of a column is the column's. "" is ISO text.
DATE_FORMATS = ("", "M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "d/M/yyyy", "yyyy/M/d", "d.M.yyyy",
                "d-M-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyyMMdd")


def _as_timestamp(name: str, dt: T.DataType, fmt: str = ""):
    """Parsed timestamp of a date-like column, or None if the type cannot be."""
    c = col(name)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp_ntz")
    if isinstance(dt, T.DateType):
        return c.cast("timestamp_ntz")
    if isinstance(dt, T.StringType):
        return (F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)).cast("timestamp_ntz")
    if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType)):
        # 4-digit integers read as years (pandas would read them as nanoseconds).
        return F.when(c.between(1000, 9999),
                      F.make_timestamp_ntz(c.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return None


def date_formats(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """``{column: format}`` of those columns whose every non-null value is read
    by one of ``DATE_FORMATS`` (one aggregate over columns and formats)."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    tries = []
    for c in columns:
        for fmt in DATE_FORMATS if isinstance(dtypes[c], T.StringType) else ("",):
            parsed = _as_timestamp(c, dtypes[c], fmt)
            if parsed is not None:
                tries.append((c, fmt, parsed))
    if not tries:
        return {}
    row = df.agg(*[F.count_if(e.isNull() & col(c).isNotNull()).alias(f"b{i}")
                   for i, (c, _, e) in enumerate(tries)]).first()
    found: dict[str, str] = {}
    for i, (c, fmt, _) in enumerate(tries):
        if row[f"b{i}"] == 0:
            found.setdefault(c, fmt)
    return found


def date_columns(df: DataFrame, words: Sequence[str] = DATE_WORDS) -> list[str]:
    """Columns whose name holds a date word and whose every non-null value
    is read as a timestamp by one format."""
    return list(date_formats(df, _date_candidates(df, words)))


def date_columns_frame(df: DataFrame, words: Sequence[str] = DATE_WORDS) -> DataFrame:
    """I6 as a frame: ``(column, position)``."""
    found = date_columns(df, words)
    return df.sparkSession.createDataFrame(
        [(c, df.columns.index(c)) for c in found], "column string, position int")


def monthly_means(df: DataFrame, date_cols: Sequence[str] | None = None,
                  columns: Sequence[str] | None = None, first: int = 3) -> DataFrame:
    """``(date_column, column, month, mean)``: monthly mean of the first
    ``first`` numeric columns (date columns excluded) per date column."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    formats = date_formats(df, list(date_cols) if date_cols is not None else _date_candidates(df, DATE_WORDS))
    dcols = list(date_cols) if date_cols is not None else list(formats)
    nums = list(columns) if columns is not None else [c for c in numeric_columns(df) if c not in dcols]
    nums = nums[:first]
    spark = df.sparkSession
    schema = "date_column string, column string, month date, mean double"
    if not dcols or not nums:
        return spark.createDataFrame([], schema)
    parts = []
    for d in dcols:
        month = F.to_date(F.date_trunc("month", _as_timestamp(d, dtypes[d], formats.get(d, ""))))
        g = (df.select(month.alias("month"), *[clean_number(c, dtypes[c]).alias(f"x{i}")
                                                for i, c in enumerate(nums)])
               .where(F.col("month").isNotNull())
               .groupBy("month").agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(nums))]))
        parts.append(g.select(F.lit(d).alias("date_column"), "month", F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"))
            for i, c in enumerate(nums)])).alias("s"))
                     .select("date_column", "s.column", "month", "s.mean"))
    return reduce(DataFrame.unionByName, parts).where(F.col("mean").isNotNull())


def month_trends(monthly: DataFrame, min_months: int = 3) -> DataFrame:
    """I8: ``(date_column, column, months, slope, r, p_value)`` of mean over
    month index 0..n−1 (observed months only), for series with ≥ min_months.
    The window runs over aggregated months only."""
    w = Window.partitionBy("date_column", "column").orderBy("month")
    x = monthly.withColumn("x", (F.row_number().over(w) - 1).cast("double"))
    g = x.groupBy("date_column", "column").agg(
        F.count(F.lit(1)).alias("months"),
        F.regr_slope("mean", "x").alias("slope"),
        pearson(F.col("x"), F.col("mean")).alias("r"))
    return (g.where(F.col("months") >= min_months)
             .withColumn("p_value", t_two_sided_p(F.col("r"), (F.col("months") - 2).cast("int"))))


def significant_trends(trends: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``(trend, direction, strength, slope, significance)`` for p < alpha."""
    return (trends.where(F.col("p_value") < alpha)
                  .select(F.concat_ws("_over_", "column", "date_column").alias("trend"),
                          F.when(F.col("slope") > 0, "increasing").otherwise("decreasing")
                          .alias("direction"),
                          F.round("r", 2).alias("strength"), F.round("slope", 2).alias("slope"),
                          F.round("p_value", 3).alias("significance")))


# -------------------------------------------------------------------- I10–I11
def distribution(df: DataFrame, columns: Sequence[str] | None = None, first: int = 2) -> DataFrame:
    """``(column, position, mean, median, mode, skewness, shape)`` for the
    first ``first`` numeric columns. Mode = most frequent value, smallest on
    ties, from the value histogram (no single-task ``mode`` buffer)."""
    cols = (list(columns) if columns is not None else numeric_columns(df))[:first]
    spark = df.sparkSession
    schema = ("column string, position int, mean double, median double, mode double, "
              "skewness double, shape string")
    if not cols:
        return spark.createDataFrame([], schema)
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    stats = numeric_stats(df, cols)
    sk = df.agg(*[skew_corrected(clean_number(c, dtypes[c])).alias(f"k{i}")
                  for i, c in enumerate(cols)]).first()
    med = medians(df, cols, stats)
    modes = dict(histogram(df, cols, numeric=True).groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("cnt")).alias("n"), F.col("value").alias("v")))
        .alias("mode")).collect())
    rows = [(c, i, stats[c][3], med.get(c), modes.get(c), sk[f"k{i}"]) for i, c in enumerate(cols)]
    out = spark.createDataFrame(rows, "column string, position int, mean double, median double, "
                                      "mode double, skewness double")
    return out.withColumn("shape", skew_class(F.col("skewness")))


def group_compare(df: DataFrame, category: str | None = None, value: str | None = None,
                  top: int = 3) -> DataFrame:
    """Mean of ``value`` over the ``top`` most common values of
    ``category`` (first categorical / numeric column by default):
    ``(category, count, mean, is_highest, is_lowest)``, mean to 2 decimals."""
    category = category or categorical_columns(df)[0]
    value = value or numeric_columns(df)[0]
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    g = (df.where(col(category).isNotNull())
           .groupBy(col(category).cast("string").alias("category"))
           .agg(F.count(F.lit(1)).alias("count"),
                F.avg(clean_number(value, dtypes[value])).alias("mean"))
           .orderBy(F.desc("count"), F.asc("category")).limit(top)
           .withColumn("mean", F.round("mean", 2)))
    # g has ≤ top rows: windows and the one-row extremes below are tiny.
    g = g.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("count"), F.asc("category"))))
    ext = g.agg(F.max_by("category", F.struct(F.col("mean"), -F.col("_r"))).alias("_hi"),
                F.min_by("category", F.struct(F.col("mean"), F.col("_r"))).alias("_lo"))
    return (g.crossJoin(ext)
             .select("category", "count", "mean",
                     (F.col("category") == F.col("_hi")).alias("is_highest"),
                     (F.col("category") == F.col("_lo")).alias("is_lowest")))


# ------------------------------------------------------------------- C10, C11
def overview_numeric(df: DataFrame, first: int = 5) -> DataFrame:
    """Mean, median, min, max (2 decimals) of the first ``first``
    numeric columns: ``(column, position, mean, median, min, max)``."""
    cols = numeric_columns(df)[:first]
    spark = df.sparkSession
    schema = "column string, position int, mean double, median double, min double, max double"
    if not cols:
        return spark.createDataFrame([], schema)
    stats = numeric_stats(df, cols)
    med = medians(df, cols, stats)
    rows = [(c, i, stats[c][3], med.get(c), stats[c][1], stats[c][2]) for i, c in enumerate(cols)]
    out = spark.createDataFrame(rows, schema)
    return out.select("column", "position",
                      *[F.round(F.col(c).cast("double"), 2).alias(c) for c in ("mean", "median", "min", "max")])


def overview_top_values(df: DataFrame, first: int = 5, k: int = 3) -> DataFrame:
    """For the first ``first`` categorical columns: distinct count (null
    counts as a value) and the ``k`` most common values:
    ``(column, position, unique_values, rank, value, count)``."""
    cols = categorical_columns(df)[:first]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame(
            [], "column string, position int, unique_values bigint, rank int, value string, count bigint")
    hist = to_long(df, cols, numeric=False, drop_nulls=False).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("count"))
    nd = hist.groupBy("column").agg(F.count(F.lit(1)).alias("unique_values"))
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    top = (hist.where(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(w))
               .where(F.col("rank") <= k))
    return (top.join(bounded_broadcast(nd), "column")
               .select("column", order_expr(cols).alias("position"), "unique_values",
                       "rank", "value", "count"))


HEADLINE_SCHEMA = "subject string, metric string, value_num double, value_str string"


def headline(df: DataFrame, names: int = 5, first: int = 2) -> DataFrame:
    """C11: the headline facts as ``(subject, metric, value_num, value_str)``:
    row and column counts, the first ``names`` column names, mean/min/max
    (2 decimals) of the first ``first`` numeric columns, and the top value and
    its percent (1 decimal) of the first ``first`` categorical columns (profile
    type classes)."""
    spark = df.sparkSession
    cls = classify(df, PROFILE)
    nums, cats = list(cls.numeric)[:first], list(cls.categorical)[:first]
    stats = numeric_stats(df, nums) if nums else {None: df.count()}
    rows = [("table", "row_count", float(stats[None]), None),
            ("table", "column_count", float(len(df.columns)), None),
            ("table", "main_columns", None, ", ".join(df.columns[:names]))]
    for c in nums:
        n, lo, hi, mu, _sd = stats[c]
        rows += [(c, "mean", mu, None), (c, "min", lo, None), (c, "max", hi, None)]
    facts = spark.createDataFrame(rows, HEADLINE_SCHEMA)
    facts = facts.withColumn("value_num", F.when(F.col("metric").isin("mean", "min", "max"),
                                                 F.round("value_num", 2)).otherwise(F.col("value_num")))
    if not cats:
        return facts
    vc = histogram(df, cats, numeric=False)
    tot = vc.groupBy("column").agg(F.sum("cnt").alias("_t"))
    w = Window.partitionBy("column").orderBy(F.desc("cnt"), F.asc("value"))
    top = (vc.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
             .join(bounded_broadcast(tot), "column"))
    tops = top.select(F.col("column").alias("subject"), F.lit("top_value").alias("metric"),
                      F.lit(None).cast("double").alias("value_num"), F.col("value").alias("value_str"))
    pct = top.select(F.col("column").alias("subject"), F.lit("top_percent").alias("metric"),
                     F.round(F.col("cnt") * 100.0 / F.col("_t"), 1).alias("value_num"),
                     F.lit(None).cast("string").alias("value_str"))
    return facts.unionByName(tops).unionByName(pct)
