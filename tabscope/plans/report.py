"""Composed reports: C7 (filter, then profile) and I13 (insight report).

Each section is its own plan over one persisted input; sections are unioned
into one long frame ``(section, subject, metric, value_num, value_str)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import browse as B
from ..operators import clean as C
from ..operators import insights as I
from ..operators import profile as P

REPORT_SCHEMA = "section string, subject string, metric string, value_num double, value_str string"


def filter_profile(df: DataFrame, filters: Mapping[str, object], cleaned: bool = False) -> dict[str, DataFrame]:
    """Clean the table (B1–B3, unless ``cleaned`` says it is), B4 equality
    filter, then the profile C1–C4 of what is left. An empty result has an
    empty card and no statistics rows."""
    sub = B.eq_filter(df if cleaned else C.clean(df), filters)
    if sub.isEmpty():
        return {"card": P.table_card(sub), "numeric": P.numeric_profile(sub).limit(0),
                "categorical": P.categorical_profile(sub).limit(0), "options": P.filter_options(sub).limit(0)}
    return {"card": P.table_card(sub), "numeric": P.numeric_profile(sub),
            "categorical": P.categorical_profile(sub), "options": P.filter_options(sub)}


def _rows(df: DataFrame, section: str, subject, metric, num=None, text=None) -> DataFrame:
    return df.select(F.lit(section).alias("section"), subject.alias("subject"), metric.alias("metric"),
                     (num if num is not None else F.lit(None)).cast("double").alias("value_num"),
                     (text if text is not None else F.lit(None)).cast("string").alias("value_str"))


def insight_report(df: DataFrame, key: str, filters: Mapping[str, Sequence] | None = None,
                   prompt: str | None = None, min_rows: int = 5) -> DataFrame:
    """B5 filter, ≥ ``min_rows`` guard, then overview (C10),
    correlations (I2/I3), outliers (I4/I5), significant trends (I9) and the
    prompt's custom sections (I10 for distribution words, I11 for comparison
    words), as one long frame. ``key`` orders rows where order matters."""
    spark = df.sparkSession
    data = B.isin_filter(df, filters or {}).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = data.count()
        if n < min_rows:
            return spark.createDataFrame(
                # Fixed value: the guard's message.
                [("error", None, "message", None,
                  "Not enough data to generate insights. Please select different filters.")],
                REPORT_SCHEMA)
        nums = I.numeric_columns(data)
        cats = I.categorical_columns(data)
        parts = [spark.createDataFrame(
            [("overview", "table", "row_count", float(n), None),
             ("overview", "table", "column_count", float(len(data.columns)), None),
             ("overview", "table", "numeric_columns", float(len(nums)), None),
             ("overview", "table", "categorical_columns", float(len(cats)), None)], REPORT_SCHEMA)]
        if nums:
            ov = I.overview_numeric(data)
            for m in ("mean", "median", "min", "max"):
                parts.append(_rows(ov, "overview", F.col("column"), F.lit(m), F.col(m)))
        if cats:
            tv = I.overview_top_values(data)
            parts.append(_rows(tv.where(F.col("rank") == 1), "overview", F.col("column"),
                               F.lit("unique_values"), F.col("unique_values")))
            parts.append(_rows(tv, "overview", F.col("column"),
                               F.concat(F.lit("top_value_"), F.col("rank").cast("string")),
                               F.col("count"), F.col("value")))
        if len(nums) >= 2:
            corr = I.correlations(data, nums)
            pair = F.concat_ws(" ~ ", "col1", "col2")
            parts.append(_rows(I.strong_pairs(corr), "correlation", pair, F.lit("strong"),
                               F.col("correlation")))
            parts.append(_rows(I.weak_pairs(corr), "correlation", pair, F.lit("weak"),
                               F.col("correlation")))
        if nums:
            out = I.outliers(data, nums)
            parts.append(_rows(out, "outlier", F.col("column"), F.lit("count"), F.col("count")))
            parts.append(_rows(out, "outlier", F.col("column"), F.lit("percent"), F.col("percent")))
            ex = I.outlier_examples(data, key, nums)
            parts.append(_rows(ex, "outlier", F.col("column"),
                               F.concat(F.lit("example_"), F.col("rank").cast("string")), F.col("value")))
        trends = I.significant_trends(I.month_trends(I.monthly_means(data)))
        parts.append(_rows(trends, "trend", F.col("trend"), F.lit("direction"), None, F.col("direction")))
        for m in ("strength", "slope", "significance"):
            parts.append(_rows(trends, "trend", F.col("trend"), F.lit(m), F.col(m)))
        words = (prompt or "").lower()
        if prompt and any(w in words for w in I.DISTRIBUTION_WORDS) and nums:
            dist = I.distribution(data, nums)
            for m in ("mean", "median", "mode", "skewness"):
                parts.append(_rows(dist, "custom", F.col("column"), F.lit(m), F.col(m)))
            parts.append(_rows(dist, "custom", F.col("column"), F.lit("shape"), None, F.col("shape")))
        if prompt and any(w in words for w in I.COMPARE_WORDS) and nums and cats:
            cmp_ = I.group_compare(data, cats[0], nums[0])
            parts.append(_rows(cmp_, "custom", F.col("category"), F.lit("mean"), F.col("mean")))
            parts.append(_rows(cmp_.where("is_highest"), "custom", F.col("category"), F.lit("highest"),
                               F.col("mean")))
            parts.append(_rows(cmp_.where("is_lowest"), "custom", F.col("category"), F.lit("lowest"),
                               F.col("mean")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        # Materialised before the persisted input is released. The report is
        # bounded by the schema (≤ 5 columns per overview list, ≤ 5 pairs,
        # ≤ 5 examples per column, 3 numeric columns per date column).
        return spark.createDataFrame(out.collect(), REPORT_SCHEMA)
    finally:
        data.unpersist()
