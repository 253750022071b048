"""Export S13: model results as ``(section, position, name, value)`` text rows
(model type, target, metrics with title-cased names and 4 decimals, feature
importances descending), written as CSV by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import row_index


def metric_label(name):
    """``mean_absolute_error`` → ``Mean Absolute Error``."""
    return F.initcap(F.regexp_replace(name, "_", " "))


def export_rows(metrics: DataFrame, model_type: str, target: str,
                importances: DataFrame | None = None) -> DataFrame:
    """``metrics(metric, value)`` and ``importances(feature, importance)``
    → export rows. Importances sort descending, ties by name."""
    spark = metrics.sparkSession
    head = spark.createDataFrame([("model", 0, "Model Type", model_type),
                                  ("model", 1, "Target Column", target)],
                                 "section string, position int, name string, value string")
    met = metrics.select(F.lit("metric").alias("section"), F.lit(0).alias("position"),
                         metric_label(F.col("metric")).alias("name"),
                         F.format_string("%.4f", F.col("value")).alias("value"))
    out = head.unionByName(met)
    if importances is not None:
        ranked = row_index(importances.withColumn("_neg", -F.col("importance")), ["_neg", "feature"], "_at")
        out = out.unionByName(ranked.select(
            F.lit("importance").alias("section"), F.col("_at").cast("int").alias("position"),
            F.col("feature").alias("name"), F.format_string("%.4f", F.col("importance")).alias("value")))
    return out


def write_csv(rows: DataFrame, path: str) -> None:
    """S13 sink: model lines, then metrics, then importances by position."""
    section = F.array_position(F.array(F.lit("model"), F.lit("metric"), F.lit("importance")), F.col("section"))
    rows.orderBy(section, "position", "name").write.mode("overwrite").option("header", True).csv(path)
