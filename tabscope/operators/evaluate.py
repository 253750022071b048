"""Evaluation and explanation E1–E10.

All metrics are aggregates over ``(actual, predicted)`` rows; per-class work
runs on the confusion counts (≤ classes² rows), never on raw rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._long import col
from .browse import hash_order
from .rank import row_index

# Metric names of the two training pipelines.
ROUTE_NAMES = ("r2_score", "mean_absolute_error", "mean_squared_error", "root_mean_squared_error")
LIBRARY_NAMES = ("mse", "rmse", "r2")


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row ``(n, r2_score, mean_absolute_error, mean_squared_error,
    root_mean_squared_error)`` in one pass: SST = n·var_pop(actual). A constant
    actual has no variance to explain: R² is 1 for a perfect fit, else 0. Rows
    with a missing side are not scored; without any row all metrics are NULL."""
    a, p = col(actual).cast("double"), col(predicted).cast("double")
    err = a - p
    g = df.where(a.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.sum(err * err).alias("_sse"),
        F.avg(F.abs(err)).alias("mean_absolute_error"), F.var_pop(a).alias("_var"))
    mse = F.col("_sse") / F.col("n")
    return g.select(
        "n",
        F.when(F.col("_var") > 0, F.lit(1.0) - F.col("_sse") / (F.col("_var") * F.col("n")))
        .when(F.col("n") > 0, F.when(F.col("_sse") == 0, 1.0).otherwise(0.0)).alias("r2_score"),
        "mean_absolute_error", mse.alias("mean_squared_error"),
        F.sqrt(mse).alias("root_mean_squared_error"))


def regression_metrics_library(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """E1, library variant: ``(mse, rmse, r2)``."""
    m = regression_metrics(df, actual, predicted)
    return m.select(F.col("mean_squared_error").alias("mse"),
                    F.col("root_mean_squared_error").alias("rmse"), F.col("r2_score").alias("r2"))


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """E8 long form: ``(actual, predicted, count)``."""
    return (df.groupBy(col(actual).alias("actual"), col(predicted).alias("predicted"))
              .agg(F.count(F.lit(1)).alias("count")))


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``(accuracy, f1_score, precision, recall)``, the last three
    support-weighted over the union of labels; 0/0 counts as 0."""
    cc = confusion_counts(df, actual, predicted)
    sup = cc.groupBy(F.col("actual").alias("label")).agg(F.sum("count").alias("support"))
    prd = cc.groupBy(F.col("predicted").alias("label")).agg(F.sum("count").alias("pred"))
    tp = (cc.where(F.col("actual") == F.col("predicted"))
            .select(F.col("actual").alias("label"), F.col("count").alias("tp")))
    per = (sup.join(prd, "label", "full").join(tp, "label", "left")
              .na.fill(0, ["support", "pred", "tp"]))
    prec = F.when(F.col("pred") > 0, F.col("tp") / F.col("pred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.select("support", "tp", prec.alias("p"), rec.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))
                ).otherwise(0.0)
    tot = F.sum("support")
    return per.agg(
        (F.sum("tp") / tot).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / tot).alias("f1_score"),
        (F.sum(F.col("p") * F.col("support")) / tot).alias("precision"),
        (F.sum(F.col("r") * F.col("support")) / tot).alias("recall"))


def importances(spark, names: Sequence[str], values: Sequence[float], top: int | None = None,
                normalise: bool = False) -> DataFrame:
    """E3/E4 output: ``(feature, importance, percent)`` sorted descending
    (ties by feature). ``normalise`` scales to sum 1. Inputs are one value per
    feature, so they are driver-sized."""
    vals = [float(abs(v)) for v in values]
    if normalise:
        s = sum(vals)
        vals = [v / s if s else 0.0 for v in vals]
    rows = sorted(zip(names, vals), key=lambda t: (-t[1], t[0]))
    if top is not None:
        rows = rows[:top]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.withColumn("percent", F.round(F.col("importance") * 100, 1))


def importance_table(names: DataFrame, values: Sequence[float], normalise: bool = False) -> DataFrame:
    """E3/E4 for names that stay a table: as :func:`importances`, with ``names``
    ``(slot, feature)``. Only the model's own numbers come from the driver."""
    vals = [float(abs(v)) for v in values]
    if normalise:
        s = sum(vals)
        vals = [v / s if s else 0.0 for v in vals]
    table = names.sparkSession.createDataFrame(list(enumerate(vals)), "slot long, importance double")
    return (names.join(table, "slot").select("feature", "importance", F.round(F.col("importance") * 100, 1).alias("percent"))
            .orderBy(F.desc("importance"), "feature"))


def prediction_sample(df: DataFrame, key: str, n: int = 50) -> DataFrame:
    """≤ ``n`` prediction rows in md5 order of the key (seeded sample)."""
    return df.orderBy(hash_order(key), col(key)).limit(n)


def codes_to_labels(df: DataFrame, column: str, mapping: DataFrame, out: str | None = None) -> DataFrame:
    """Map numeric predictions back to labels: round half-even, look up
    the code in ``mapping(value, code)``; codes outside it keep the
    prediction's own text. The mapping is a target mapping (data-sized in
    principle), so no broadcast hint: AQE decides after measuring it."""
    out = out or column
    m = mapping.select(F.col("value").alias("_label"), F.col("code").cast("bigint").alias("_code"))
    j = df.join(m, F.bround(col(column).cast("double"), 0).cast("bigint") == F.col("_code"), "left")
    # A matched code keeps its label even if the label is NULL (a category of its own).
    label = F.when(F.col("_code").isNotNull(), F.col("_label")).otherwise(col(column).cast("string"))
    return j.withColumn(out, label).drop("_label", "_code")


def confusion_matrix(df: DataFrame, actual: str, predicted: str, max_labels: int = 10) -> DataFrame:
    """E8 wide form: one row and one column (``p_<label>``) per label that is
    seen on either side, zeros filled; only when there are ≤ ``max_labels``
    labels (that guard bounds the pivot). A missing label is one of its own:
    the row with a NULL ``actual``, the column ``p_null``."""
    cc = confusion_counts(df, actual, predicted)
    labels = (cc.select(F.col("actual").alias("l")).union(cc.select(F.col("predicted").alias("l")))
                .distinct().limit(max_labels + 1).collect())
    if len(labels) > max_labels:
        raise ValueError(f"more than {max_labels} labels: use confusion_counts")
    labels = sorted((r["l"] for r in labels), key=lambda v: (v is None, v))
    every = (cc.select(F.col("actual").alias("_l")).union(cc.select(F.col("predicted").alias("_l"))).distinct())
    cells = every.join(cc, F.col("_l").eqNullSafe(F.col("actual")), "left")

    def column(lab):
        hit = F.col("predicted").isNull() if lab is None else F.col("predicted") == F.lit(lab)
        return F.sum(F.when(hit, F.coalesce("count", F.lit(0))).otherwise(0)).cast("bigint").alias(f"p_{'null' if lab is None else lab}")

    return cells.groupBy(F.col("_l").alias("actual")).agg(*[column(lab) for lab in labels])


def pair_list(df: DataFrame, actual: str, predicted: str, order_by: str, n: int = 20) -> DataFrame:
    """First ``n`` (actual, predicted, match) pairs in key order."""
    return (df.orderBy(col(order_by)).limit(n)
              .select(col(order_by).alias(order_by), col(actual).alias("actual"),
                      col(predicted).alias("predicted"),
                      (col(actual) == col(predicted)).alias("match")))


def accuracy_percent(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``(accuracy_percent)`` to 1 decimal."""
    return df.agg(F.round(F.avg(F.when(col(actual) == col(predicted), 1.0).otherwise(0.0)) * 100, 1)
                  .alias("accuracy_percent"))


def group_fits(df: DataFrame, group: str, y: str, x: str) -> DataFrame:
    """E10 input: one closed-form linear fit of ``y`` on ``x`` per group
    (``regr_*`` aggregates, partial + final): ``(group, n, slope, intercept, r2)``."""
    return df.groupBy(col(group).alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(col(y), col(x)).alias("slope"),
        F.regr_intercept(col(y), col(x)).alias("intercept"), F.regr_r2(col(y), col(x)).alias("r2"))


def compare_models(records: DataFrame) -> DataFrame:
    """E10 over kept records ``(id, name, created_at, is_categorical_target,
    metrics)``: ``(rank, id, name, metric, value, shown)``, newest first (ties
    by id). The primary metric is the accuracy for text targets, else R²; a
    record without it shows ``N/A``."""
    metric = F.when(F.col("is_categorical_target"), "accuracy").otherwise("r2_score")
    rows = records.select("id", "name", "created_at", metric.alias("metric"),
                          F.col("metrics")[metric].alias("value"))
    # Oldest-first row numbers, turned around by time; equal times stay by id.
    newest = row_index(rows, ["created_at", "id"], "_at")
    last = newest.groupBy("created_at").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    total = rows.count()
    ranked = newest.join(last, newest["created_at"].eqNullSafe(last["created_at"])).select(
        (F.lit(total) - F.col("_hi") + (F.col("_at") - F.col("_lo"))).alias("rank"),
        "id", "name", "metric", "value")
    shown = F.when(F.col("value").isNull(), "N/A").otherwise(F.format_string("%.4f", "value"))
    return ranked.withColumn("shown", shown)


def rank_models(metrics: DataFrame, value: str = "value", key: str = "group") -> DataFrame:
    """Rank rows by ``value`` descending (missing last, ties by key).
    The number of groups grows with the data, so the ranking uses the
    bucketed :func:`rank.row_index`, not a single global window."""
    k = F.coalesce(-F.col(value), F.lit(float("inf")))
    ranked = row_index(metrics.withColumn("_neg", k), ["_neg", key], "_rank")
    return ranked.withColumn("rank", (F.col("_rank") + 1).cast("bigint")).drop("_neg", "_rank")
