"""M8 on rows grouped by bins: the same predictions as on single rows, from a bounded number of rows."""

import random

import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.sql import functions as F

from tabscope.operators import features as FT
from tabscope.operators import models as M


def table(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, label double, a double, b double")
    return FT.assemble(df, ["a", "b"])


def few_rounds(features="features", label="label", prediction="prediction"):
    return OneVsRest(classifier=GBTClassifier(maxIter=5, stepSize=0.1, maxDepth=3, seed=M.SEED), featuresCol=features,
                     labelCol=label, predictionCol=prediction)


def test_same_predictions_as_single_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "boosting_classification", few_rounds)
    rng = random.Random(4)
    rows = []
    for k in range(3000):
        a, b = rng.choice((rng.random(), rng.randint(0, 5) / 5)), float(rng.randint(0, 200))
        rows.append((k, float((a > 0.4) + (b > 120) * (rng.random() < 0.8)), a, b))
    df = table(spark, rows)
    old = {r["id"]: r["prediction"] for r in few_rounds().fit(df).transform(df).collect()}
    new = {r["id"]: r["prediction"] for r in M.BinnedClassifier().fit(df).transform(df).collect()}
    assert len(new) == len(rows) and set(new.values()) == {0.0, 1.0, 2.0}
    assert new == old


def test_rows_of_the_fit_are_bounded(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 3).cast("double").alias("label"),
                                    F.rand(1).alias("a"), F.rand(2).alias("b"))
    cells, edges = M.BinnedClassifier().cells(FT.assemble(df, ["a", "b"]))
    assert [len(e) for e in edges] == [31, 31]
    assert cells.count() <= 32 * 32 * 3
    assert cells.agg(F.sum("_weight")).first()[0] == 60_000


def test_missing_and_infinite_values_are_an_error(spark):
    for bad in (float("nan"), float("inf"), float("-inf")):
        rows = [(k, float(k % 2), bad if k == 4 else float(k), 1.0) for k in range(20)]
        with pytest.raises(Exception, match="MUST NOT be NaN or Infinity"):
            M.BinnedClassifier().cells(table(spark, rows))
