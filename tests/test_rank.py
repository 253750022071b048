"""Distributed order statistics against numpy / a single window."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabscope.operators import rank as R
from tabscope.operators import profile as P


@pytest.mark.parametrize("n,seed", [(1, 0), (2, 1), (7, 2), (1000, 3), (5001, 4)])
def test_exact_median_matches_numpy(spark, n, seed, monkeypatch):
    monkeypatch.setattr(R, "FINISH_ROWS", 16)  # force several selection rounds
    monkeypatch.setattr(R, "SELECT_BUCKETS", 8)
    rng = np.random.default_rng(seed)
    a = np.round(rng.lognormal(3, 2, n), 3)
    b = rng.integers(0, 5, n).astype(float)  # heavy ties
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    med = P.medians(df, ["a", "b"])
    assert med["a"] == pytest.approx(float(np.median(a)), rel=1e-12)
    assert med["b"] == pytest.approx(float(np.median(b)), rel=1e-12)


def test_median_hot_value(spark, monkeypatch):
    monkeypatch.setattr(R, "FINISH_ROWS", 4)
    vals = [5.0] * 400 + [float(i) for i in range(600)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert P.medians(df, ["x"])["x"] == float(np.median(vals))


def test_median_ignores_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert P.medians(df, ["x"])["x"] == 2.0


def test_row_index_multi_bucket_matches_window(spark):
    rng = np.random.default_rng(7)
    keys = rng.integers(0, 50, 3000).tolist() + [17] * 1500  # hot key
    df = spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)], "k bigint, v bigint")
    got = R.row_index(df, ["k"], "_row")
    rows = sorted((r["_row"], r["k"]) for r in got.collect())
    assert [r[0] for r in rows] == list(range(len(keys)))
    assert [r[1] for r in rows] == sorted(keys)  # numbering follows key order


def test_row_index_single_bucket(spark):
    df = spark.range(0, 100).select((99 - F.col("id")).alias("k"))
    got = R.row_index(df, ["k"], "_row")
    w = Window.orderBy("k")
    ref = df.withColumn("_row", F.row_number().over(w) - 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ref.collect()))


def test_median_with_infinities(spark, monkeypatch):
    monkeypatch.setattr(R, "FINISH_ROWS", 2)
    vals = [float("-inf"), 1.0, 2.0, 3.0, 4.0, 5.0, float("inf"), float("inf")]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert P.medians(df, ["x"])["x"] == float(np.median(vals))


def test_row_index_text_keys_hot_ties_and_nulls(spark):
    rows = [(f"k{i % 7}", i % 3) for i in range(500)] + [("hot", 1)] * 700 + [(None, None)] * 5
    df = spark.createDataFrame(rows, "a string, b int").repartition(6)
    got = sorted((r["_row"], r["a"] or "", -1 if r["b"] is None else r["b"])
                 for r in R.row_index(df, ["a", "b"], "_row").collect())
    assert [g[0] for g in got] == list(range(len(rows)))
    assert [g[1:] for g in got] == sorted((a or "", -1 if b is None else b) for a, b in rows)


def test_row_index_spreads_one_repeated_row(spark):
    df = spark.range(20_000).select(F.lit("same").alias("a"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        out = R.row_index(df, ["a"], "_row")
    finally:
        spark.conf.set(coalesce, "true")
    sizes = [r[1] for r in out.groupBy(F.input_file_name()).count().collect()]
    assert out.agg(F.countDistinct("_row"), F.max("_row")).first()[:] == (20_000, 19_999)
    assert max(sizes) < 20_000


def test_row_index_empty(spark):
    assert R.row_index(spark.createDataFrame([], "a string"), ["a"], "_row").count() == 0


def test_scratch_tables_go_with_their_scope(spark):
    import os

    from tabscope.session import checkpoint_dir, materialize, scratch_scope
    root = checkpoint_dir(spark).replace("file:", "")
    with scratch_scope(spark):
        inner = materialize(spark.range(3).toDF("a"), "inner")
        out = materialize(inner.where("a > 0"), "outer", keep=True)
        assert any("tabscope-inner" in f for f in os.listdir(root))
    assert not any("tabscope-inner" in f for f in os.listdir(root))
    assert sorted(r["a"] for r in out.collect()) == [1, 2]
