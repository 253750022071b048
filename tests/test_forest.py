"""Forests grown in the tasks: splits, layout of the rows, stored nodes."""

import math

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabscope.operators import forest as FO
from tabscope.operators import models as M
from tabscope.sources.tables import load

from .conftest import SF001


def table(spark, n=300, classes=False):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 2, n), rng.integers(0, 5, n), rng.normal(size=n)])
    y = np.floor(np.abs(x[:, 0])) % 3 if classes else 3 * x[:, 0] + 5 * x[:, 1] + x[:, 2]
    rows = [(k, [float(v) for v in r], float(t)) for k, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k bigint, x array<double>, label double")
    return df.select("k", array_to_vector("x").alias("features"), "label")


def predicted(model, df):
    return {r["k"]: r["prediction"] for r in model.transform(df).collect()}


def test_a_forest_does_not_depend_on_the_layout_of_its_rows(spark):
    for classes in (False, True):
        df = table(spark, classes=classes)
        est = M.forest_classification() if classes else M.random_forest_regression({"n_estimators": 30})
        a, b = est.fit(df.coalesce(1)), est.fit(df.repartition(7))
        assert a.nodes.count() == b.nodes.count() > 1000
        one, two = predicted(a, df.repartition(3)), predicted(b, df)
        assert one.keys() == two.keys() and len(one) == 300
        assert all(math.isclose(one[k], two[k], rel_tol=1e-9) for k in one)
        assert np.allclose(a.featureImportances.toArray(), b.featureImportances.toArray())
        truth = {r["k"]: r["label"] for r in df.collect()}
        if classes:
            assert sum(one[k] == truth[k] for k in truth) > 0.97 * len(truth)
        else:
            spare = sum((one[k] - truth[k]) ** 2 for k in truth) / np.var([*truth.values()]) / len(truth)
            assert spare < 0.03


def test_every_split_is_the_best_of_its_node():
    rng = np.random.default_rng(4)
    bins = np.column_stack([rng.integers(0, 6, 80), rng.integers(0, 2, 80), rng.integers(0, 2, 80), rng.integers(0, 32, 80)]).astype(np.uint8)
    weight = rng.poisson(1.0, 80).astype(np.uint8)
    for classes, y in ((0, rng.normal(size=80)), (3, rng.integers(0, 3, 80).astype(float))):
        def loss(at):
            w, v = weight[at].astype(float), y[at]
            if classes:
                return w.sum() - sum(w[v == c].sum() ** 2 for c in range(classes)) / w.sum()
            return (w * (v - np.average(v, weights=w)) ** 2).sum()
        for subset in (None, 4) if classes else (None,):
            t = FO._Tree(bins, y, classes, subset, 30, 1).grow(weight, np.random.default_rng(0))
            todo, seen = [(0, np.flatnonzero(weight))], 0
            while todo:
                k, at = todo.pop()
                seen += 1
                gains = [loss(at) - loss(at[left]) - loss(at[~left]) for s in range(4) for c in range(31)
                         if 0 < (left := bins[at, s] <= c).sum() < len(at)]
                if t["slot"][k] < 0:
                    if classes:
                        assert t["value"][k] == np.bincount(y[at].astype(int), weight[at]).argmax()
                    else:
                        assert math.isclose(t["value"][k], np.average(y[at], weights=weight[at]), abs_tol=1e-9)
                        assert not gains or max(gains) < 1e-9
                    continue
                assert math.isclose(t["gain"][k], max(gains), rel_tol=1e-9, abs_tol=1e-9)
                left = bins[at, t["slot"][k]] <= t["cut"][k]
                todo += [(t["left"][k], at[left]), (t["left"][k] + 1, at[~left])]
            assert seen == len(t["slot"]) > 20


def test_limits_and_wrong_rows(spark):
    df = table(spark)
    model = M.random_forest_regression({"n_estimators": 3, "max_depth": 2, "min_samples_leaf": 20}).fit(df)
    assert model.nodes.groupBy("tree").count().agg(F.max("count")).first()[0] <= 7
    none = df.withColumn("label", F.when(F.col("k") > 3, F.col("label")))
    for bad in (none, df.withColumn("label", F.lit(float("nan")))):
        try:
            M.random_forest_regression({"n_estimators": 3}).fit(bad)
            raise AssertionError("accepted")
        except Exception as e:  # noqa: BLE001
            assert "Labels MUST be" in str(e)
    constant = M.random_forest_regression({"n_estimators": 3}).fit(df.withColumn("label", F.lit(2.0)))
    assert set(predicted(constant, df).values()) == {2.0} and not constant.featureImportances.toArray().any()
    assert constant.transform(df.limit(0)).count() == 0


def test_the_route_keeps_and_reloads_a_forest(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from tabscope.plans import train as TR
    part = load(spark, SF001, "part")
    res = TR.train_route(part, "p_retailprice", "p_partkey", "RandomForest", {"n_estimators": 5})
    res.model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(res.test).select(F.col("p_partkey").alias("k"), "prediction")
    was = {r["p_partkey"]: r["prediction"] for r in res.model.transform(res.test).collect()}
    assert {r["k"]: r["prediction"] for r in again.collect()} == was and len(was) > 10
    assert isinstance(res.model.stages[-1], FO.ForestModel)


def test_importances_are_the_trees_mean_shares_of_gains(spark):
    model = M.random_forest_regression({"n_estimators": 4}).fit(table(spark, 60))
    want, rows = np.zeros(4), model.nodes.where("slot >= 0").collect()
    for tree in range(4):
        own = np.zeros(4)
        for r in rows:
            own[r["slot"]] += r["gain"] * (r["tree"] == tree)
        want += own / own.sum() / 4
    assert np.allclose(model.featureImportances.toArray(), want) and math.isclose(want.sum(), 1.0)
