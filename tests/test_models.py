"""Model invariants (no exact parity with other libraries is expected)."""

import math

from pyspark.sql import functions as F

from tabscope.catalog import q_models as Q
from tabscope.operators import evaluate as E
from tabscope.operators import features as FT
from tabscope.operators import models as M
from tabscope.plans import train as TR
from tabscope.session import checkpoint_dir
from tabscope.sources import model_store as S
from tabscope.sources.tables import load

from .conftest import SF001


def part(spark):
    return load(spark, SF001, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")


def test_linear_one_feature_equals_closed_form(spark):
    p = FT.assemble(load(spark, SF001, "part"), ["p_size"])
    m = M.linear_regression(label="p_retailprice").fit(p)
    ref = p.agg(F.regr_slope("p_retailprice", "p_size").alias("b"),
                F.regr_intercept("p_retailprice", "p_size").alias("a")).first()
    assert math.isclose(m.coefficients[0], ref["b"], rel_tol=1e-9)
    assert math.isclose(m.intercept, ref["a"], rel_tol=1e-9)


def test_forest_importances_sum_to_one(spark):
    res = TR.train_route(part(spark), "p_retailprice", "p_partkey", "RandomForest", {"n_estimators": 10})
    vals = [r["importance"] for r in res.importances.collect()]
    assert all(v >= 0 for v in vals) and math.isclose(sum(vals), 1.0, rel_tol=1e-9)


def test_route_predictions_cover_test_rows(spark):
    res = TR.train_route(part(spark), "p_type", "p_partkey", "LinearRegression", use_cross_validation=True)
    pred = res.model.transform(res.test)
    assert pred.count() == res.test.count()
    assert len(res.cv_scores) == 5
    names = {r["metric"] for r in res.metrics.collect()}
    assert {"r2_score", "cv_mean_score", "cv_std_score"} <= names
    assert res.sample.count() <= 50


def test_same_seed_same_model(spark):
    a = TR.train_route(part(spark), "p_retailprice", "p_partkey", "GradientBoosting", {"n_estimators": 5})
    b = TR.train_route(part(spark), "p_retailprice", "p_partkey", "GradientBoosting", {"n_estimators": 5})
    assert a.metrics.collect() == b.metrics.collect()


def test_kernel_regression_runs_and_rejects_unknown_kernel(spark):
    res = TR.train_route(part(spark), "p_retailprice", "p_partkey", "SVM", {"kernel": "rbf"})
    assert res.metrics.count() == 4
    try:
        M.KernelRegression({"kernel": "poly"})
        raise AssertionError("poly accepted")
    except ValueError:
        pass


def test_library_classification_metrics_in_range(spark):
    res = TR.train_library(part(spark), "p_type", "p_partkey", "classifier")
    assert res.task == "classification"
    for r in res.metrics.collect():
        assert 0.0 <= r["value"] <= 1.0


def test_save_and_reload(spark):
    from pyspark.ml import PipelineModel
    store = f"{checkpoint_dir(spark)}/models-test"
    res = TR.train_route(part(spark), "p_retailprice", "p_partkey", "LinearRegression")
    mid = S.save_model(spark, store, res, dataset_id="part")
    rec = S.load_records(spark, store).where(F.col("id") == mid).first()
    again = PipelineModel.load(rec["model_path"])
    a = [r["prediction"] for r in res.model.transform(res.test).orderBy("p_partkey").collect()]
    b = [r["prediction"] for r in again.transform(res.test).orderBy("p_partkey").collect()]
    assert a == b
    assert rec["metrics"]["r2_score"] is not None


def test_bad_record_skipped(spark, tmp_path):
    (tmp_path / "x_info.json").write_text('{"id": "a", "name": "ok", "metrics": {"r2": 0.5}}')
    (tmp_path / "y_info.json").write_text('{"id": "b", ')
    recs = S.load_records(spark, str(tmp_path)).collect()
    assert [r["id"] for r in recs] == ["a"]
    assert S.bad_records(spark, str(tmp_path)).count() == 1


def test_class_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 1)], "a int, p int")
    m = E.classification_metrics(df, "a", "p").first()
    assert math.isclose(m["accuracy"], 1 / 3) and math.isclose(m["precision"], (1 / 3) * (1 / 3))


def test_queries_train_on_all_of_part(spark):
    p = load(spark, SF001, "part")
    assert Q._part(spark, SF001).columns == p.columns
    res = Q._route(spark, SF001, "LinearRegression")
    assert sum(n.startswith("p_name_") for n in res.features) == res.train.select("p_name").distinct().count() > 0
