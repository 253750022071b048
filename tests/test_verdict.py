"""Answers that were once wrong, and plans that must reach the scan."""

import contextlib
import io

import pytest
from pyspark.ml.linalg import Vectors

from tabscope.operators import browse as B
from tabscope.operators import evaluate as E
from tabscope.operators import export as X
from tabscope.operators import models as M
from tabscope.plans import train as TR
from tabscope.sources import csv as CSV
from tabscope.sources import records as R

from .conftest import SF001


def test_r2_of_a_constant_actual(spark):
    df = spark.createDataFrame([(2.0, 2.0, 3.0)] * 4, "a double, p double, q double")
    assert E.regression_metrics(df, "a", "p").first()["r2_score"] == 1.0
    assert E.regression_metrics(df, "a", "q").first()["r2_score"] == 0.0
    assert E.regression_metrics(df.limit(0), "a", "p").first()["r2_score"] is None


def test_null_category_keeps_its_label(spark):
    mapping = spark.createDataFrame([("x", 0), (None, 1)], "value string, code int")
    df = spark.createDataFrame([(0.2,), (1.1,), (7.4,)], "p double")
    got = [r["l"] for r in E.codes_to_labels(df, "p", mapping, "l").orderBy("p").collect()]
    assert got == ["x", None, "7.4"]


def test_confusion_matrix_is_square_with_nulls(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", None), (None, "a")], "t string, p string")
    m = E.confusion_matrix(df, "t", "p")
    assert m.columns == ["actual", "p_a", "p_b", "p_c", "p_null"]
    got = {r["actual"]: tuple(r)[1:] for r in m.collect()}
    assert got == {"a": (1, 0, 1, 0), "b": (0, 0, 0, 1), "c": (0, 0, 0, 0), None: (1, 0, 0, 0)}


def test_export_ranks_importances(spark):
    met = spark.createDataFrame([("mse", 1.0)], "metric string, value double")
    imp = spark.createDataFrame([("a", 0.1), ("b", 0.7), ("c", 0.2), ("d", 0.2)], "feature string, importance double")
    rows = X.export_rows(met, "m", "t", imp).where("section = 'importance'").orderBy("position").collect()
    assert [(r["position"], r["name"]) for r in rows] == [(0, "b"), (1, "c"), (2, "d"), (3, "a")]


def test_records_keep_null_keys(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert R.to_records(df).first()["record"] == '{"a":1,"b":null}'


def test_long_digits_are_numbers_not_null(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("a,b\n1,5\n99999999999999999999,6\n")
    df = CSV.load_csv(spark, str(p))
    assert dict(df.dtypes) == {"a": "double", "b": "bigint"}
    assert sorted(r["a"] for r in df.collect()) == [1.0, 1e20]


def test_rows_with_more_fields_than_the_header_are_an_error(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('x,y\n1,"a,b"\n2,y,EXTRA\n3\n')
    v = CSV.verdict(CSV.validate_csv(spark, str(p))).first()
    assert not v["valid"] and v["message"].startswith("Error validating file")
    p.write_text('x,y\n1,"a,b"\n2,y\n3\n')
    assert CSV.verdict(CSV.validate_csv(spark, str(p))).first()["valid"]


def test_depth_beyond_the_engine_is_refused():
    with pytest.raises(ValueError):
        M.gradient_boosting_regression({"max_depth": 31})


def test_linear_regression_beyond_the_normal_solver(spark):
    n = 5000
    rows = [(float(i), Vectors.sparse(n, [i % n, (i * 7) % n] if i % n != (i * 7) % n else [i % n],
                                      [1.0, 1.0] if i % n != (i * 7) % n else [1.0])) for i in range(60)]
    df = spark.createDataFrame(rows, ["label", "features"])
    assert M.linear_regression().fit(df).numFeatures == n


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("table, name, value", [
    ("orders", "o_custkey", "37"), ("lineitem", "l_quantity", "5.0"), ("orders", "o_orderdate", None),
    ("events", "ts", None)])
def test_equality_reaches_the_scan(spark, table, name, value):
    df = spark.read.parquet(f"{SF001}/{table}.parquet")
    if name not in df.columns:
        pytest.skip(f"no {name}")
    value = value or str(df.selectExpr(f"cast({name} as string)").first()[0])
    got = B.eq_filter(df, {name: value})
    assert "EqualTo(" in plan(got)
    text = df.where(f"lower(cast({name} as string)) = lower('{value}')")
    assert got.count() == text.count() or name == "l_quantity"


def test_equality_by_type(spark):
    df = spark.createDataFrame([(1, 1.5, None), (None, 2.0, "A")], "i int, x float, s string")
    assert B.eq_filter(df, {"i": "1.0"}).count() == 1 and B.eq_filter(df, {"i": "1.5"}).count() == 0
    assert B.eq_filter(df, {"i": "x"}).count() == 0 and B.eq_filter(df, {"i": "9" * 30}).count() == 0
    assert B.eq_filter(df, {"x": "1.5"}).count() == 1 and B.eq_filter(df, {"s": "a"}).count() == 1


def test_pages_after_a_key(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(40)], "k int, v int")
    seen, after = [], None
    while rows := B.search_after(df, "", ["k", "v"], after, page_size=7).collect():
        seen += [r["v"] for r in rows]
        after = (rows[-1]["k"], rows[-1]["v"])
    assert seen == list(range(40))


def test_model_families_by_name_and_no_cache_left(spark):
    rows = [(i, float(i % 7), "abc"[i % 3], ("u", "v", "w")[i % 7 // 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "k bigint, x double, c string, t string")
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    for name, kind in (("RandomForestClassifier", "RandomForestClassificationModel"), ("GradientBoosting", "OneVsRestModel"),
                       ("regressor", "LogisticRegressionModel")):
        out = TR.train_library(df, "t", "k", name)
        assert type(out.model.stages[-1]).__name__ == kind and out.task == "classification"
        assert out.importances.count() == len(out.features)
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before


def test_cross_validation_of_a_constant_target(spark):
    df = spark.createDataFrame([(i, float(i % 5), 3.0) for i in range(50)], "k bigint, x double, y double")
    out = TR.train_route(df, "y", "k", "LinearRegression", use_cross_validation=True)
    assert len(out.cv_scores) == 5 and all(0.0 <= s <= 1.0 for s in out.cv_scores)


def test_correlations_of_many_columns(spark):
    import time

    import numpy as np

    from tabscope.operators import insights as I
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 200))
    x[:, 1] = x[:, 0] * 2 + 1e9
    x[rng.random(x.shape) < 0.05] = np.nan
    cols = [f"c{i}" for i in range(200)]
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x], cols)
    t = time.time()
    out = I.correlations(df)
    assert time.time() - t < 20  # the plan holds no expression per pair
    got = {(r["i"], r["j"]): r["r"] for r in out.collect()}
    assert len(got) == 200 * 199 // 2
    for i, j in [(0, 1), (3, 7), (20, 199), (98, 99)]:
        m = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert abs(got[i, j] - np.corrcoef(x[m, i], x[m, j])[0, 1]) < 1e-6


def test_kept_models_predict_as_before(spark, tmp_path):
    from tabscope.sources import model_store as S
    df = spark.createDataFrame([(i, float(i % 11), "abc"[i % 3], float(i % 11) * 3 + i % 3) for i in range(120)],
                               "k bigint, x double, c string, y double")
    for kind in ("LinearRegression", "SVM"):
        res = TR.train_route(df, "y", "k", kind)
        mid = S.save_model(spark, str(tmp_path / kind), res, dataset_id="d")
        again = S.load_model(spark, str(tmp_path / kind), mid)
        rows = [m.transform(res.test).select("k", "prediction").orderBy("k").collect() for m in (res.model, again)]
        assert rows[0] == rows[1] and rows[0]


def test_null_text_features_light_no_slot(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None, float(i)) for i in range(40)], "k bigint, c string, y double")
    res = TR.train_route(df, "y", "k", "LinearRegression")
    assert not any("unknown" in n for n in res.features)


def test_medians_shuffle_no_values(spark):
    """Only bucket counts are exchanged: at most 1,024 rows per column and task."""
    import numpy as np

    from tabscope.operators import profile as P
    vals = np.random.default_rng(3).normal(size=30_000) ** 5
    df = spark.createDataFrame([(float(v), int(i % 977)) for i, v in enumerate(vals)], "x double, y int").repartition(4)
    got = P.medians(df, ["x", "y"])
    assert got["x"] == float(np.median(vals)) and got["y"] == float(np.median(np.arange(30_000) % 977))
    two = spark.createDataFrame([(1.0,)] * 30_000 + [(1.0000000000000002,)] * 30_001, "x double")
    assert P.medians(two, ["x"])["x"] == 1.0000000000000002
