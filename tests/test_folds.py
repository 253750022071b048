"""Cross-validation of linear models from fold sums, importances of the linear kernel."""

import math

import numpy as np
import pytest

from tabscope.operators import models as M
from tabscope.plans import train as TR


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(700):
        a, b = float(rng.normal() + 100), float(rng.random())
        rows.append((i, a, b, "uvw"[i % 3] if i % 11 else None, 2 * (a - 100) - 5 * b + (i % 3) + float(rng.normal())))
    return spark.createDataFrame(rows, "k bigint, a double, b double, t string, y double").repartition(4)


@pytest.mark.parametrize("intercept", [True, False])
def test_sums_equal_refitting(spark, data, monkeypatch, intercept):
    params = {"fit_intercept": intercept}
    one_scan = TR.train_route(data, "y", "k", "LinearRegression", params, use_cross_validation=True).cv_scores
    monkeypatch.setattr(TR, "SUM_SLOTS", 0)
    refitted = TR.train_route(data, "y", "k", "LinearRegression", params, use_cross_validation=True).cv_scores
    assert len(one_scan) == len(refitted) == 5
    assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-8) for a, b in zip(one_scan, refitted))
    rows = sorted(map(tuple, data.select("k", "a", "b", "t", "y").collect()))
    x = np.array([[r[0], r[1], r[2], *(r[3] == v for v in "uvw")] for r in rows], float)
    y = np.array([r[4] for r in rows])
    if intercept:
        x = np.column_stack([np.ones(len(x)), x - x.mean(0)])
        for f, part in enumerate(np.array_split(np.arange(700), 5)):
            rest = np.setdiff1d(np.arange(700), part)
            beta = np.linalg.lstsq(x[rest], y[rest], rcond=None)[0]
            e = y[part] - x[part] @ beta
            assert math.isclose(one_scan[f], 1 - (e @ e) / ((y[part] - y[part].mean()) ** 2).sum(), rel_tol=1e-7)


def test_no_model_is_fitted(spark, data, monkeypatch):
    fits = []
    monkeypatch.setattr(M, "linear_regression", lambda p=None, _f=M.linear_regression, **kw: _f(p, **kw))
    real = TR.LinearRegression._fit
    monkeypatch.setattr(TR.LinearRegression, "_fit", lambda self, df: fits.append(1) or real(self, df))
    TR.train_route(data, "y", "k", "LinearRegression", use_cross_validation=True)
    assert len(fits) == 1  # the route's own model


def test_more_folds_than_rows(spark):
    few = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 4.0), (3, 3.0, 6.0)], "k bigint, x double, y double")
    out = TR.cross_validate(M.linear_regression(), TR._encoder(few, ["x"]), few.withColumnRenamed("y", "label"), "k", 5)
    assert len(out) <= 5 and all(np.isfinite(out))


def test_linear_kernel_has_importances(spark, data):
    res = TR.train_route(data.drop("t"), "y", "k", "SVM", {"kernel": "linear"})
    imp = {r["feature"]: r["importance"] for r in res.importances.collect()}
    assert set(imp) == {"k", "a", "b"} and math.isclose(sum(imp.values()), 1.0) and imp["b"] == max(imp.values())
    assert TR.train_route(data.drop("t"), "y", "k", "SVM", {"kernel": "rbf"}).importances is None
