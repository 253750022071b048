"""Training pipelines M9 (route) and M10 (library), cross-validation M12,
importances E3/E4 (SURVEY §2.6–2.7).

Both pipelines are Spark ML ``Pipeline``s: a :class:`~tabscope.operators.encoding.TextEncoder`
turns numeric and text features into sparse vectors (its dictionary is a table,
so text columns may have any number of values), behind it stands the model.
Only model parameters, metrics (a handful of numbers) and ≤ 50 sample rows reach
the driver.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import OneVsRestModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean as C
from ..operators import evaluate as E
from ..operators import features as FT
from ..operators import models as M
from ..operators._long import col
from ..operators.encoding import TextEncoder, TextEncoderModel
from ..session import materialize
from ..types import PROFILE, classify

LABEL = "label"


@dataclass
class TrainResult:
    model: object
    metrics: DataFrame
    importances: DataFrame | None
    sample: DataFrame
    test: DataFrame
    train: DataFrame
    names: DataFrame
    task: str
    mapping: DataFrame | None = None
    cv_scores: list[float] = field(default_factory=list)
    record: dict = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        """The names of all feature slots, in order, collected from ``names``."""
        return [r["feature"] for r in self.names.orderBy("slot").collect()]


def _encoder(df: DataFrame, feature_cols: list[str]) -> TextEncoder:
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    nums = [c for c in feature_cols if isinstance(dtypes[c], (T.NumericType, T.BooleanType))]
    return TextEncoder(textCols=[c for c in feature_cols if c not in nums], numericCols=nums)


def _prepare(df: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Booleans as 0/1 doubles; text features as text (null stays null)."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        if c in feature_cols and isinstance(dtypes[c], T.BooleanType):
            out.append(col(c).cast("double").alias(c))
        elif c in feature_cols and not isinstance(dtypes[c], T.NumericType):
            out.append(col(c).cast("string").alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def _fit(estimator, encoder: TextEncoderModel, vectors: DataFrame):
    """Fit on the encoder's vectors; the result starts at the raw columns."""
    model = estimator.fit(_dealt(estimator, vectors, encoder.size))
    prep = PipelineModel(stages=[encoder])
    return _Chain(prep, model) if isinstance(estimator, M.KernelRegression) else PipelineModel(stages=[encoder, model])


def _dealt(estimator, vectors: DataFrame, slots: int) -> DataFrame:
    """``vectors`` in partitions fit for the estimator. Normal equations take one
    pass, kernel regression and forests deal out their own rows, and Spark's deep
    forest shuffles the counts of all open nodes once per partition, so more of them cost more."""
    once = isinstance(estimator, LinearRegression) and slots <= 4096
    own = isinstance(estimator, (M.KernelRegression, M.Forest, RandomForestClassifier))
    return vectors if once or own else M.spread(vectors, slots)


class _Chain:
    """Prep pipeline followed by a non-ML-stage model (kernel regression)."""

    def __init__(self, prep: PipelineModel, model):
        self.prep, self.model, self.stages = prep, model, prep.stages + [model]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.prep.transform(df))


def _importances(model, names: DataFrame, normalise: bool):
    last = model.stages[-1]
    if isinstance(last, OneVsRestModel):  # M8: mean over the binary models
        each = [m.featureImportances.toArray() for m in last.models]
        return E.importance_table(names, (sum(each) / len(each)).tolist())
    if isinstance(last, M.KernelRegressionModel):  # only the linear kernel has weights per feature
        return E.importance_table(names, last.linear.coefficients.toArray().tolist(), normalise) if last.weights is None else None
    if hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray().tolist()
        return E.importance_table(names, vals)
    if hasattr(last, "coefficientMatrix") and last.numClasses > 2:
        mat = last.coefficientMatrix.toArray()
        vals = [float(sum(abs(mat[k][j]) for k in range(mat.shape[0])) / mat.shape[0])
                for j in range(mat.shape[1])]
        return E.importance_table(names, vals, normalise)
    if hasattr(last, "coefficients"):
        return E.importance_table(names, last.coefficients.toArray().tolist(), normalise)
    return None


def _metrics_frame(spark, pairs: list[tuple[str, float | None]]) -> DataFrame:
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in pairs],
                                 "metric string, value double")


#: Feature slots up to which a linear model is cross-validated from sums.
SUM_SLOTS = 512


def fold_sums(folds: DataFrame, d: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """``{fold: Z'Z}`` with ``Z = [1, X - mark, y - mark]`` over the rows of each fold
    and the marks (means of some first rows, so that sums of large numbers keep their
    digits), in one scan of ``(fold, label, features)``: each task adds up one matrix
    per fold and sends its upper half."""
    rows = folds.select(F.col("fold").cast("int").alias("fold"), F.col(LABEL).cast("double").alias("y"), vector_to_array("features").alias("x"))

    def matrix(batch) -> np.ndarray:
        x = batch.column("x")
        values = x.values.to_numpy()[x.offset * d:(x.offset + len(x)) * d] if d else np.zeros(0)
        return np.column_stack([values.reshape(len(x), d), batch.column("y").to_numpy(zero_copy_only=False)])
    head = rows.limit(1000).toArrow().combine_chunks().to_batches()
    mark = np.concatenate([matrix(b) for b in head]).mean(0) if head else np.zeros(d + 1)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z = matrix(batch) - mark
            z = np.column_stack([np.ones(len(z)), z])
            fold = batch.column("fold").to_numpy()
            for f in np.unique(fold):
                own = z[fold == f]
                sums[f] = sums.get(f, 0.0) + own.T @ own
        i, j = np.triu_indices(d + 2)
        for f, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), f, np.int32)), pa.array(i.astype(np.int32)),
                                              pa.array(j.astype(np.int32)), pa.array(s[i, j])], ["fold", "i", "j", "v"])
    found = rows.mapInArrow(run, "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    fold, i, j, v = (found.column(c).to_numpy() for c in ("fold", "i", "j", "v"))
    out = {}
    for f in np.unique(fold):
        own = fold == f
        s = np.zeros((d + 2, d + 2))
        s[i[own], j[own]] = s[j[own], i[own]] = v[own]
        out[int(f)] = s
    return out, mark


def _scores_from_sums(sums: dict[int, np.ndarray], mark: np.ndarray, k: int, intercept: bool) -> list[float | None]:
    """R² on each fold of the least-squares model of the others."""
    d = len(mark) - 1
    if not intercept:  # back to the raw values: z + mark
        shift = np.eye(d + 2)
        shift[0, 1:] = mark
        sums = {f: shift.T @ s @ shift for f, s in sums.items()}
    whole = sum(sums.values())
    own = slice(0 if intercept else 1, d + 1)
    scores = []
    for f in range(k):
        if f not in sums:
            scores.append(None)
            continue
        test, train = sums[f], whole - sums[f]
        scale = np.sqrt(np.diag(train)[own])
        scale[scale == 0] = 1.0
        beta = np.linalg.lstsq(train[own, own] / np.outer(scale, scale), train[own, -1] / scale, rcond=1e-12)[0] / scale
        sse = test[-1, -1] - 2 * beta @ test[own, -1] + beta @ test[own, own] @ beta
        sst = test[-1, -1] - test[0, -1] ** 2 / test[0, 0]
        sse = max(float(sse), 0.0)
        noise = 1e-12 * max(float(test[-1, -1]), 1.0)
        scores.append(1.0 - sse / sst if sst > noise else float(sse <= noise))  # as E1 for a constant target
    return scores


def cross_validate(estimator, encoder: TextEncoder, data: DataFrame, key: str, k: int = 5) -> list[float]:
    """R² on each of ``k`` contiguous folds (F6) after fitting on the
    others; returns the per-fold scores. The rows are encoded and numbered once,
    before they are dealt out to folds (a value that only the left-out fold has
    is an all-zero slot in the others, which no model here gives any weight).

    A linear model of at most ``SUM_SLOTS`` slots is not fitted ``k`` times: the
    folds' sums of products, from one scan, give each model (all sums less the
    fold's own) and its score. Other models are refitted for each fold."""
    coder = encoder.fit(data)
    vectors = coder.transform(data).select(col(key), LABEL, "features")
    folds = materialize(FT.kfold(vectors, key, k), "folds")
    if isinstance(estimator, LinearRegression) and estimator.getRegParam() == 0.0 and coder.size <= SUM_SLOTS:
        sums, mark = fold_sums(folds, coder.size)
        if all(np.isfinite(s).all() for s in sums.values()):
            return [s for s in _scores_from_sums(sums, mark, k, estimator.getFitIntercept()) if s is not None]

    def score(f: int) -> float | None:
        others = _dealt(estimator, folds.where(F.col("fold") != f), coder.size)
        m = (estimator.copy() if hasattr(estimator, "copy") else estimator).fit(others)
        pred = m.transform(folds.where(F.col("fold") == f))
        return E.regression_metrics(pred, LABEL, "prediction").first()["r2_score"]

    # The folds' jobs run side by side; a fold without rows has no score.
    with ThreadPoolExecutor(min(k, 4)) as pool:
        return [s for s in pool.map(score, range(k)) if s is not None]


def train_route(df: DataFrame, target: str, key: str, model_type: str = "LinearRegression",
                params: dict | None = None, test_size: float = 0.2,
                use_cross_validation: bool = False, model_name: str | None = None) -> TrainResult:
    """M9: the route pipeline – a text target gets first-appearance codes and
    is still fitted with a **regressor** (kept for parity); all other columns
    are features (one-hot for text); md5 split on ``key``; fit; metrics
    (R², MAE, MSE, RMSE); optional 5-fold CV; importances (normalised for
    linear models); a 50-row prediction sample with codes mapped back."""
    spark = df.sparkSession
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    if target not in dtypes:
        raise ValueError(f"no column {target!r} to train on")
    categorical = not isinstance(dtypes[target], (T.NumericType, T.BooleanType))
    mapping = None
    data = df
    if categorical:
        mapping = FT.first_appearance_codes(df, key, [target], max_distinct=None)
        m = mapping.select(F.col("value").alias("_tv"), F.col("code").cast("double").alias(LABEL))
        data = df.join(m, col(target).cast("string").eqNullSafe(F.col("_tv")), "left").drop("_tv")
    else:
        data = df.withColumn(LABEL, col(target).cast("double"))
    feats = [c for c in df.columns if c != target]
    data = _prepare(data, feats)
    estimator = M.route_model(model_type, params)
    data = materialize(FT.train_test_split(data, key, test_size), "train")
    encoder = _encoder(data, feats)
    train = data.where(F.col("split") == "train")
    test = data.where(F.col("split") == "test")
    cv = cross_validate(estimator, encoder, data.drop("split"), key) if use_cross_validation else []
    fitted = encoder.fit(train)
    model = _fit(estimator, fitted, materialize(fitted.transform(train).select(LABEL, "features"), "vectors"))
    pred = model.transform(test)
    row = E.regression_metrics(pred, LABEL, "prediction").first()
    pairs = [(n, row[n]) for n in E.ROUTE_NAMES]
    if cv:
        mean = sum(cv) / len(cv)
        pairs += [("cv_mean_score", mean),
                  ("cv_std_score", math.sqrt(sum((s - mean) ** 2 for s in cv) / len(cv)))]
    names = fitted.names()
    imp = _importances(model, names, normalise=True)
    sample = E.prediction_sample(pred.select(col(key), F.col(LABEL).alias("actual"),
                                             F.col("prediction").alias("predicted")), key)
    if categorical:
        sample = E.codes_to_labels(sample, "actual", mapping)
        sample = E.codes_to_labels(sample, "predicted", mapping)
    record = {"name": model_name or f"{target}_{model_type}_model", "target_column": target,
              "model_type": model_type, "is_categorical_target": categorical}
    return TrainResult(model, _metrics_frame(spark, pairs), imp, sample, test, train, names,
                       "regression", mapping, cv, record)


def train_library(df: DataFrame, target: str, key: str, model_type: str = "classifier",
                  preprocessing: dict | None = None, exclude_columns=None) -> TrainResult:
    """The library pipeline – task from the target's class (numeric →
    regression, text → classification; the asked type is corrected), text
    targets get alphabetical codes (F2), exclusions dropped (B9), optional
    median/'Unknown' fill of features (B2/B3), one-hot of text features,
    md5 split; metrics (mse, rmse, r2) or (accuracy, f1, precision, recall)
    and raw importances."""
    spark = df.sparkSession
    pre = preprocessing or {}
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    if target not in dtypes:
        raise ValueError(f"no column {target!r} to train on")
    target_type = pre.get("target_type") or (
        "numeric" if isinstance(dtypes[target], (T.NumericType, T.BooleanType)) else "categorical")
    # The target decides the task; the asked name only picks the family.
    task = "classification" if target_type == "categorical" else "regression"
    t = model_type.lower()
    data = df
    mapping = None
    if task == "classification" and target_type == "categorical":
        mapping = FT.label_codes(df, target)
        m = mapping.select(F.col("value").alias("_tv"), F.col("code").cast("double").alias(LABEL))
        data = df.join(m, col(target).cast("string") == F.col("_tv"), "left").drop("_tv")
    else:
        data = df.withColumn(LABEL, col(target).cast("double"))
    feats = [c for c in df.columns if c != target and c not in (exclude_columns or [])]
    cls = classify(data.select(*[col(c) for c in feats]), PROFILE)
    if pre.get("handle_missing", True):
        data = C.unknown_fill(C.median_fill(data, list(cls.numeric)), list(cls.categorical))
    if not pre.get("encode_categorical", True):
        feats = [c for c in feats if c in cls.numeric]
    data = _prepare(data, feats)
    data = materialize(FT.train_test_split(data, key, 0.2), "train")
    train = data.where(F.col("split") == "train")
    test = data.where(F.col("split") == "test")
    fitted = _encoder(data, feats).fit(train)
    vectors = materialize(fitted.transform(train).select(LABEL, "features"), "vectors")
    model = _fit(M.library_model(t, task, vectors.count()), fitted, vectors)
    pred = model.transform(test)
    if task == "classification":
        metrics = E.classification_metrics(pred, LABEL, "prediction")
        row = metrics.first()
        pairs = [(n, row[n]) for n in ("accuracy", "f1_score", "precision", "recall")]
    else:
        row = E.regression_metrics_library(pred, LABEL, "prediction").first()
        pairs = [(n, row[n]) for n in E.LIBRARY_NAMES]
    names = fitted.names()
    imp = _importances(model, names, normalise=False)
    sample = E.prediction_sample(pred.select(col(key), F.col(LABEL).alias("actual"),
                                             F.col("prediction").alias("predicted")), key)
    return TrainResult(model, _metrics_frame(spark, pairs), imp, sample, test, train, names,
                       task, mapping, [], {"target_column": target, "model_type": t})
