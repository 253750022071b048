"""Models M1–M8, M11, M12 on Spark ML.

Each estimator is a Spark ML stage fitted by distributed jobs; only model
parameters (coefficients, trees) live on the driver. There is no exact parity
with scikit-learn for trees, boosting, logistic or kernel models (other
algorithms, binning and random streams), so those are checked by invariants.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .forest import Forest

SEED = 42
MAX_TREE_DEPTH = 30  # Spark's cap; an unlimited depth maps to it
# Deep forests: keep node ids per row instead of re-walking the trees each
# level, and let one pass over the data split more nodes at once. Neither
# changes the fitted trees.
TREE_TUNING = {"cacheNodeIds": True, "maxMemoryInMB": 1024}


# Bytes of one partition as the fits hold it (dense, 8 bytes a slot): all tables
# stay below ``PART_BYTES``; smaller ones are dealt out for their CPU time, from
# ``LEAST_BYTES`` a partition, but not to more than ``SIDE_BY_SIDE``.
PART_BYTES = 32 << 20
LEAST_BYTES = 2 << 20
SIDE_BY_SIDE = 48


def partitions(rows: int, slots: int) -> int:
    """Number of partitions for the fit of ``rows`` vectors of ``slots``."""
    size = rows * max(slots, 1) * 8
    return max(1, -(-size // PART_BYTES), min(-(-size // LEAST_BYTES), SIDE_BY_SIDE))


def spread(vectors: DataFrame, slots: int, rows: int | None = None) -> DataFrame:
    """``vectors`` dealt out for an iterative fit. The files are sized by sparse,
    compressed rows, while a fit keeps them dense and reads them again in each
    round: without this, one task would hold and reread what one small file holds."""
    n = partitions(vectors.count() if rows is None else rows, slots)
    return vectors if n == 1 else vectors.repartition(n)


def _depth(v) -> int:
    """``None`` (unlimited) is the engine's deepest tree; a wanted depth beyond
    it is refused, not cut."""
    if v is not None and int(v) > MAX_TREE_DEPTH:
        raise ValueError(f"max_depth {v}: trees here have at most {MAX_TREE_DEPTH} levels")
    return MAX_TREE_DEPTH if v is None else int(v)


def linear_regression(params: dict | None = None, features="features", label="label",
                      prediction="prediction") -> Estimator:
    """M1: ordinary least squares, intercept optional: normal equations while
    the features allow it (4,096 slots), else L-BFGS on the same loss.
    ``normalize`` does not change OLS predictions and is ignored."""
    p = params or {}
    return LinearRegression(featuresCol=features, labelCol=label, predictionCol=prediction,
                            solver="auto", regParam=0.0, elasticNetParam=0.0,
                            fitIntercept=bool(p.get("fit_intercept", True)), standardization=False)


def random_forest_regression(params: dict | None = None, features="features", label="label",
                             prediction="prediction") -> Estimator:
    """M2: random forest (100 trees, unlimited depth → 30, all features per
    split as scikit's regressor default). ``min_samples_split`` has no
    counterpart: it becomes ``min_leaf = max(leaf, ceil(split / 2))``."""
    p = params or {}
    leaf = int(p.get("min_samples_leaf", 1))
    split = int(p.get("min_samples_split", 2))
    return Forest("regression", int(p.get("n_estimators", 100)), _depth(p.get("max_depth")),
                  max(leaf, math.ceil(split / 2)), "all", SEED, features, label, prediction)


def gradient_boosting_regression(params: dict | None = None, features="features", label="label",
                                 prediction="prediction") -> Estimator:
    """M3: gradient-boosted trees (100 rounds, rate 0.1, depth 3, subsample 1)."""
    p = params or {}
    return GBTRegressor(featuresCol=features, labelCol=label, predictionCol=prediction,
                        maxIter=int(p.get("n_estimators", 100)), stepSize=float(p.get("learning_rate", 0.1)),
                        maxDepth=_depth(p.get("max_depth", 3)),
                        subsamplingRate=float(p.get("subsample", 1.0)), seed=SEED)


@dataclass
class KernelRegressionModel:
    """Fitted M4: random Fourier feature map + linear model."""
    weights: np.ndarray | None
    offsets: np.ndarray | None
    linear: Model
    features: str = "features"
    prediction: str = "prediction"
    extra: dict = field(default_factory=dict)

    def _mapped(self, df: DataFrame) -> DataFrame:
        if self.weights is None:
            return df.withColumn("_rff", F.col(self.features))
        w = self.weights
        b = self.offsets
        scale = math.sqrt(2.0 / w.shape[0])

        # The map is a dense matrix product per Arrow batch (numpy inside the
        # task); Spark still partitions the rows. W is D×d: small, shipped
        # with the closure.
        @F.pandas_udf("array<double>")
        def rff(x: pd.Series) -> pd.Series:
            if len(x) == 0:
                return pd.Series([], dtype=object)
            m = np.stack(x.to_numpy())
            z = np.cos(m @ w.T + b) * scale
            return pd.Series(list(z))

        x = vector_to_array(F.col(self.features))
        return df.withColumn("_rff", array_to_vector(rff(x)))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.linear.transform(self._mapped(df)).drop("_rff")


class KernelRegression:
    """M4 (approximation, documented deviation): support-vector regression has
    no Spark counterpart. ``kernel='rbf'`` maps features with D random Fourier
    features (Rahimi & Recht 2007) of the RBF kernel exp(−γ‖x−y‖²) and fits a
    Huber-loss linear model with ``regParam = 1/(C·n)``; ``kernel='linear'``
    skips the map. ``gamma='scale'`` = 1/(d·Var X) over all feature values.
    Other kernels raise. Predictions approximate, not equal, an SVR's."""

    def __init__(self, params: dict | None = None, features="features", label="label",
                 prediction="prediction", components: int = 100):
        p = params or {}
        self.kernel = p.get("kernel", "rbf")
        if self.kernel not in ("rbf", "linear"):
            raise ValueError(f"kernel {self.kernel!r} is not supported (rbf, linear)")
        self.c = float(p.get("C", 1.0))
        self.gamma = p.get("gamma", "scale")
        self.features, self.label, self.prediction = features, label, prediction
        self.components = components

    def fit(self, df: DataFrame) -> KernelRegressionModel:
        arr = vector_to_array(F.col(self.features))
        first = df.select(F.size(arr).alias("d")).first()
        d = int(first["d"]) if first else 0
        st = df.select(F.explode(arr).alias("v")).agg(F.var_pop("v").alias("var"),
                                                      F.count(F.lit(1)).alias("cells")).first()
        n = max(1, int(st["cells"] // max(d, 1)))
        weights = offsets = None
        if self.kernel == "rbf":
            if self.gamma == "scale":
                var = st["var"] or 0.0
                gamma = 1.0 / (d * var) if d and var > 0 else 1.0
            elif self.gamma == "auto":
                gamma = 1.0 / max(d, 1)
            else:
                gamma = float(self.gamma)
            rng = np.random.default_rng(SEED)
            weights = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(self.components, d))
            offsets = rng.uniform(0.0, 2.0 * math.pi, size=self.components)
        df = spread(df, d if weights is None else max(d, self.components), n)
        model = KernelRegressionModel(weights, offsets, None, self.features, self.prediction)  # type: ignore[arg-type]
        lr = LinearRegression(featuresCol="_rff", labelCol=self.label, predictionCol=self.prediction,
                              loss="huber", regParam=1.0 / (self.c * n), elasticNetParam=0.0,
                              maxIter=200)
        model.linear = lr.fit(model._mapped(df))
        return model


def logistic_regression(n_rows: int | None = None, features="features", label="label",
                        prediction="prediction") -> Estimator:
    """M6: multinomial logistic regression, ≤ 1000 iterations, L2 with
    regParam = 1/n (scikit's C = 1 on the unnormalised loss)."""
    reg = 1.0 / n_rows if n_rows else 0.0
    return LogisticRegression(featuresCol=features, labelCol=label, predictionCol=prediction,
                              family="auto", maxIter=1000, regParam=reg, elasticNetParam=0.0,
                              standardization=False)


def random_forest_classification(features="features", label="label",
                                 prediction="prediction") -> Estimator:
    """M10's random forest classifier, 100 trees, seed 42 (Spark's: its nodes lie on the driver)."""
    return RandomForestClassifier(featuresCol=features, labelCol=label, predictionCol=prediction,
                                  numTrees=100, maxDepth=MAX_TREE_DEPTH, seed=SEED, **TREE_TUNING)


def forest_classification(features="features", label="label", prediction="prediction") -> Estimator:
    """M7: random forest classifier, 100 trees, unlimited depth → 30, seed 42."""
    return Forest("classification", 100, MAX_TREE_DEPTH, 1, "sqrt", SEED, features, label, prediction)


def boosting_classification(features="features", label="label", prediction="prediction",
                            parallelism: int = 4) -> Estimator:
    """M8: boosted classification for any number of classes: Spark's
    ``GBTClassifier`` is binary, so one-vs-rest over it (binary fits run in
    parallel)."""
    gbt = GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=3, seed=SEED)
    return OneVsRest(classifier=gbt, featuresCol=features, labelCol=label,
                     predictionCol=prediction, parallelism=parallelism)


MAX_BINS = 32  # of a slot, as in Spark's trees
BIN_VALUES = 10_000  # distinct values of a slot that are weighed one by one


def bin_edges(df: DataFrame, features: str, slots: int, max_bins: int = MAX_BINS,
              most: int = BIN_VALUES) -> list[list[float]]:
    """Per slot the thresholds between which trees cannot tell values apart, by the
    rule of Spark's trees, from all rows (Spark draws some 10,000): midpoints at
    equal shares of the rows. A slot of more than ``most`` values is cut at its
    quantiles."""
    values = df.select(F.posexplode(vector_to_array(F.col(features))).alias("slot", "v"))
    finite = ~F.isnan("v") & (F.abs("v") < float("inf"))  # else an error, as in Spark's fits
    values = values.withColumn("v", F.when(finite, F.col("v")).otherwise(
        F.raise_error(F.lit("Vector values MUST NOT be NaN or Infinity")).cast("double")))
    counts = materialize(values.groupBy("slot", "v").agg(F.count(F.lit(1)).alias("n")), "values")
    many = {r["slot"] for r in counts.groupBy("slot").agg(F.count(F.lit(1)).alias("k"))
                                     .where(F.col("k") > most).collect()}
    few: dict[int, list] = {}
    for row in counts.where(~F.col("slot").isin(*many) if many else F.lit(True)).collect():
        few.setdefault(row["slot"], []).append((row["v"], row["n"]))
    shares = [k / max_bins for k in range(1, max_bins)]
    cut = {}
    if many:
        wide = (values.where(F.col("slot").isin(*many)).groupBy("slot")
                      .agg(F.percentile_approx("v", shares, 100_000).alias("q"), F.max("v").alias("top")))
        cut = {r["slot"]: sorted({q for q in r["q"] if q < r["top"]}) for r in wide.collect()}
    return [cut[j] if j in cut else _midpoints(sorted(few.get(j, [])), max_bins) for j in range(slots)]


def _midpoints(counts: list[tuple[float, int]], max_bins: int) -> list[float]:
    """Thresholds of one slot from its sorted ``(value, rows)``."""
    rows = sum(n for _, n in counts)
    most = min(max_bins, rows) - 1
    pairs = list(zip(counts, counts[1:]))
    if len(pairs) <= most:
        return [(a + b) / 2.0 for (a, _), (b, _) in pairs]
    out, upto, stride = [], 0, rows / (most + 1)
    target = stride
    for (a, n), (b, m) in pairs:
        upto += n
        if abs(upto - target) < abs(upto + m - target):
            out.append((a + b) / 2.0)
            target += stride
    return out


@dataclass
class BinnedModel:
    """Fitted classifier on bin numbers: each combination of bins is scored once."""
    edges: list[list[float]]
    model: Model
    features: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        rows = df.withColumn("_bins", _bins(self.features, self.edges))
        cells = rows.select("_bins").distinct().withColumn(self.features, _bin_vector())
        found = self.model.transform(cells).drop(self.features)
        return rows.join(found, "_bins").drop("_bins")


def _bins(features: str, edges: list[list[float]]):
    """The bin of every slot: the number of its thresholds below the value."""
    cuts = F.array(*[F.array(*[F.lit(float(e)) for e in own]).cast("array<double>") for own in edges])
    return F.transform(vector_to_array(F.col(features)),
                       lambda v, j: F.size(F.filter(F.get(cuts, j), lambda e: e < v)))


def _bin_vector():
    return array_to_vector(F.col("_bins").cast("array<double>"))


class BinnedClassifier:
    """M8 over few slots: trees see a value only by its bin (32 per slot), so rows
    that agree in all bins and the label are one row with their number as weight.
    The trees are those of all rows; each of the rounds' passes reads as many
    rows as there are combinations, not as the table has."""

    def __init__(self, features="features", label="label", prediction="prediction"):
        self.features, self.label, self.prediction = features, label, prediction

    def cells(self, df: DataFrame) -> tuple[DataFrame, list[list[float]]]:
        """``(_bins, label, _weight, features)`` and the thresholds."""
        first = df.select(F.size(vector_to_array(F.col(self.features))).alias("d")).first()
        edges = bin_edges(df, self.features, int(first["d"]) if first else 0)
        rows = df.select(_bins(self.features, edges).alias("_bins"), self.label)
        cells = rows.groupBy("_bins", self.label).agg(F.count(F.lit(1)).cast("double").alias("_weight"))
        return materialize(cells.withColumn(self.features, _bin_vector()), "cells"), edges

    def fit(self, df: DataFrame) -> BinnedModel:
        cells, edges = self.cells(df)
        est = boosting_classification(self.features, self.label, self.prediction).setWeightCol("_weight")
        return BinnedModel(edges, est.fit(spread(cells, len(edges))), self.features)


# Model names accepted by the training route.
ROUTE_MODELS = ("LinearRegression", "RandomForest", "GradientBoosting", "SVM")


def route_model(model_type: str, params: dict | None = None, **cols):
    """M9 model factory: the route's four regressors by name; others raise."""
    if model_type == "LinearRegression":
        return linear_regression(params, **cols)
    if model_type == "RandomForest":
        return random_forest_regression(params, **cols)
    if model_type == "GradientBoosting":
        return gradient_boosting_regression(params, **cols)
    if model_type == "SVM":
        return KernelRegression(params, **cols)
    raise ValueError(f"no model named {model_type!r}; known: {', '.join(ROUTE_MODELS)}")


def library_model(model_type: str, task: str, n_rows: int | None = None, **cols):
    """M10 model factory: the task fixes the kind of model, the words of its
    name the family (forest, boosting, else linear or logistic)."""
    name = model_type.lower()
    family = "forest" if "forest" in name else "boost" if "boost" in name or "gradient" in name else "linear"
    build = {
        ("classification", "forest"): lambda: random_forest_classification(**cols),
        ("classification", "boost"): lambda: boosting_classification(**cols),
        ("classification", "linear"): lambda: logistic_regression(n_rows, **cols),
        ("regression", "forest"): lambda: random_forest_regression(None, **cols),
        ("regression", "boost"): lambda: gradient_boosting_regression(None, **cols),
        ("regression", "linear"): lambda: linear_regression(None, **cols),
    }
    return build[task, family]()


def score(model, df: DataFrame) -> DataFrame:
    """Batch scoring (``model.transform``)."""
    return model.transform(df)
