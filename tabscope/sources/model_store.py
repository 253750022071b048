"""Model store S10/S11.

A fitted model is written with Spark ML's writer next to a one-row JSON
metadata record with an explicit schema (inferring it would turn the metric
and mapping maps into structs with one field per key). The store folder must
be shared storage on a cluster (the caller passes it; tests use a scratch
folder).
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

RECORD_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("dataset_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("target_column", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("model_path", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("created_at", T.StringType()),
    T.StructField("is_categorical_target", T.BooleanType()),
    T.StructField("target_mapping", T.MapType(T.StringType(), T.IntegerType())),
])
CORRUPT = "_corrupt_record"


def save_model(spark: SparkSession, store: str, result, dataset_id: str,
               model_name: str | None = None, model_id: str | None = None,
               created_at: str | None = None) -> str:
    """Write the fitted model and its metadata record; returns the id.
    Id and time are new unless given.

    ``result`` is a :class:`tabscope.plans.train.TrainResult`. The metrics are a few
    numbers; the target mapping, which may have any number of classes, is written as a
    table beside the record (:func:`load_mapping`).
    """
    model_id = model_id or str(uuid.uuid4())
    path = f"{store.rstrip('/')}/{model_id}"
    model = result.model
    if hasattr(model, "write"):
        model.write().overwrite().save(path)
    else:  # prep pipeline + kernel model
        model.prep.write().overwrite().save(f"{path}/prep")
        model.model.linear.write().overwrite().save(f"{path}/linear")
        w = model.model.weights
        spark.createDataFrame([(json.dumps({
            "weights": None if w is None else w.tolist(),
            "offsets": None if model.model.offsets is None else model.model.offsets.tolist()}),)],
            "params string").coalesce(1).write.mode("overwrite").text(f"{path}/map")
    metrics = {r["metric"]: r["value"] for r in result.metrics.collect()}
    if result.mapping is not None:
        value = F.coalesce("value", F.lit("NaN")).alias("value")
        result.mapping.select(value, F.col("code").cast("int")).write.mode("overwrite").parquet(_mapping(store, model_id))
    rec = result.record
    row = (model_id, dataset_id, model_name or rec.get("name"), rec.get("target_column"),
           rec.get("model_type"), path, metrics, created_at or dt.datetime.now().isoformat(),
           bool(rec.get("is_categorical_target", False)), {})
    (spark.createDataFrame([row], RECORD_SCHEMA).coalesce(1)
          .write.mode("overwrite").json(f"{store.rstrip('/')}/{model_id}_info"))
    return model_id


def _mapping(store: str, model_id: str) -> str:
    return f"{store.rstrip('/')}/{model_id}_mapping"


def load_mapping(spark: SparkSession, store: str, model_id: str) -> DataFrame:
    """``(value, code)`` of a kept model's target: the table written with it, or what
    its record holds (records of other tools); no rows for a numeric target."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_mapping(store, model_id))
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.parquet(_mapping(store, model_id))
    return (load_records(spark, store).where(F.col("id") == model_id)
            .select(F.explode("target_mapping").alias("value", "code")))


def load_model(spark: SparkSession, store: str, model_id: str):
    """The kept model with its ``transform``: a Spark ML pipeline, or the prep
    pipeline with the kernel model behind it."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.regression import LinearRegressionModel

    from ..operators.models import KernelRegressionModel
    from ..plans.train import _Chain

    path = f"{store.rstrip('/')}/{model_id}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/map")
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return PipelineModel.load(path)
    params = json.loads(spark.read.text(f"{path}/map").first()[0])
    arrays = {k: None if v is None else np.array(v) for k, v in params.items()}
    model = KernelRegressionModel(arrays["weights"], arrays["offsets"], LinearRegressionModel.load(f"{path}/linear"))
    return _Chain(PipelineModel.load(f"{path}/prep"), model)


def load_records(spark: SparkSession, store: str) -> DataFrame:
    """Every readable metadata record under ``store`` (our JSON-lines
    folders and single pretty-printed JSON files alike). Unreadable records
    are kept out and reported by :func:`bad_records`; missing fields are NULL."""
    raw = _read(spark, store)
    return raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_records(spark: SparkSession, store: str) -> DataFrame:
    """The records that could not be parsed, with their text."""
    raw = _read(spark, store).select("id", F.input_file_name().alias("file"), CORRUPT)
    # The reader only fills the corrupt-record column when whole rows are parsed, so
    # they are written before they are filtered.
    return materialize(raw, "records").where(F.col(CORRUPT).isNotNull()).select("file", F.col(CORRUPT).alias("text"))


def _read(spark: SparkSession, store: str) -> DataFrame:
    schema = T.StructType(RECORD_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(schema)
                 .option("multiLine", True).option("mode", "PERMISSIVE")
                 .option("columnNameOfCorruptRecord", CORRUPT)
                 .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
                 .json(store))


def models_of(records: DataFrame, dataset_id: str) -> DataFrame:
    """A dataset's models, newest first (S8 per group)."""
    return records.where(F.col("dataset_id") == dataset_id).orderBy(F.desc("created_at"), "id")
