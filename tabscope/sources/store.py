"""Result stores S5 (profile cache) and S9 (encoders) on Parquet.

A profile is computed once per dataset and written under
``<store>/<kind>/dataset_id=<id>``; later reads prune to that partition. The
folder must be shared storage on a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import profile as P
from ..operators import states as ST


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _part(store: str, kind: str, dataset_id: str) -> str:
    return f"{store.rstrip('/')}/{kind}/dataset_id={dataset_id}"


def save_frame(df: DataFrame, store: str, kind: str, dataset_id: str) -> None:
    df.write.mode("overwrite").parquet(_part(store, kind, dataset_id))


def read_frame(spark: SparkSession, store: str, kind: str, dataset_id: str) -> DataFrame:
    base = f"{store.rstrip('/')}/{kind}"
    return (spark.read.option("basePath", base).parquet(_part(store, kind, dataset_id))
                 .drop("dataset_id"))


def cached_profile(spark: SparkSession, df: DataFrame, store: str, dataset_id: str,
                   refresh: bool = False) -> dict[str, DataFrame]:
    """The dataset's profile – numeric (C1), categorical (C2) and filter
    options (C3) – computed and written once (the ``processed`` flag is the
    presence of the numeric part), read back afterwards."""
    kinds = ("numeric", "categorical", "options")
    if refresh or not _exists(spark, _part(store, "numeric", dataset_id)):
        save_frame(P.categorical_profile(df), store, "categorical", dataset_id)
        save_frame(P.filter_options(df), store, "options", dataset_id)
        save_frame(P.numeric_profile(df), store, "numeric", dataset_id)
    return {k: read_frame(spark, store, k, dataset_id) for k in kinds}


def profile_json(profile: dict[str, DataFrame]) -> DataFrame:
    """S5 JSON view: ``(column, stats)`` with the source tool's per-column
    JSON objects (numeric: type/min/max/mean/median/std/unique_values;
    categorical: type/unique_values/value_counts map)."""
    num = profile["numeric"].select(
        "column", F.to_json(F.struct(F.lit("numeric").alias("type"), "min", "max", "mean", "median",
                                     "std", "unique_values")).alias("stats"))
    cat = (profile["categorical"].groupBy("column")
           .agg(F.first("unique_values").alias("unique_values"),
                F.map_from_entries(F.collect_list(F.struct("value", "count"))).alias("value_counts"))
           .select("column", F.to_json(F.struct(F.lit("categorical").alias("type"), "unique_values",
                                                "value_counts")).alias("stats")))
    return num.unionByName(cat)


def add_part(df: DataFrame, store: str, dataset_id: str, part: str) -> None:
    """Keep the profile state of one part (a file, a day) of a dataset: the only scan
    that a new part needs. A part that is there is replaced."""
    states = ST.column_states(df).withColumn("part", F.lit(part))
    (states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part")
     .parquet(_part(store, "states", dataset_id)))


def drop_part(spark: SparkSession, store: str, dataset_id: str, part: str) -> None:
    """Take a part out of a dataset's profile."""
    states = ST.column_states(spark.createDataFrame([], "x double")).limit(0)
    path = f"{_part(store, 'states', dataset_id)}/part={_escaped(spark, part)}"
    states.write.mode("overwrite").parquet(path)


def _escaped(spark: SparkSession, value: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def read_states(spark: SparkSession, store: str, dataset_id: str) -> DataFrame:
    """The kept states of all parts, with their ``part``."""
    return spark.read.schema(f"{ST.STATE}, part string").parquet(_part(store, "states", dataset_id))


def stored_profile(spark: SparkSession, store: str, dataset_id: str) -> DataFrame:
    """The dataset's profile from the states of its parts; no part is scanned."""
    return ST.profile_of(ST.merge_states(read_states(spark, store, dataset_id), spread="part"))


def save_encoders(codes: DataFrame, store: str, dataset_id: str) -> None:
    """F1 encoders ``(column, value, code)`` per dataset (the source tool
    overwrote one file shared by all datasets)."""
    save_frame(codes, store, "encoders", dataset_id)


def load_encoders(spark: SparkSession, store: str, dataset_id: str) -> DataFrame:
    try:
        return read_frame(spark, store, "encoders", dataset_id)
    except AnalysisException:
        return spark.createDataFrame([], "column string, value string, code int")
