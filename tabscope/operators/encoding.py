"""Text columns as vector slots, for any number of values.

The dictionary of the encoding is a table ``(column, value, slot)``: the distinct
values of every text column, numbered by column and value with the distributed
:func:`tabscope.operators.rank.row_index`. No value ever comes to the driver: rows
get their slots by joins (which AQE broadcasts only if it finds the table small,
and splits for hot values), names are read from the table, and the fitted stage
is kept as its parameters and a Parquet table.

Slots: the numeric columns first, one slot each in the given order, then one per
value of each text column, columns in the given order and values ascending (the
order of ``get_dummies``). A missing text, or a value that was not there when the
dictionary was made, has no slot: all its column's slots are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from ._long import col, order_expr, text_form, to_long
from .rank import row_index


def dictionary(df: DataFrame, columns: Sequence[str], first: int = 0) -> DataFrame:
    """``(column, value, slot)``: the distinct present values of text columns,
    numbered from ``first`` by column (in the given order) and value."""
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "column string, value string, slot long")
    values = to_long(df, list(columns), numeric=False).select("column", "value").distinct()
    placed = row_index(values.withColumn("_at", order_expr(list(columns))), ["_at", "value"], "slot")
    return placed.select("column", "value", (F.col("slot") + first).alias("slot"))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: codes 0, 1, … of the distinct present values in
    ascending order (scikit ``LabelEncoder``)."""
    return dictionary(df, [column]).select("value", F.col("slot").cast("int").alias("code"))


def one_hot_cells(df: DataFrame, key: str, columns: Sequence[str] | None = None,
                  numeric: Sequence[str] | None = None) -> DataFrame:
    """F3 in long form: ``(<key>, slot, feature, x)``, the cells of ``get_dummies``
    that are not 0 by default: every numeric column's value (NULL stays NULL) and a
    1 for every text that is there. ``feature`` is the column or ``<column>_<value>``."""
    from ..types import PROFILE, classify
    cls = classify(df, PROFILE)
    texts = list(columns) if columns is not None else list(cls.categorical)
    nums = list(numeric) if numeric is not None else [c for c in cls.numeric if c != key]
    out = None
    if nums:
        out = to_long(df, nums, numeric=True, keep=[key], drop_nulls=False).select(
            col(key), order_expr(nums).cast("long").alias("slot"), F.col("column").alias("feature"), F.col("value").alias("x"))
    if texts:
        cells = to_long(df, texts, numeric=False, keep=[key]).join(dictionary(df, texts, len(nums)), ["column", "value"])
        cells = cells.select(col(key), "slot", F.concat_ws("_", "column", "value").alias("feature"), F.lit(1.0).alias("x"))
        out = cells if out is None else out.unionByName(cells)
    return out


def _sparse(size: int, indices: Column, values: Column) -> Column:
    """A sparse ML vector from sorted indices and their values. There is no built-in
    function for it; a vector is stored as a struct, so it goes through JSON,
    inside the JVM."""
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
                     indices.alias("indices"), values.alias("values"))
    schema = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), schema)["v"]


class _EncoderParams(Params):
    textCols = Param(Params._dummy(), "textCols", "text columns, one slot per value", TypeConverters.toListString)
    numericCols = Param(Params._dummy(), "numericCols", "numeric columns, one slot each", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(textCols=[], numericCols=[], outputCol="features")


class TextEncoder(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Makes the dictionary of the text columns of a table."""

    @keyword_only
    def __init__(self, *, textCols=None, numericCols=None, outputCol="features"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> TextEncoderModel:
        texts, nums = self.getOrDefault("textCols"), self.getOrDefault("numericCols")
        table = materialize(dictionary(df, texts, len(nums)), "dictionary", keep=True)
        return self._copyValues(TextEncoderModel(table, len(nums) + table.count()))


class TextEncoderModel(Model, _EncoderParams, MLReadable, MLWritable):
    """Adds the vector column. A NULL or NaN in a numeric column is an error."""

    def __init__(self, table: DataFrame | None = None, size: int = 0):
        super().__init__()
        self.table, self.size = table, size

    def names(self) -> DataFrame:
        """``(slot, feature)`` of every slot."""
        nums = self.getOrDefault("numericCols")
        texts = self.table.select("slot", F.concat_ws("_", "column", "value").alias("feature"))
        head = self.table.sparkSession.createDataFrame(list(enumerate(nums)), "slot long, feature string")
        return head.unionByName(texts)

    def _transform(self, df: DataFrame) -> DataFrame:
        texts, nums, out = (self.getOrDefault(p) for p in ("textCols", "numericCols", "outputCol"))
        kinds = {f.name: f.dataType for f in df.schema.fields}
        have = df.columns
        for k, c in enumerate(texts):
            slots = self.table.where(F.col("column") == c).select(F.col("value").alias(f"__v{k}"), F.col("slot").cast("int").alias(f"__s{k}"))
            df = df.join(slots, text_form(c, kinds[c]) == F.col(f"__v{k}"), "left")
        invalid = F.raise_error(F.lit("a numeric feature is NULL or NaN")).cast("double")
        number = [F.coalesce(F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")), invalid) for c in nums]
        found = F.filter(F.array(*[F.col(f"__s{k}") for k in range(len(texts))]).cast("array<int>"), lambda s: s.isNotNull())
        vector = _sparse(self.size, F.concat(F.array(*[F.lit(i) for i in range(len(nums))]).cast("array<int>"), found),
                         F.concat(F.array(*number).cast("array<double>"), F.transform(found, lambda _: F.lit(1.0))))
        return df.select(*[col(c) for c in have], vector.alias(out, metadata={"ml_attr": {"num_attrs": self.size}}))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: TextEncoderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"size": self.model.size})
        self.model.table.write.parquet(f"{path}/dictionary")


class _Reader(MLReader):
    def load(self, path: str) -> TextEncoderModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = TextEncoderModel(self.sparkSession.read.parquet(f"{path}/dictionary"), meta["size"])
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
