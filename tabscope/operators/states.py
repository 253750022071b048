"""Mergeable profile states: a profile that new files add to.

A state is one row per column and part (a file, a day): counts, bounds, mean and sum
of squared deviations, a distinct-count sketch (HLL) and, for numeric columns, a
quantile sketch (KLL), all from one scan. States of parts merge into the state of the
whole in any order and grouping, so a dataset's profile follows from the states kept
beside it, and a new part is the only thing ever scanned.

Counts, bounds, mean and deviation are exact (to rounding). ``unique_values`` is off
by at most ``DISTINCT_ERROR`` and ``median`` lies at most ``RANK_ERROR`` of all values
away from the middle, both with a chance far above 99 %. Profiles without error come
from :func:`tabscope.operators.profile.numeric_profile`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import PROFILE, classify
from ._long import clean_number, text_form

#: Sketch sizes: 2**14 HLL registers, 2,048 KLL items a level.
LOG_REGISTERS = 14
ITEMS = 2048
#: Relative error of distinct counts (four standard errors), rank error of quantiles.
DISTINCT_ERROR = 0.035
RANK_ERROR = 0.005

STATE = ("column string, position int, numeric boolean, rows long, n long, low double, high double, "
         "mean double, m2 double, distinct binary, quantiles binary")


def _parts(i: int, name: str, numeric: bool, value: Column) -> Column:
    """The state of one column as a struct of aggregates."""
    x = value + F.lit(0.0) if numeric else value  # -0.0 counts as 0.0
    n = F.count(value)
    none = F.lit(None)
    return F.struct(
        F.lit(name).alias("column"), F.lit(i).alias("position"), F.lit(numeric).alias("numeric"),
        F.count(F.lit(1)).alias("rows"), n.alias("n"),
        (F.min(x) if numeric else none.cast("double")).alias("low"),
        (F.max(x) if numeric else none.cast("double")).alias("high"),
        (F.avg(x) if numeric else none.cast("double")).alias("mean"),
        (F.var_pop(x) * n if numeric else none.cast("double")).alias("m2"),
        F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(x)), F.lit(LOG_REGISTERS)).alias("distinct"),
        (F.kll_sketch_agg_double(x, F.lit(ITEMS)) if numeric else none.cast("binary")).alias("quantiles"))


def column_states(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row of ``STATE`` per numeric and categorical column (of ``columns``), by
    one aggregate over one scan. An empty table has states with ``rows`` 0."""
    cls = classify(df, PROFILE)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = [c for c in df.columns if c in cls.numeric or c in cls.categorical]
    names = [c for c in names if columns is None or c in columns]
    if not names:
        return df.sparkSession.createDataFrame([], STATE)
    structs = [_parts(i, c, c in cls.numeric, clean_number(c, kinds[c]) if c in cls.numeric else text_form(c, kinds[c]))
               for i, c in enumerate(names)]
    wide = df.agg(*[s.alias(f"s{i}") for i, s in enumerate(structs)])
    return wide.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(structs))])).alias("s")).select("s.*")


def _fold(states: DataFrame, keys: list[str]) -> DataFrame:
    """Merge the states of each group of ``keys``."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a: Column, b: Column) -> Column:  # pairwise, so that large means cost no digits
        n = a["n"] + b["n"]
        d = b["mean"] - a["mean"]
        share = b["n"] / n
        return F.struct(n.alias("n"), (a["mean"] + d * share).alias("mean"),
                        (a["m2"] + b["m2"] + d * d * a["n"] * share).alias("m2"))
    parts = F.filter("parts", lambda p: p["n"] > 0)
    moments = F.aggregate(F.transform(parts, lambda p: F.struct(
        p["n"].alias("n"), F.coalesce(p["mean"], F.lit(0.0)).alias("mean"), F.coalesce(p["m2"], F.lit(0.0)).alias("m2"))), zero, add)
    sketches = F.transform(F.filter(parts, lambda p: p["quantiles"].isNotNull()), lambda p: p["quantiles"])
    # NULL if no part has values: then there is no sketch to merge.
    merged = F.when(F.size(sketches) > 0, F.aggregate(F.slice(sketches, 2, F.greatest(F.size(sketches) - 1, F.lit(0))),
                                                      F.get(sketches, F.lit(0)), F.kll_sketch_merge_double))
    out = states.groupBy(*keys).agg(
        F.min("position").alias("position"), F.bool_and("numeric").alias("numeric"), F.sum("rows").alias("rows"), F.sum("n").alias("n"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.hll_union_agg("distinct").alias("distinct"),
        F.collect_list(F.struct("n", "mean", "m2", "quantiles")).alias("parts"))
    some = F.col("numeric") & (F.col("n") > 0)
    return (out.withColumn("m", moments).withColumn("quantiles", merged)
            .withColumn("mean", F.when(some, F.col("m.mean"))).withColumn("m2", F.when(some, F.col("m.m2"))).drop("m", "parts"))


def merge_states(states: DataFrame, spread: str | None = None) -> DataFrame:
    """One row of ``STATE`` per column from the rows of all parts.

    Few parts merge in one group per column. ``spread`` names a column that tells the
    parts apart: then 64 groups per column merge first, so that no task holds the
    sketches of all of them."""
    names = [f.split()[0] for f in STATE.split(", ")]
    if spread is not None:
        states = _fold(states.withColumn("_lot", F.pmod(F.xxhash64(spread), F.lit(64))), ["column", "_lot"])
    return _fold(states, ["column"]).select(*names)


def profile_of(states: DataFrame) -> DataFrame:
    """C1 and the counts of C2 from merged states: ``(column, position, numeric, n,
    min, max, mean, median, std, unique_values)``; ``median`` and ``unique_values``
    within the bounds above, the others exact."""
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return states.select(
        "column", "position", "numeric", "n", F.col("low").alias("min"), F.col("high").alias("max"), "mean",
        quantile("quantiles", 0.5).alias("median"), std.alias("std"),
        F.hll_sketch_estimate("distinct").alias("unique_values"))


def quantile(sketch: str, q: float) -> Column:
    """A value near rank ``q`` of a state's sketch; NULL if it has no values."""
    c = F.col(sketch)
    return F.when(c.isNotNull() & (F.kll_sketch_get_n_double(c) > 0), F.kll_sketch_get_quantile_double(c, F.lit(q)))
