"""Catalog: sources and sinks S1–S5, S9, S13 and the composed reports C7, I13."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import browse as B
from ..operators import evaluate as E
from ..operators import export as X
from ..operators import features as FT
from ..operators import insights as I
from ..operators import states as SK
from ..plans import ingest as IN
from ..plans import report as R
from ..session import checkpoint_dir
from ..sources import csv as CSV
from ..sources import records as REC
from ..sources import store as ST
from . import register
from ._common import r, rounded, table
from .fixtures import PART_NULLS_SQL, part_nulls
from .q_features import LINE_FIT_SQL, ORDERS_CAT_SQL, _line_fit
from .q_insights import EV_NUM
from .q_insights import _examples_sql as examples_sql
from .q_profile import categorical_sql, numeric_profile_sql, options_sql


def _scratch(spark, kind: str) -> str:
    return f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


@register("s1_csv_roundtrip", f"""
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice
FROM {PART_NULLS_SQL}""")
def s1_csv_roundtrip(spark, d):
    path = _scratch(spark, "csv")
    part_nulls(spark, d).write.option("header", True).csv(path)
    return CSV.load_csv(spark, path)


BROKEN = """CASE WHEN p_partkey % 5 = 0 THEN p_name || chr(10) || '"' || p_brand || '", ' || chr(10) || 'x' ELSE p_name END"""


@register("s1_csv_line_breaks", f"""
SELECT p_partkey, {BROKEN} AS p_name, p_brand, CAST(p_size AS BIGINT) AS p_size, p_retailprice, p_type FROM part""")
def s1_csv_line_breaks(spark, d):
    """Quotes, commas and line breaks inside quoted fields, read with the default
    options from several files, some of them without any."""
    path = _scratch(spark, "csv")
    p = table(spark, d, "part").withColumn("p_name", F.expr(BROKEN.replace("chr(10)", r"'\n'")))
    p = p.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice", "p_type")
    out = p.repartitionByRange(4, F.col("p_partkey") % 5, "p_partkey").write
    out.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return CSV.load_csv(spark, path)


# Rows of orders and events in an order that no column has: by md5 of the key.
def _shuffled_csv(spark, d, name: str, key: str):
    path = _scratch(spark, "csv")
    rows = table(spark, d, name).withColumn("_h", F.md5(F.col(key).cast("string")))
    rows.repartitionByRange(5, "_h").sortWithinPartitions("_h").drop("_h").write.option("header", True).csv(path)
    return path


def _rows_sql(name: str, key: str) -> str:
    return f"(SELECT *, row_number() OVER (ORDER BY md5(CAST({key} AS VARCHAR))) - 1 AS k FROM {name})"


@register("s1_row_order", f"SELECT o_orderkey, k AS _row FROM {_rows_sql('orders', 'o_orderkey')}")
def s1_row_order(spark, d):
    """Row numbers of several CSV files, from the scan's metadata."""
    out = CSV.load_csv(spark, _shuffled_csv(spark, d, "orders", "o_orderkey"), multi_line=False, row_order="_row")
    return out.select("o_orderkey", "_row")


@register("f1_file_order", f"""
WITH c AS ({ORDERS_CAT_SQL.replace("FROM orders", "FROM " + _rows_sql("orders", "o_orderkey")).replace(", o_orderkey", ", k")}),
f AS (SELECT "column", value, min(k) AS first FROM c GROUP BY ALL),
nd AS (SELECT "column" FROM f GROUP BY 1 HAVING count(*) < 20)
SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column" ORDER BY first, value) - 1 AS INTEGER) AS code
FROM f JOIN nd USING ("column")""")
def f1_file_order(spark, d):
    """Codes by first appearance in the files; no key is named."""
    return FT.first_appearance_codes(CSV.load_csv(spark, _shuffled_csv(spark, d, "orders", "o_orderkey"), False))


@register("b6_file_order", "SELECT * REPLACE (c_nationkey::BIGINT AS c_nationkey) FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR)) LIMIT 10")
def b6_file_order(spark, d):
    return B.preview(CSV.load_csv(spark, _shuffled_csv(spark, d, "customer", "c_custkey"), False))


@register("f6_file_order", f"""
SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY k) - 1 AS INTEGER) AS fold FROM {_rows_sql('orders', 'o_orderkey')}""")
def f6_file_order(spark, d):
    return FT.kfold(CSV.load_csv(spark, _shuffled_csv(spark, d, "orders", "o_orderkey"), False).select("o_orderkey"))


@register("i5_file_order", examples_sql(_rows_sql("events", "event_id"), "k", EV_NUM))
def i5_file_order(spark, d):
    return I.outlier_examples(CSV.load_csv(spark, _shuffled_csv(spark, d, "events", "event_id"), False))


PN_TEXT = ("(SELECT " + ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), 'NA') AS {c}"
    for c in ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])
    + f" FROM {PART_NULLS_SQL})")
INT_RE = "^[+-]?[0-9]+$"
FLOAT_RE = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|Inf|INF|infinity|Infinity)$"


def _infer_sql() -> str:
    parts = []
    for i, c in enumerate(["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]):
        v = f"CASE WHEN {c} = 'NA' THEN NULL ELSE {c} END"
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS position, "
            f"CASE WHEN count({v}) > 0 AND count_if(regexp_matches({v}, '{INT_RE}')) = count({v}) THEN 'bigint' "
            f"WHEN count_if(regexp_matches({v}, '{INT_RE}') OR regexp_matches({v}, '{FLOAT_RE}')) = count({v}) "
            f"THEN 'double' WHEN count_if({v} IN ('True','TRUE','true','False','FALSE','false')) = count({v}) "
            f"THEN 'boolean' ELSE 'string' END AS type, CAST(count_if({v} IS NULL) AS BIGINT) AS nulls FROM {PN_TEXT}")
    return "\nUNION ALL\n".join(parts)


@register("s2_infer_types", _infer_sql())
def s2_infer_types(spark, d):
    pn = part_nulls(spark, d)
    text = pn.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in pn.columns])
    return CSV.infer_types(text)


def _validate_sql(tbl: str, cols: list[str], numeric: bool = True) -> str:
    empty = " AND ".join(f"count({c}) > 0" for c in cols)
    names = ", ".join(f"CASE WHEN count({c}) = 0 THEN '{c}' END" for c in cols)
    return f"""
SELECT 0 AS position, 'exists' AS rule, true AS passed, '' AS detail
UNION ALL SELECT 1, 'not_empty', true, ''
UNION ALL SELECT 2, 'has_rows', count(*) > 0, CASE WHEN count(*) > 0 THEN '' ELSE 'No data found in the file.' END FROM {tbl}
UNION ALL SELECT 3, 'two_columns', {str(len(cols) >= 2).lower()}, ''
UNION ALL SELECT 4, 'unique_names', true, ''
UNION ALL SELECT 5, 'no_empty_columns', {empty},
  CASE WHEN {empty} THEN '' ELSE 'File contains empty columns: ' || concat_ws(', ', {names}) END FROM {tbl}
UNION ALL SELECT 6, 'numeric_column', {str(numeric).lower()}, ''"""


@register("s3_validate_ok", _validate_sql(PART_NULLS_SQL, ["p_partkey", "p_name", "p_brand", "p_type",
                                                           "p_size", "p_retailprice"]))
def s3_validate_ok(spark, d):
    return CSV.validate_frame(part_nulls(spark, d))


ORD_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
            "o_orderpriority", "o_comment"]


@register("s3_validate_empty_column", _validate_sql(
    "(SELECT *, CAST(NULL AS VARCHAR) AS o_comment FROM orders)", ORD_COLS))
def s3_validate_empty_column(spark, d):
    o = table(spark, d, "orders").withColumn("o_comment", F.lit(None).cast("string"))
    return CSV.validate_frame(o)


@register("s3_verdict", """
SELECT false AS valid, 'File contains empty columns: o_comment' AS message FROM orders LIMIT 1""")
def s3_verdict(spark, d):
    o = table(spark, d, "orders").withColumn("o_comment", F.lit(None).cast("string"))
    return CSV.verdict(CSV.validate_frame(o))


@register("s4_records", """
SELECT CAST(to_json(struct_pack(c_custkey := c_custkey, c_name := c_name, c_acctbal := c_acctbal,
                           c_mktsegment := c_mktsegment)) AS VARCHAR) AS record FROM customer""")
def s4_records(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return REC.to_records(c)


@register("s4_records_whole", """
SELECT CAST(to_json(struct_pack(c_custkey := c_custkey, c_name := c_name, c_nationkey := c_nationkey,
                           c_acctbal := c_acctbal, c_mktsegment := c_mktsegment)) AS VARCHAR) AS record FROM customer""")
def s4_records_whole(spark, d):
    return REC.to_records(table(spark, d, "customer"))


CUST_NUM = ["c_custkey", "c_nationkey", "c_acctbal"]


@register("s5_profile_cache", numeric_profile_sql("customer", CUST_NUM))
def s5_profile_cache(spark, d):
    store = _scratch(spark, "profiles")
    c = table(spark, d, "customer")
    ST.cached_profile(spark, c, store, "customer")
    again = ST.cached_profile(spark, c, store, "customer")  # served from the store
    return rounded(again["numeric"])


# The CSV of part_nulls, cleaned: all-null rows gone, medians and 'Unknown' filled in.
CLEANED_SQL = f"""(SELECT p_partkey, p_name, p_brand, COALESCE(p_type, 'Unknown') AS p_type,
  COALESCE(p_size, (SELECT median(p_size) FROM {PART_NULLS_SQL}))::DOUBLE AS p_size, p_retailprice
  FROM {PART_NULLS_SQL} WHERE p_partkey IS NOT NULL)"""
CLEANED_TEXT = ["p_name", "p_brand", "p_type"]


def _ingested(spark, d):
    path = _scratch(spark, "csv")
    (part_nulls(spark, d).withColumn("_k", F.monotonically_increasing_id()).repartitionByRange(3, "_k")
     .sortWithinPartitions("_k").drop("_k").write.option("header", True).csv(path))
    return IN.ingest(spark, path, _scratch(spark, "store"), "part")


@register("s5_ingest_table", f"SELECT * FROM {CLEANED_SQL}")
def s5_ingest_table(spark, d):
    """CSV to kept table: read, validated, typed, cleaned."""
    return _ingested(spark, d).table.drop(IN.ROW)


@register("s5_ingest_numeric", numeric_profile_sql(CLEANED_SQL, ["p_partkey", "p_size", "p_retailprice"]))
def s5_ingest_numeric(spark, d):
    return rounded(_ingested(spark, d).profile["numeric"])


@register("s5_ingest_categorical", categorical_sql(CLEANED_SQL, CLEANED_TEXT))
def s5_ingest_categorical(spark, d):
    return _ingested(spark, d).profile["categorical"]


@register("s5_ingest_options", options_sql(CLEANED_SQL, CLEANED_TEXT))
def s5_ingest_options(spark, d):
    return _ingested(spark, d).profile["options"]


@register("s5_ingest_card", f"""
SELECT count(*) AS rows, 6 AS columns, 3 AS numeric_columns, 3 AS categorical_columns FROM {CLEANED_SQL}""")
def s5_ingest_card(spark, d):
    return _ingested(spark, d).card


@register("s9_ingest_encoders", "\nUNION ALL\n".join(f"""
SELECT "column", value, CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS code
FROM (SELECT '{c}' AS "column", {c} AS value, min(p_partkey) AS k, count(*) OVER () AS nd FROM {CLEANED_SQL} GROUP BY {c})
WHERE nd < 20""" for c in CLEANED_TEXT))
def s9_ingest_encoders(spark, d):
    """Encoders by first appearance in the CSV."""
    return _ingested(spark, d).encoders


ORD_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
ORD_TEXT = ["o_orderstatus", "o_orderdate", "o_orderpriority"]


def _state_store(spark, d) -> str:
    """States of orders, a part per month of the year; one part added twice."""
    store = _scratch(spark, "states")
    o = table(spark, d, "orders")
    for m in (*range(1, 13, 3), 4):
        month = F.month("o_orderdate")
        ST.add_part(o.where((month >= m) & (month < m + 3)), store, "orders", f"months {m}-{m + 2}")
    return store


@register("s5_states_merged", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", count({c}) AS n, {r(f'min({c})')} AS min, {r(f'max({c})')} AS max,
       {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std FROM orders""" for c in ORD_NUM))
def s5_states_merged(spark, d):
    """The exact part of a profile merged from the kept states of four parts."""
    out = ST.stored_profile(spark, _state_store(spark, d), "orders").where("numeric")
    return rounded(out.select("column", "n", "min", "max", "mean", "std"))


@register("s5_states_bounds", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS exact, true AS distinct_within, true AS median_within FROM orders"""
    for c in [*ORD_NUM, *ORD_TEXT]))
def s5_states_bounds(spark, d):
    """Exact distinct counts, and whether the merged sketches keep their bounds: the
    estimate's relative error, and the rank of the estimated median."""
    o = table(spark, d, "orders")
    prof = ST.stored_profile(spark, _state_store(spark, d), "orders")
    est = {x["column"]: x for x in prof.collect()}
    cells = []
    for c in [*ORD_NUM, *ORD_TEXT]:
        m = est[c]["median"]
        place = F.struct(*[(F.count_if(F.col(c).cast("double") < m) / F.count(c) <= 0.5 + SK.RANK_ERROR).alias("a"),
                           (F.count_if(F.col(c).cast("double") <= m) / F.count(c) >= 0.5 - SK.RANK_ERROR).alias("b")]) if m is not None else None
        cells.append(F.struct(F.lit(c).alias("column"), F.count_distinct(c).alias("exact"),
                              (F.abs(F.count_distinct(c) - F.lit(est[c]["unique_values"])) <= F.count_distinct(c) * SK.DISTINCT_ERROR).alias("distinct_within"),
                              (place["a"] & place["b"] if place is not None else F.lit(True)).alias("median_within")))
    return o.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@register("s9_encoders", f"""
WITH f AS (SELECT "column", value, min(k) AS first FROM ({ORDERS_CAT_SQL}) GROUP BY ALL),
nd AS (SELECT "column" FROM f GROUP BY 1 HAVING count(*) < 20)
SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column" ORDER BY first, value) - 1 AS INTEGER) AS code
FROM f JOIN nd USING ("column")""")
def s9_encoders(spark, d):
    store = _scratch(spark, "encoders")
    ST.save_encoders(FT.first_appearance_codes(table(spark, d, "orders"), "o_orderkey"), store, "orders")
    return ST.load_encoders(spark, store, "orders")


@register("s13_export", f"""
WITH m AS (SELECT 1 - sum(power(l_extendedprice - pred, 2)) / (var_pop(l_extendedprice) * count(*)) AS r2_score,
                  avg(abs(l_extendedprice - pred)) AS mean_absolute_error,
                  avg(power(l_extendedprice - pred, 2)) AS mean_squared_error,
                  sqrt(avg(power(l_extendedprice - pred, 2))) AS root_mean_squared_error FROM {LINE_FIT_SQL})
SELECT 'model' AS section, 0 AS position, 'Model Type' AS name, 'LinearRegression' AS value
UNION ALL SELECT 'model', 1, 'Target Column', 'l_extendedprice'
UNION ALL SELECT 'metric', 0, 'R2 Score', printf('%.4f', r2_score) FROM m
UNION ALL SELECT 'metric', 0, 'Mean Absolute Error', printf('%.4f', mean_absolute_error) FROM m
UNION ALL SELECT 'metric', 0, 'Mean Squared Error', printf('%.4f', mean_squared_error) FROM m
UNION ALL SELECT 'metric', 0, 'Root Mean Squared Error', printf('%.4f', root_mean_squared_error) FROM m""")
def s13_export(spark, d):
    m = E.regression_metrics(_line_fit(spark, d), "l_extendedprice", "pred")
    long = m.select(F.expr("stack(4, 'r2_score', r2_score, 'mean_absolute_error', mean_absolute_error, "
                           "'mean_squared_error', mean_squared_error, "
                           "'root_mean_squared_error', root_mean_squared_error) as (metric, value)"))
    return X.export_rows(long, "LinearRegression", "l_extendedprice")


@register("c7_filter_profile", numeric_profile_sql(
    "(SELECT * FROM customer WHERE lower(CAST(c_mktsegment AS VARCHAR)) = 'building')", CUST_NUM))
def c7_filter_profile(spark, d):
    out = R.filter_profile(table(spark, d, "customer"), {"c_mktsegment": "Building"})
    return rounded(out["numeric"])


BUILDING = "(SELECT * FROM customer WHERE lower(CAST(c_mktsegment AS VARCHAR)) = 'building')"


def _building(spark, d):
    return R.filter_profile(table(spark, d, "customer"), {"c_mktsegment": "Building"})


@register("c7_card", f"""
SELECT count(*) AS rows, 5 AS columns, 3 AS numeric_columns, 2 AS categorical_columns FROM {BUILDING}""")
def c7_card(spark, d):
    return _building(spark, d)["card"]


@register("c7_categorical", categorical_sql(BUILDING, ["c_name", "c_mktsegment"]))
def c7_categorical(spark, d):
    return _building(spark, d)["categorical"]


@register("c7_options", options_sql(BUILDING, ["c_name", "c_mktsegment"]))
def c7_options(spark, d):
    return _building(spark, d)["options"]


@register("i13_insight_report")
def i13_insight_report(spark, d):
    o = table(spark, d, "orders").withColumn(
        "days", F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")))
    return R.insight_report(o, "o_orderkey",
                            {"o_orderstatus": ["F", "O"]}, "distribution vs priority")
