"""Catalog: profiling aggregations C1–C9."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from . import register
from ._common import r, rounded, table

LINE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax"]
ORDERS_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDERS_CAT = ["o_orderstatus", "o_orderdate", "o_orderpriority"]


def numeric_profile_sql(tbl: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS position, count({c}) AS n, "
            f"{r(f'min({c})')} AS min, {r(f'max({c})')} AS max, {r(f'avg({c})')} AS mean, "
            f"{r(f'median({c})')} AS median, {r(f'stddev_samp({c})')} AS std, "
            f"count(DISTINCT {c}) AS unique_values FROM {tbl}")
    return "\nUNION ALL\n".join(parts)


def value_counts_sql(tbl: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count "
        f"FROM {tbl} WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols)


def categorical_sql(tbl: str, cols: list[str]) -> str:
    places = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(cols))
    return f"""WITH vc AS ({value_counts_sql(tbl, cols)})
SELECT "column", CAST(CASE "column" {places} END AS INTEGER) AS position,
       count(*) OVER (PARTITION BY "column") AS unique_values, value, count FROM vc"""


def options_sql(tbl: str, cols: list[str]) -> str:
    return f"""WITH vc AS ({value_counts_sql(tbl, cols)})
SELECT "column", list_sort(list(value)) AS options FROM vc GROUP BY "column" HAVING count(*) < 20"""


@register("c1_numeric_profile", numeric_profile_sql("lineitem", LINE_NUM))
def c1_numeric_profile(spark, d):
    return rounded(P.numeric_profile(table(spark, d, "lineitem")))


HASHED = "('0x' || substr(md5(o_orderkey::VARCHAR), 1, 15))::BIGINT"


@register("c1_wide_integers", f"""
WITH t AS (SELECT {HASHED} + o_orderkey % 3 AS h FROM orders)
SELECT 'h' AS "column", 0 AS position, count(h) AS n, {r('min(h)')} AS min, {r('max(h)')} AS max,
       {r('avg(h::DOUBLE)')} AS mean, {r('median(h::DOUBLE)')} AS median, {r('stddev_samp(h::DOUBLE)')} AS std,
       count(DISTINCT h) AS unique_values FROM t""")
def c1_wide_integers(spark, d):
    """Profile of a derived 60-bit column: neighbours there are one double."""
    key = F.col("o_orderkey")
    h = F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("bigint") + key % 3
    return rounded(P.numeric_profile(table(spark, d, "orders").select(h.alias("h"))))


@register("c2_value_counts", value_counts_sql("customer", ["c_name", "c_mktsegment"]))
def c2_value_counts(spark, d):
    return P.value_counts(table(spark, d, "customer"))


@register("c2_categorical_profile", f"""
WITH vc AS ({value_counts_sql("orders", ORDERS_CAT)}),
nd AS (SELECT "column", count(*) AS unique_values FROM vc GROUP BY "column")
SELECT vc."column", CAST(CASE vc."column" WHEN 'o_orderstatus' THEN 0
       WHEN 'o_orderdate' THEN 1 ELSE 2 END AS INTEGER) AS position,
       nd.unique_values, vc.value, vc.count
FROM vc JOIN nd USING ("column")
""")
def c2_categorical_profile(spark, d):
    return P.categorical_profile(table(spark, d, "orders"))


@register("c3_filter_options", f"""
WITH vc AS ({value_counts_sql("orders", ORDERS_CAT)})
SELECT "column", CAST(to_json(list_sort(list(value))) AS VARCHAR) AS options
FROM vc GROUP BY "column" HAVING count(*) < 20
""")
def c3_filter_options(spark, d):
    fo = P.filter_options(table(spark, d, "orders"))
    return fo.select("column", F.to_json("options").alias("options"))


@register("c4_table_card", """
SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns, CAST(8 AS BIGINT) AS numeric_columns,
       CAST(3 AS BIGINT) AS categorical_columns FROM lineitem
""")
def c4_table_card(spark, d):
    return P.table_card(table(spark, d, "lineitem"))


@register("c5_chart_series", f"""
WITH p AS ({numeric_profile_sql("orders", ORDERS_NUM)})
SELECT "column", position, stat, value FROM (
  SELECT "column", position, 'Min' AS stat, min AS value FROM p UNION ALL
  SELECT "column", position, 'Mean', mean FROM p UNION ALL
  SELECT "column", position, 'Median', median FROM p UNION ALL
  SELECT "column", position, 'Max', max FROM p)
""")
def c5_chart_series(spark, d):
    prof = rounded(P.numeric_profile(table(spark, d, "orders")))
    return P.chart_series(prof)


@register("c6_category_share", f"""
WITH vc AS ({value_counts_sql("customer", ["c_name", "c_mktsegment"])})
SELECT "column", value, count,
       round(count * 100.0 / sum(count) OVER (PARTITION BY "column"), 1) AS share
FROM vc
""")
def c6_category_share(spark, d):
    return P.category_share(table(spark, d, "customer"))


@register("c8_multi_select_counts", """
SELECT option, count(*) AS count FROM (
  SELECT trim(unnest(regexp_split_to_array(p_name, '\\s+'))) AS option FROM part)
WHERE option <> '' GROUP BY option
""")
def c8_multi_select_counts(spark, d):
    return P.multi_select_counts(table(spark, d, "part"), "p_name", sep=r"\s+")


@register("c9_url_host_share", """
WITH h AS (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS domain
           FROM pages),
c AS (SELECT domain, count(*) AS count FROM h WHERE domain <> '' GROUP BY domain)
SELECT domain, count, round(count * 100.0 / sum(count) OVER (), 1) AS share FROM c
""")
def c9_url_host_share(spark, d):
    return P.domain_share(table(spark, d, "pages"), "url", kind="url", providers=None)


@register("c9_email_domain_share", """
WITH h AS (SELECT lower(regexp_extract(text, '@([A-Za-z0-9.-]+)', 1)) AS host FROM documents),
c AS (SELECT CASE split_part(host, '.', 1) WHEN 'gmail' THEN 'Gmail' WHEN 'outlook' THEN 'Outlook'
                  WHEN 'yahoo' THEN 'Yahoo' ELSE 'Other' END AS domain, count(*) AS count
      FROM h WHERE host <> '' GROUP BY 1)
SELECT domain, count, round(count * 100.0 / sum(count) OVER (), 1) AS share FROM c
""")
def c9_email_domain_share(spark, d):
    return P.domain_share(table(spark, d, "documents"), "text", kind="email")
