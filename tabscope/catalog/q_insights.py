"""Catalog: insights I1–I11, overview C10 and headline C11."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import sql_pearson, sql_t_two_sided_p
from ..operators import insights as I
from . import register
from ._common import r, rounded, table
from .fixtures import line_charge, orders_days

LC_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
          "l_extendedprice", "l_discount", "l_tax", "charge"]
LC_SQL = "(SELECT *, l_extendedprice * (1 - l_discount) AS charge FROM lineitem)"
EV_NUM = ["event_id", "user_id", "value"]
ORDERS_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


def _corr_sql(tbl: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            b = cols[j]
            parts.append(f"SELECT {i} AS i, {j} AS j, '{a}' AS col1, '{b}' AS col2, "
                         f"{sql_pearson(a, b)} AS r FROM {tbl}")
    return "\nUNION ALL\n".join(parts)


CORR_SQL = f"WITH c AS ({_corr_sql(LC_SQL, LC_NUM)})"


@register("i1_correlation", f"{CORR_SQL} SELECT i, j, col1, col2, {r('r')} AS r, {r('abs(r)')} AS abs_r FROM c")
def i1_correlation(spark, d):
    return rounded(I.correlations(line_charge(spark, d)))


@register("i2_strong_pairs", f"""{CORR_SQL}
SELECT col1, col2, round(abs(r), 2) AS correlation FROM c WHERE abs(r) > 0.7 ORDER BY i, j LIMIT 5""")
def i2_strong_pairs(spark, d):
    return I.strong_pairs(I.correlations(line_charge(spark, d)))


@register("i3_weak_pairs", f"""{CORR_SQL}
SELECT col1, col2, round(abs(r), 2) AS correlation FROM c WHERE abs(r) > 0 AND abs(r) < 0.3
ORDER BY i, j LIMIT 5""")
def i3_weak_pairs(spark, d):
    return I.weak_pairs(I.correlations(line_charge(spark, d)))


@register("i1_correlation_part", f"""WITH c AS ({_corr_sql("part", ["p_partkey", "p_size", "p_retailprice"])})
SELECT i, j, col1, col2, {r('r')} AS r, {r('abs(r)')} AS abs_r FROM c""")
def i1_correlation_part(spark, d):
    return rounded(I.correlations(table(spark, d, "part")))


def _outlier_sql(tbl: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS position, count(*) AS count, "
            f"round(count(*) * 100.0 / (SELECT count(*) FROM {tbl}), 2) AS percent "
            f"FROM {tbl}, (SELECT avg({c}) AS mu, stddev_pop({c}) AS sp, stddev_samp({c}) AS ss "
            f"FROM {tbl}) s WHERE s.ss <> 0 AND abs(({c} - s.mu) / s.sp) > 3 HAVING count(*) > 0")
    return "\nUNION ALL\n".join(parts)


@register("i4_outliers", _outlier_sql("events", EV_NUM))
def i4_outliers(spark, d):
    return I.outliers(table(spark, d, "events"))


@register("i4_outliers_documents", _outlier_sql("documents", ["doc_id", "n_chars"]))
def i4_outliers_documents(spark, d):
    return I.outliers(table(spark, d, "documents"))


def _examples_sql(tbl: str, key: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS \"column\", {key} AS k, {c} AS value "
            f"FROM {tbl}, (SELECT avg({c}) AS mu, stddev_pop({c}) AS sp, stddev_samp({c}) AS ss "
            f"FROM {tbl}) s WHERE s.ss <> 0 AND abs(({c} - s.mu) / s.sp) > 3")
    u = "\nUNION ALL\n".join(parts)
    return (f"SELECT \"column\", rank, value FROM (SELECT \"column\", CAST(row_number() OVER "
            f"(PARTITION BY \"column\" ORDER BY k) AS INTEGER) AS rank, round(value, 2) AS value FROM ({u})) "
            f"WHERE rank <= 5")


@register("i5_outlier_examples", _examples_sql("events", "event_id", EV_NUM))
def i5_outlier_examples(spark, d):
    return I.outlier_examples(table(spark, d, "events"), "event_id")


def _i6_frame(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_orderdate",
                    F.col("o_orderdate").cast("string").alias("order_date_text"),
                    F.col("o_orderpriority").alias("priority_day"),
                    F.year("o_orderdate").alias("order_year"), "o_totalprice")


@register("i6_date_formats", """
SELECT * FROM (VALUES ('us_date', 0), ('day_first_date', 1), ('long_date', 2)) t("column", position)
WHERE (SELECT count_if(try_strptime(strftime(o_orderdate, '%-m/%-d/%Y'), '%m/%d/%Y') IS NULL
                       AND o_orderdate IS NOT NULL) FROM orders) = 0""")
def i6_date_formats(spark, d):
    """Order dates written in other ways, and one text that is no date."""
    day = F.col("o_orderdate")
    return I.date_columns_frame(table(spark, d, "orders").select(
        F.date_format(day, "M/d/yyyy").alias("us_date"), F.date_format(day, "d.M.yyyy").alias("day_first_date"),
        F.date_format(day, "MMM d, yyyy").alias("long_date"), F.col("o_orderpriority").alias("other_date")))


@register("i6_date_columns", """
SELECT "column", position FROM (
  SELECT 'o_orderdate' AS "column", 1 AS position,
         count_if(try_cast(o_orderdate AS TIMESTAMP) IS NULL AND o_orderdate IS NOT NULL) AS bad FROM orders
  UNION ALL
  SELECT 'order_date_text', 2, count_if(try_cast(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) IS NULL) FROM orders
  UNION ALL
  SELECT 'priority_day', 3, count_if(try_cast(o_orderpriority AS TIMESTAMP) IS NULL) FROM orders
  UNION ALL
  SELECT 'order_year', 4, count_if(NOT (year(o_orderdate) BETWEEN 1000 AND 9999)) FROM orders)
WHERE bad = 0
""")
def i6_date_columns(spark, d):
    return I.date_columns_frame(_i6_frame(spark, d))


def _monthly_sql(tbl: str, dcol: str, cols: list[str], month_expr: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{dcol}' AS date_column, '{c}' AS \"column\", {month_expr} AS month, avg({c}) AS mean "
        f"FROM {tbl} WHERE {dcol} IS NOT NULL GROUP BY 3" for c in cols)


@register("i7_monthly_mean", f"""
SELECT date_column, "column", strftime(month, '%Y-%m') AS month, {r('mean')} AS mean FROM (
{_monthly_sql("orders", "o_orderdate", ORDERS_NUM,
              "CAST(date_trunc('month', o_orderdate) AS DATE)")})
""")
def i7_monthly_mean(spark, d):
    m = I.monthly_means(table(spark, d, "orders"))
    return rounded(m.withColumn("month", F.date_format("month", "yyyy-MM")))


def _trend_sql(monthly: str) -> str:
    return f"""
WITH m AS ({monthly}),
x AS (SELECT *, CAST(row_number() OVER (PARTITION BY date_column, "column" ORDER BY month) - 1 AS DOUBLE) AS x FROM m),
g AS (SELECT date_column, "column", count(*) AS months, regr_slope(mean, x) AS slope,
             {sql_pearson('x', 'mean')} AS r FROM x GROUP BY date_column, "column" HAVING count(*) >= 3)
SELECT *, {sql_t_two_sided_p('r', 'months - 2')} AS p_value FROM g"""


I8_SQL = _trend_sql(_monthly_sql("orders", "o_orderdate", ORDERS_NUM,
                                 "CAST(date_trunc('month', o_orderdate) AS DATE)"))


@register("i8_month_trend", f"""
SELECT date_column, "column", months, {r('slope')} AS slope, {r('r')} AS r, {r('p_value')} AS p_value
FROM ({I8_SQL})""")
def i8_month_trend(spark, d):
    return rounded(I.month_trends(I.monthly_means(table(spark, d, "orders"))))


OD_SQL = "(SELECT o_orderdate, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, o_totalprice FROM orders)"
I9_SQL = _trend_sql(_monthly_sql(OD_SQL, "o_orderdate", ["days", "o_totalprice"],
                                 "CAST(date_trunc('month', o_orderdate) AS DATE)"))


@register("i9_significant_trends", f"""
SELECT "column" || '_over_' || date_column AS trend,
       CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
       round(r, 2) AS strength, round(slope, 2) AS slope, round(p_value, 3) AS significance
FROM ({I9_SQL}) WHERE p_value < 0.05""")
def i9_significant_trends(spark, d):
    o = orders_days(spark, d).select("o_orderdate", "days", "o_totalprice")
    return I.significant_trends(I.month_trends(I.monthly_means(o)))


def _dist_sql(tbl: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        sk = (f"CASE WHEN count({c}) > 2 THEN sqrt(count({c}) * (count({c}) - 1.0)) / (count({c}) - 2.0) "
              f"* (avg(power({c} - m.mu, 3)) / power(avg(power({c} - m.mu, 2)), 1.5)) END")
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS position, {r(f'avg({c})')} AS mean, "
            f"{r(f'median({c})')} AS median, "
            f"(SELECT CAST({c} AS DOUBLE) FROM {tbl} WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1) AS mode, {r(sk)} AS skewness "
            f"FROM {tbl}, (SELECT avg({c}) AS mu FROM {tbl}) m")
    u = "\nUNION ALL\n".join(parts)
    return f"""SELECT *, CASE WHEN skewness < -1 THEN 'negatively skewed (left-tailed)'
  WHEN skewness < -0.5 THEN 'slightly negatively skewed'
  WHEN skewness > 1 THEN 'positively skewed (right-tailed)'
  WHEN skewness > 0.5 THEN 'slightly positively skewed' ELSE 'normally distributed' END AS shape
FROM ({u})"""


@register("i10_distribution", _dist_sql("events", ["value", "user_id"]).replace(
    "FROM events", "FROM (SELECT value, user_id FROM events)"))
def i10_distribution(spark, d):
    return rounded(I.distribution(table(spark, d, "events").select("value", "user_id")))


@register("i11_group_compare", """
WITH g AS (SELECT CAST(c_mktsegment AS VARCHAR) AS category, count(*) AS count,
                  round(avg(c_acctbal), 2) AS mean
           FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count DESC, category LIMIT 3),
q AS (SELECT *, row_number() OVER (ORDER BY count DESC, category) AS _r FROM g)
SELECT category, count, mean,
       category = (SELECT category FROM q ORDER BY mean DESC, _r LIMIT 1) AS is_highest,
       category = (SELECT category FROM q ORDER BY mean, _r LIMIT 1) AS is_lowest
FROM q""")
def i11_group_compare(spark, d):
    return I.group_compare(table(spark, d, "customer").select("c_mktsegment", "c_acctbal"))


@register("i10_distribution_whole", _dist_sql("events", ["event_id", "user_id"]))
def i10_distribution_whole(spark, d):
    """The first two numeric columns, chosen by the operator."""
    return rounded(I.distribution(table(spark, d, "events")))


@register("i11_group_compare_whole", """
WITH g AS (SELECT CAST(c_name AS VARCHAR) AS category, count(*) AS count, round(avg(c_custkey), 2) AS mean
           FROM customer WHERE c_name IS NOT NULL GROUP BY 1 ORDER BY count DESC, category LIMIT 3),
q AS (SELECT *, row_number() OVER (ORDER BY count DESC, category) AS _r FROM g)
SELECT category, count, mean,
       category = (SELECT category FROM q ORDER BY mean DESC, _r LIMIT 1) AS is_highest,
       category = (SELECT category FROM q ORDER BY mean, _r LIMIT 1) AS is_lowest
FROM q""")
def i11_group_compare_whole(spark, d):
    """The first categorical and numeric column, chosen by the operator."""
    return I.group_compare(table(spark, d, "customer"))


LI5 = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]


@register("c10_overview_numeric", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {i} AS position, round(avg({c}), 2) AS mean, "
    f"round(median({c}), 2) AS median, round(min({c})::DOUBLE, 2) AS min, "
    f"round(max({c})::DOUBLE, 2) AS max FROM lineitem" for i, c in enumerate(LI5)))
def c10_overview_numeric(spark, d):
    return I.overview_numeric(table(spark, d, "lineitem"))


@register("c10_overview_top_values", """
WITH v AS (
  SELECT 'o_orderstatus' AS "column", 0 AS position, CAST(o_orderstatus AS VARCHAR) AS value FROM orders
  UNION ALL SELECT 'o_orderdate', 1, CAST(o_orderdate AS VARCHAR) FROM orders
  UNION ALL SELECT 'o_orderpriority', 2, CAST(o_orderpriority AS VARCHAR) FROM orders),
h AS (SELECT "column", position, value, count(*) AS count FROM v GROUP BY ALL),
nd AS (SELECT "column", count(*) AS unique_values FROM h GROUP BY 1)
SELECT "column", position, unique_values, rank, value, count FROM (
  SELECT h.*, nd.unique_values, CAST(row_number() OVER (PARTITION BY "column"
         ORDER BY count DESC, value) AS INTEGER) AS rank
  FROM h JOIN nd USING ("column") WHERE value IS NOT NULL) WHERE rank <= 3""")
def c10_overview_top_values(spark, d):
    return I.overview_top_values(table(spark, d, "orders"))


@register("c11_headline", """
WITH vc AS (
  SELECT 'c_name' AS subject, c_name AS value, count(*) AS cnt FROM customer WHERE c_name IS NOT NULL GROUP BY 2
  UNION ALL
  SELECT 'c_mktsegment', c_mktsegment, count(*) FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 2),
top AS (SELECT subject, value, cnt, sum(cnt) OVER (PARTITION BY subject) AS t,
               row_number() OVER (PARTITION BY subject ORDER BY cnt DESC, value) AS rn FROM vc)
SELECT 'table' AS subject, 'row_count' AS metric, CAST(count(*) AS DOUBLE) AS value_num,
       NULL::VARCHAR AS value_str FROM customer
UNION ALL SELECT 'table', 'column_count', 5.0, NULL
UNION ALL SELECT 'table', 'main_columns', NULL, 'c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment'
UNION ALL SELECT 'c_custkey', 'mean', round(avg(c_custkey), 2), NULL FROM customer
UNION ALL SELECT 'c_custkey', 'min', round(min(c_custkey)::DOUBLE, 2), NULL FROM customer
UNION ALL SELECT 'c_custkey', 'max', round(max(c_custkey)::DOUBLE, 2), NULL FROM customer
UNION ALL SELECT 'c_nationkey', 'mean', round(avg(c_nationkey), 2), NULL FROM customer
UNION ALL SELECT 'c_nationkey', 'min', round(min(c_nationkey)::DOUBLE, 2), NULL FROM customer
UNION ALL SELECT 'c_nationkey', 'max', round(max(c_nationkey)::DOUBLE, 2), NULL FROM customer
UNION ALL SELECT subject, 'top_value', NULL, value FROM top WHERE rn = 1
UNION ALL SELECT subject, 'top_percent', round(cnt * 100.0 / t, 1), NULL FROM top WHERE rn = 1""")
def c11_headline(spark, d):
    return I.headline(table(spark, d, "customer"))
