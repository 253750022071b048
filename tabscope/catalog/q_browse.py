"""Catalog: cleaning B1–B3, filters and browsing B4–B9, recent top-k S8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import browse as B
from ..operators import clean as C
from . import register
from ._common import rounded, table
from .fixtures import PART_NULLS_SQL, part_nulls

PN_B1 = f"(SELECT * FROM {PART_NULLS_SQL} WHERE NOT (p_partkey IS NULL AND p_name IS NULL AND " \
        "p_brand IS NULL AND p_type IS NULL AND p_size IS NULL AND p_retailprice IS NULL))"


@register("b1_drop_all_null", f"SELECT * FROM {PN_B1}")
def b1_drop_all_null(spark, d):
    return C.drop_all_null(part_nulls(spark, d))


@register("b2_median_fill", f"""
WITH t AS {PN_B1}
SELECT p_partkey, p_name, p_brand, p_type,
       coalesce(CAST(p_size AS DOUBLE), (SELECT median(p_size) FROM t)) AS p_size,
       p_retailprice
FROM t
""")
def b2_median_fill(spark, d):
    return rounded(C.median_fill(C.drop_all_null(part_nulls(spark, d))))


@register("b3_unknown_fill", f"""
SELECT p_partkey, coalesce(p_name, 'Unknown') AS p_name, coalesce(p_brand, 'Unknown') AS p_brand,
       coalesce(p_type, 'Unknown') AS p_type, p_size, p_retailprice
FROM {PART_NULLS_SQL}
""")
def b3_unknown_fill(spark, d):
    return C.unknown_fill(part_nulls(spark, d))


@register("b123_clean", f"""
WITH t AS {PN_B1}
SELECT p_partkey, coalesce(p_name, 'Unknown') AS p_name, coalesce(p_brand, 'Unknown') AS p_brand,
       coalesce(p_type, 'Unknown') AS p_type,
       coalesce(CAST(p_size AS DOUBLE), (SELECT median(p_size) FROM t)) AS p_size, p_retailprice
FROM t
""")
def b123_clean(spark, d):
    return rounded(C.clean(part_nulls(spark, d)))


@register("b4_eq_filter", """
SELECT * FROM customer
WHERE lower(CAST(c_mktsegment AS VARCHAR)) = 'building'
  AND (lower(CAST(c_nationkey AS VARCHAR)) = '5' OR CAST(c_nationkey AS DOUBLE) = 5.0)
""")
def b4_eq_filter(spark, d):
    return B.eq_filter(table(spark, d, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": "5"})


@register("b5_isin_filter", """
SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')
""")
def b5_isin_filter(spark, d):
    return B.isin_filter(table(spark, d, "orders"),
                         {"o_orderstatus": ["F", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH"],
                          "no_such_column": ["x"]})


@register("b6_preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 10")
def b6_preview(spark, d):
    return B.preview(table(spark, d, "customer"), ["c_custkey"])


@register("b7_search_page", """
SELECT * FROM orders WHERE contains(lower(o_orderpriority), 'urgent')
ORDER BY o_orderkey LIMIT 10 OFFSET 20
""")
def b7_search_page(spark, d):
    return B.search_page(table(spark, d, "orders"), "  URGENT ", ["o_orderkey"], page=2,
                         column="o_orderpriority")


@register("b7_search_summary", """
SELECT count(*) AS matches, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM customer
WHERE contains(lower(CAST(c_custkey AS VARCHAR)), 'customer#00000012')
   OR contains(lower(c_name), 'customer#00000012')
   OR contains(lower(CAST(c_nationkey AS VARCHAR)), 'customer#00000012')
   OR contains(lower(CAST(c_acctbal AS VARCHAR)), 'customer#00000012')
   OR contains(lower(c_mktsegment), 'customer#00000012')
""")
def b7_search_summary(spark, d):
    return B.search_summary(table(spark, d, "customer"), "Customer#00000012")


@register("b7_search_numbers", "\nUNION ALL\n".join(f"""
SELECT '{t}' AS term, count(*) AS matches, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM customer
WHERE contains(CAST(c_custkey AS VARCHAR), '{t}') OR contains(lower(c_name), '{t}') OR contains(CAST(c_nationkey AS VARCHAR), '{t}')
   OR contains(CAST(c_acctbal AS VARCHAR), '{t}') OR contains(lower(c_mktsegment), '{t}')""" for t in ("-12", "99.5", "build")))
def b7_search_numbers(spark, d):
    """Any-column search for parts of numbers."""
    c = table(spark, d, "customer")
    parts = [B.search_summary(c, t).withColumn("term", F.lit(t)) for t in ("-12", "99.5", "build")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("b8_scatter_sample", """
SELECT o_totalprice, o_custkey, o_orderstatus FROM orders
WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL
ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 50
""")
def b8_scatter_sample(spark, d):
    return B.scatter_sample(table(spark, d, "orders"), "o_totalprice", "o_custkey", "o_orderkey",
                            category="o_orderstatus")


@register("b9_choose_columns", "SELECT * EXCLUDE (l_returnflag, l_tax) FROM lineitem")
def b9_choose_columns(spark, d):
    return B.choose_columns(table(spark, d, "lineitem"), "l_returnflag", ["l_tax", "l_comment"])


@register("s8_recent_top5", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def s8_recent_top5(spark, d):
    return B.recent_top(table(spark, d, "orders"), "o_orderdate", "o_orderkey", 5)


@register("s8_recent_per_group", """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey
                 ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS rank FROM orders)
WHERE rank <= 2
""")
def s8_recent_per_group(spark, d):
    return B.recent_top(table(spark, d, "orders"), "o_orderdate", "o_orderkey", 2, group="o_custkey")
