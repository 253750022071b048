"""Derived fixtures of FIXTURES.md (B), Spark side. The DuckDB side of each is
the SQL constant next to it, used inside the oracle queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table


def part_nulls(spark, d) -> DataFrame:
    """``p_size``/``p_type`` NULL when ``p_partkey % 7 = 0``; the whole row NULL
    when ``p_partkey % 50 = 49``. All 2,000 (×sf) rows stay."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    gone = (k % 50) == 49
    holed = (k % 7) == 0
    out = []
    for c, t in p.dtypes:
        e = F.col(c)
        if c in ("p_size", "p_type"):
            e = F.when(holed, F.lit(None).cast(t)).otherwise(e)
        out.append(F.when(gone, F.lit(None).cast(t)).otherwise(e).alias(c))
    return p.select(*out)


PART_NULLS_SQL = """(SELECT
  CASE WHEN p_partkey % 50 = 49 THEN NULL ELSE p_partkey END AS p_partkey,
  CASE WHEN p_partkey % 50 = 49 THEN NULL ELSE p_name END AS p_name,
  CASE WHEN p_partkey % 50 = 49 THEN NULL ELSE p_brand END AS p_brand,
  CASE WHEN p_partkey % 50 = 49 OR p_partkey % 7 = 0 THEN NULL ELSE p_type END AS p_type,
  CASE WHEN p_partkey % 50 = 49 OR p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size,
  CASE WHEN p_partkey % 50 = 49 THEN NULL ELSE p_retailprice END AS p_retailprice
FROM part)"""


def line_charge(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.withColumn("charge", F.col("l_extendedprice") * (1 - F.col("l_discount")))


def orders_days(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.withColumn("days", F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")))


def split_key_sql(key: str) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8))::BIGINT % 10000)"
