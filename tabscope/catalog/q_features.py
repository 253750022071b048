"""Catalog: feature preparation F1–F6 and evaluation E1, E2, E6–E10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encoding as EN
from ..operators import evaluate as E
from ..operators import features as FT
from . import register
from ._common import r, rounded, table
from .fixtures import split_key_sql

ORDERS_CAT_SQL = """
SELECT 'o_orderstatus' AS "column", CAST(o_orderstatus AS VARCHAR) AS value, o_orderkey AS k FROM orders
UNION ALL SELECT 'o_orderdate', CAST(o_orderdate AS VARCHAR), o_orderkey FROM orders
UNION ALL SELECT 'o_orderpriority', CAST(o_orderpriority AS VARCHAR), o_orderkey FROM orders"""


@register("f1_first_codes", f"""
WITH f AS (SELECT "column", value, min(k) AS first FROM ({ORDERS_CAT_SQL}) GROUP BY ALL),
nd AS (SELECT "column" FROM f GROUP BY 1 HAVING count(*) < 20)
SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column" ORDER BY first, value) - 1 AS INTEGER) AS code
FROM f JOIN nd USING ("column")""")
def f1_first_codes(spark, d):
    return FT.first_appearance_codes(table(spark, d, "orders"), "o_orderkey")


@register("f1_target_mapping", """
WITH f AS (SELECT CAST(c_mktsegment AS VARCHAR) AS value, min(c_custkey) AS first FROM customer GROUP BY 1)
SELECT 'c_mktsegment' AS "column", value,
       CAST(row_number() OVER (ORDER BY first, value) - 1 AS INTEGER) AS code FROM f""")
def f1_target_mapping(spark, d):
    return FT.first_appearance_codes(table(spark, d, "customer"), "c_custkey", ["c_mktsegment"],
                                     max_distinct=None)


@register("f2_label_codes", """
SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT CAST(c_mktsegment AS VARCHAR) AS value FROM customer)""")
def f2_label_codes(spark, d):
    return FT.label_codes(table(spark, d, "customer"), "c_mktsegment")


@register("f2_label_codes_wide", """
SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT CAST(l_comment AS VARCHAR) AS value FROM (SELECT o_orderkey || '/' || o_orderdate AS l_comment FROM orders))""")
def f2_label_codes_wide(spark, d):
    """Codes of a text column with a value per row."""
    o = table(spark, d, "orders").select(F.concat_ws("/", "o_orderkey", "o_orderdate").alias("label"))
    return FT.label_codes(o, "label")


CUSTOMER_TEXT_SQL = """(SELECT c_custkey, 0 AS pos, 'c_name' AS col, c_name AS v FROM customer WHERE c_name IS NOT NULL
 UNION ALL SELECT c_custkey, 1, 'c_mktsegment', c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)"""


@register("f3_text_dictionary", f"""
SELECT col AS "column", v AS value, row_number() OVER (ORDER BY pos, v) - 1 AS slot
FROM (SELECT DISTINCT pos, col, v FROM {CUSTOMER_TEXT_SQL})""")
def f3_text_dictionary(spark, d):
    return EN.dictionary(table(spark, d, "customer"), ["c_name", "c_mktsegment"])


@register("f3_one_hot", f"""
WITH t AS {CUSTOMER_TEXT_SQL},
s AS (SELECT pos, col, v, row_number() OVER (ORDER BY pos, v) + 1 AS slot FROM (SELECT DISTINCT pos, col, v FROM t))
SELECT c_custkey, 0 AS slot, 'c_nationkey' AS feature, c_nationkey::DOUBLE AS x FROM customer
UNION ALL SELECT c_custkey, 1, 'c_acctbal', c_acctbal::DOUBLE FROM customer
UNION ALL SELECT t.c_custkey, s.slot, s.col || '_' || s.v, 1.0::DOUBLE FROM t JOIN s ON s.pos = t.pos AND s.v = t.v""")
def f3_one_hot(spark, d):
    """All of ``customer`` as cells; no category becomes a column."""
    return EN.one_hot_cells(table(spark, d, "customer"), "c_custkey", ["c_name", "c_mktsegment"])


@register("f5_split", f"""
SELECT o_orderkey, CASE WHEN {split_key_sql('o_orderkey')} < 2000 THEN 'test' ELSE 'train' END AS split
FROM orders""")
def f5_split(spark, d):
    return FT.train_test_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2)


@register("f6_folds", """
SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders""")
def f6_folds(spark, d):
    return FT.kfold(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


@register("f6_fold_sizes", """
SELECT fold, count(*) AS n FROM (
  SELECT CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders) GROUP BY fold""")
def f6_fold_sizes(spark, d):
    f = FT.kfold(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


def _line_fit(spark, d):
    li = table(spark, d, "lineitem")
    fit = li.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"),
                 F.regr_intercept("l_extendedprice", "l_quantity").alias("a"))
    # one-row fit: a broadcast nested-loop join with one build row
    return li.crossJoin(F.broadcast(fit)).withColumn(
        "pred", F.col("a") + F.col("b") * F.col("l_quantity"))


LINE_FIT_SQL = """(SELECT l.*, f.a + f.b * l.l_quantity AS pred FROM lineitem l,
  (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
   FROM lineitem) f)"""


@register("e1_regression_metrics", f"""
SELECT count(*) AS n, {r('1 - sum(power(l_extendedprice - pred, 2)) / (var_pop(l_extendedprice) * count(*))')} AS r2_score,
       {r('avg(abs(l_extendedprice - pred))')} AS mean_absolute_error,
       {r('avg(power(l_extendedprice - pred, 2))')} AS mean_squared_error,
       {r('sqrt(avg(power(l_extendedprice - pred, 2)))')} AS root_mean_squared_error
FROM {LINE_FIT_SQL}""")
def e1_regression_metrics(spark, d):
    return rounded(E.regression_metrics(_line_fit(spark, d), "l_extendedprice", "pred"))


@register("e1_library_metrics", f"""
SELECT {r('avg(power(l_extendedprice - pred, 2))')} AS mse,
       {r('sqrt(avg(power(l_extendedprice - pred, 2)))')} AS rmse,
       {r('1 - sum(power(l_extendedprice - pred, 2)) / (var_pop(l_extendedprice) * count(*))')} AS r2
FROM {LINE_FIT_SQL}""")
def e1_library_metrics(spark, d):
    return rounded(E.regression_metrics_library(_line_fit(spark, d), "l_extendedprice", "pred"))


def _rule_pred(spark, d):
    return table(spark, d, "labels").withColumn("predicted", 1 - F.col("toxic"))


RULE_SQL = "(SELECT *, 1 - toxic AS predicted FROM labels)"


@register("e2_class_metrics", f"""
WITH cc AS (SELECT quality AS actual, predicted, count(*) AS count FROM {RULE_SQL} GROUP BY ALL),
lab AS (SELECT actual AS label FROM cc UNION SELECT predicted FROM cc),
per AS (SELECT l.label,
          coalesce((SELECT sum(count) FROM cc WHERE actual = l.label), 0) AS support,
          coalesce((SELECT sum(count) FROM cc WHERE predicted = l.label), 0) AS pred,
          coalesce((SELECT sum(count) FROM cc WHERE actual = l.label AND predicted = l.label), 0) AS tp
        FROM lab l),
pr AS (SELECT support, tp, CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END AS p,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM per)
SELECT {r('sum(tp) / sum(support)')} AS accuracy,
       {r('sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END * support) / sum(support)')} AS f1_score,
       {r('sum(p * support) / sum(support)')} AS precision,
       {r('sum(r * support) / sum(support)')} AS recall
FROM pr""")
def e2_class_metrics(spark, d):
    return rounded(E.classification_metrics(_rule_pred(spark, d), "quality", "predicted"))


@register("e6_prediction_sample", f"""
SELECT p_partkey, p_retailprice, {r('f.a + f.b * p_size')} AS pred FROM part,
  (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM part) f
ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 50""")
def e6_prediction_sample(spark, d):
    p = table(spark, d, "part")
    fit = p.agg(F.regr_slope("p_retailprice", "p_size").alias("b"),
                F.regr_intercept("p_retailprice", "p_size").alias("a"))
    pred = p.crossJoin(F.broadcast(fit)).select(
        "p_partkey", "p_retailprice", (F.col("a") + F.col("b") * F.col("p_size")).alias("pred"))
    return rounded(E.prediction_sample(pred, "p_partkey"))


@register("e7_codes_to_labels", """
WITH f AS (SELECT p_type AS value, min(p_partkey) AS first FROM part GROUP BY 1),
m AS (SELECT value, row_number() OVER (ORDER BY first, value) - 1 AS code FROM f),
pr AS (SELECT p_partkey, p_size / 10.0 AS pred FROM part)
SELECT p_partkey, coalesce(m.value, CAST(pr.pred AS VARCHAR)) AS label
FROM pr LEFT JOIN (SELECT * FROM m WHERE code < 4) m ON CAST(round_even(pr.pred, 0) AS BIGINT) = m.code""")
def e7_codes_to_labels(spark, d):
    p = table(spark, d, "part")
    mapping = FT.first_appearance_codes(p, "p_partkey", ["p_type"]).where(F.col("code") < 4)
    pred = p.select("p_partkey", (F.col("p_size") / 10.0).alias("pred"))
    return E.codes_to_labels(pred, "pred", mapping, "label").select("p_partkey", "label")


@register("e8_confusion_counts", f"""
SELECT quality AS actual, predicted, count(*) AS count FROM {RULE_SQL} GROUP BY ALL""")
def e8_confusion_counts(spark, d):
    return E.confusion_counts(_rule_pred(spark, d), "quality", "predicted")


@register("e8_confusion_matrix", f"""
SELECT quality AS actual, CAST(sum(CASE WHEN predicted = 0 THEN 1 ELSE 0 END) AS BIGINT) AS p_0,
       CAST(sum(CASE WHEN predicted = 1 THEN 1 ELSE 0 END) AS BIGINT) AS p_1 FROM {RULE_SQL} GROUP BY quality""")
def e8_confusion_matrix(spark, d):
    return E.confusion_matrix(_rule_pred(spark, d), "quality", "predicted")


@register("e9_pairs", f"""
SELECT doc_id, quality AS actual, predicted, quality = predicted AS match
FROM {RULE_SQL} ORDER BY doc_id LIMIT 20""")
def e9_pairs(spark, d):
    return E.pair_list(_rule_pred(spark, d), "quality", "predicted", "doc_id")


@register("e9_accuracy", f"""
SELECT round(avg(CASE WHEN quality = predicted THEN 1.0 ELSE 0.0 END) * 100, 1) AS accuracy_percent
FROM {RULE_SQL}""")
def e9_accuracy(spark, d):
    return E.accuracy_percent(_rule_pred(spark, d), "quality", "predicted")


@register("e10_model_comparison", f"""
WITH g AS (SELECT l_suppkey AS "group", count(*) AS n, regr_r2(l_extendedprice, l_quantity) AS value
           FROM lineitem GROUP BY 1)
SELECT "group", n, 'linear' AS model, 'r2' AS metric, {r('value')} AS value,
       row_number() OVER (ORDER BY value DESC NULLS LAST, "group") AS rank FROM g""")
def e10_model_comparison(spark, d):
    fits = E.group_fits(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", "l_quantity")
    m = fits.select("group", "n", F.lit("linear").alias("model"), F.lit("r2").alias("metric"),
                    F.col("r2").alias("value"))
    return rounded(E.rank_models(m))


@register("e10_primary_metric", f"""
WITH g AS (SELECT l_suppkey, max(l_shipdate) AS day, regr_r2(l_extendedprice, l_quantity) AS r2,
                  count_if(l_returnflag = 'N')::DOUBLE / count(*) AS share FROM lineitem GROUP BY 1)
SELECT row_number() OVER (ORDER BY day DESC, lpad(l_suppkey::VARCHAR, 8, '0')) AS rank,
       lpad(l_suppkey::VARCHAR, 8, '0') AS id,
       CASE WHEN l_suppkey % 2 = 0 THEN 'accuracy' ELSE 'r2_score' END AS metric,
       {r("CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_suppkey % 2 = 0 THEN share ELSE r2 END")} AS value,
       l_suppkey % 5 = 0 OR (l_suppkey % 2 = 1 AND r2 IS NULL) AS missing FROM g""")
def e10_primary_metric(spark, d):
    """One record per supplier: odd ones a fit (R²), even ones a classifier; a
    fifth of them kept no metrics."""
    li = table(spark, d, "lineitem")
    g = li.groupBy("l_suppkey").agg(
        F.max("l_shipdate").alias("day"), F.regr_r2("l_extendedprice", "l_quantity").alias("r2"),
        (F.count_if(F.col("l_returnflag") == "N") / F.count(F.lit(1))).alias("share"))
    kept = F.when(F.col("l_suppkey") % 5 == 0, F.create_map().cast("map<string,double>")).when(
        F.col("l_suppkey") % 2 == 0, F.create_map(F.lit("accuracy"), "share")).otherwise(
        F.create_map(F.lit("r2_score"), "r2"))
    records = g.select(F.lpad(F.col("l_suppkey").cast("string"), 8, "0").alias("id"), F.lit("m").alias("name"),
                       F.col("day").cast("string").alias("created_at"),
                       (F.col("l_suppkey") % 2 == 0).alias("is_categorical_target"), kept.alias("metrics"))
    out = E.compare_models(records)
    return rounded(out.select("rank", "id", "metric", "value",
                              (F.col("shown") == "N/A").alias("missing")))


@register("f7_assemble", """
SELECT p_partkey, CAST(p_size AS DOUBLE) AS f0, p_retailprice AS f1 FROM part""")
def f7_assemble(spark, d):
    from pyspark.ml.functions import vector_to_array
    v = FT.assemble(table(spark, d, "part"), ["p_size", "p_retailprice"])
    a = vector_to_array("features")
    return v.select("p_partkey", a[0].alias("f0"), a[1].alias("f1"))
