"""Plan shape: pushdown, no Python in SQL hot paths, bounded windows."""

from tabscope.catalog import queries

from .conftest import SF01


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_isin_filter_pushed_to_scan(spark):
    p = plan(queries()["b5_isin_filter"](spark, SF01))
    assert "PushedFilters: [In(o_orderstatus" in p or "In(o_orderstatus" in p


def test_projection_pruned(spark):
    df = queries()["c8_multi_select_counts"](spark, SF01)
    s = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_name:string>" in s


def test_no_python_udf_in_sql_ops(spark):
    for k in ["c2_categorical_profile", "c6_category_share", "i4_outliers", "i5_outlier_examples",
              "i8_month_trend", "f5_split", "e2_class_metrics", "s2_infer_types"]:
        p = plan(queries()[k](spark, SF01))
        assert "EvalPython" not in p and "PythonUDF" not in p, k


def test_top_k_per_group_is_partial(spark):
    df = queries()["s8_recent_per_group"](spark, SF01)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p


def test_global_top_k_is_take_ordered(spark):
    p = plan(queries()["s8_recent_top5"](spark, SF01))
    assert "TakeOrderedAndProject" in p
