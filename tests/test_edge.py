"""Edge cases on small literal frames."""

import math

from pyspark.sql import functions as F

from tabscope.operators import browse as B
from tabscope.operators import clean as C
from tabscope.operators import insights as I
from tabscope.operators import profile as P
from tabscope.plans import report as R
from tabscope.sources import csv as CSV


def test_all_null_row_dropped_and_fills(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (None, None, None), (3, None, float("nan"))],
                               "i int, s string, x double")
    out = C.clean(df).orderBy("s").collect()
    assert len(out) == 2
    assert {r["s"] for r in out} == {"a", "Unknown"}
    assert {r["x"] for r in out} == {1.0}  # NaN filled with the median of [1.0]


def test_single_row_std_is_null(spark):
    prof = P.numeric_profile(spark.createDataFrame([(4.0,)], "x double")).first()
    assert prof["std"] is None and prof["median"] == 4.0 and prof["unique_values"] == 1


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(10)], "c double, x double")
    r = I.correlations(df).first()
    assert r["r"] is None


def test_correlation_with_nulls_pairwise(spark):
    rows = [(1.0, 2.0, None), (2.0, 4.1, 1.0), (3.0, 6.2, 0.0), (4.0, None, 5.0), (5.0, 9.9, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["col1"], r["col2"]): r["r"] for r in I.correlations(df).collect()}
    import numpy as np
    ab = np.array([(a, b) for a, b, _ in rows if a is not None and b is not None])
    assert math.isclose(got[("a", "b")], np.corrcoef(ab.T)[0, 1], rel_tol=1e-9)


def test_mode_takes_smallest_tie(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (1.0,), (2.0,)], "x double")
    assert I.distribution(df).first()["mode"] == 1.0


def test_empty_filter_gives_empty_stats(spark):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    out = R.filter_profile(df, {"s": "zzz"})
    assert out["card"].first()["rows"] == 0
    assert out["numeric"].count() == out["categorical"].count() == out["options"].count() == 0


def test_eq_filter_missing_column_reads_empty(spark):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    assert B.eq_filter(df, {"nope": ""}).count() == 1
    assert B.eq_filter(df, {"nope": "x"}).count() == 0
    assert B.eq_filter(df, {"i": "1.0"}).count() == 1


def test_report_guard_under_five_rows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(4)], "k int, x double")
    out = R.insight_report(df, "k").collect()
    assert out[0]["section"] == "error"


def test_trend_needs_three_months(spark):
    df = spark.createDataFrame([("2024-01-05", 1.0), ("2024-02-05", 2.0)], "order_date string, x double")
    assert I.month_trends(I.monthly_means(df)).count() == 0


def test_significant_trend_detected(spark):
    rows = [(f"2024-{m:02d}-01", float(m) * 2 + (0.1 if m % 2 else 0.0)) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "sale_date string, amount double")
    t = I.significant_trends(I.month_trends(I.monthly_means(df))).first()
    assert t["direction"] == "increasing" and t["significance"] < 0.05


def test_infer_types_tokens(spark):
    df = spark.createDataFrame([("1", "1.5", "True", "x", "NA"), ("NA", "2", "false", "1", "")],
                               "a string, b string, c string, d string, e string")
    got = {r["column"]: r["type"] for r in CSV.infer_types(df).collect()}
    assert got == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "double"}


def test_validate_duplicate_header(spark, tmp_path):
    p = tmp_path / "dup.csv"
    p.write_text("a,a,b\n1,2,x\n")
    checks = CSV.validate_csv(spark, str(p))
    v = CSV.verdict(checks).first()
    assert not v["valid"] and "duplicate" in v["message"]


def test_validate_missing_file(spark, tmp_path):
    v = CSV.verdict(CSV.validate_csv(spark, str(tmp_path / "none.csv"))).first()
    assert v["message"] == "File not found."


def test_csv_quoted_multiline(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('name,n\n"Smith, ""J""",1\n"two\nlines",2\n')
    df = CSV.load_csv(spark, str(p), multi_line=True)
    assert dict(df.dtypes)["n"] == "bigint"
    assert sorted(r["name"] for r in df.collect()) == ['Smith, "J"', "two\nlines"]


def test_awkward_names(spark):
    df = spark.createDataFrame([(1.0, "x"), (3.0, "y")], "`7. Usage frequency` double, `Improves learning?` string")
    prof = P.numeric_profile(df).first()
    assert prof["column"] == "7. Usage frequency" and prof["median"] == 2.0
    assert P.value_counts(df).count() == 2
    assert B.search(df, "Y").count() == 1
    assert P.multi_select_counts(spark.createDataFrame([("a, b",), ("b",)], "t string"), "t") \
        .where(F.col("option") == "b").first()["count"] == 2
