"""Bench: headline queries of the catalog at ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]``.

Each query runs once to warm up, then ``$BENCH_RUNS`` (default 3) timed runs
(model fits: one); the median is reported. Results are fully computed through the ``noop`` sink
(no driver collect). Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tabscope import catalog  # noqa: E402
from tabscope.operators import insights  # noqa: E402
from tabscope.session import get_spark  # noqa: E402
from tabscope.sources.tables import load  # noqa: E402

HEADLINE = [
    "c1_numeric_profile", "c2_categorical_profile", "c3_filter_options", "c6_category_share",
    "b123_clean", "b7_search_summary", "s2_infer_types", "i1_correlation", "i4_outliers",
    "i5_outlier_examples", "i8_month_trend", "c10_overview_top_values", "f1_first_codes",
    "f6_folds", "e1_regression_metrics", "e2_class_metrics", "e10_model_comparison",
    "s8_recent_per_group",
]
# Model fits and cross-validation: one timed run each.
MODELS = ["m6_logistic_regression", "m9_train_route", "m12_cross_validation"]


def i1_wide(spark, sf_dir: str):
    """Correlations of 60 columns derived from ``lineitem`` (1,770 pairs)."""
    li = load(spark, sf_dir, "lineitem")
    base = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return insights.correlations(li.select(*[
        (F.col(base[k % 4]).cast("double") * (k + 1) + F.pmod(F.col("l_orderkey"), F.lit(k + 2))).alias(f"x{k}")
        for k in range(60)]))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_spark(app_name="tabscope-bench")
    qs = catalog.queries()
    times = {}
    qs["i1_wide"] = i1_wide
    for key in [*HEADLINE, "i1_wide", *MODELS]:
        fn = qs[key]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        samples = []
        for _ in range(1 if key in MODELS else runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[key] = round(statistics.median(samples), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_median_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None}))
    spark.stop()


if __name__ == "__main__":
    main()
