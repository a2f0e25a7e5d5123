"""Time the headline queries and print one JSON line.

Input folder from ``BENCH_SF_DIR``, cores from ``BENCH_CPUS``. Each query runs once after a
short warm-up, and its result is counted without being collected. Joining and storing the fact,
which the queries then read, is timed by itself as ``build_fact``; no query finds a fitted model.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from orderlens.plans import registry
from orderlens.session import build_session
from orderlens.sources.star import stored_fact

HEADLINE = (
    "q01_totals q02_top_products q03_region_revenue q04_segment_sales q05_shipping_mode_mix"
    " q06_avg_shipping_duration q07_pct_late q08_region_late_rate q09_high_sales_late_products"
    " q10_mom_growth q11_top3_per_category q12_cumulative_revenue kpi_summary kpi_summary_alt"
    " bi_measures_by_dim supplier_scorecard_ranked inventory_profile stockout_risk_flag dq_duplicate_rows"
    " flag_iqr_outliers clean_run eda_days_boxplot eda_discount_histogram stats_describe stats_correlation"
    " stats_anova stats_chi_square stats_mean_ci ts_weekly_demand ts_holt_winters ml_metrics ml_roc_curve"
    " ml_decision_tree ml_random_forest ml_gradient_boosting quality_log ts_actual_vs_forecast ts_best_model"
    " ts_refit_forward ml_stratified_split bi_measures_cube clean_dedupe"
    " product_performance region_kpis"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "orderlens-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = registry.queries()
    run["q08_region_late_rate"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    registry.forget()
    seconds = {}
    started = time.perf_counter()
    stored_fact(spark, sf_dir)
    seconds["build_fact"] = round(time.perf_counter() - started, 3)
    for name in HEADLINE:
        registry.forget(fact=False)
        started = time.perf_counter()
        run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
