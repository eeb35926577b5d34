"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query runs
to a no-op sink, after one small warm-up query that starts the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortspark.plans.catalog import QUERIES  # noqa: E402
from cohortspark.session import build_session  # noqa: E402

# Fits of small models and repeats of a timed plan with other arguments are left out.
HEADLINE = [
    "panel_lookback_pivot",
    "panel_impute_median",
    "panel_scale_standard",
    "min_tests_filter",
    "percentile_flags",
    "flag_metrics",
    "describe_by_item",
    "outliers",
    "value_histogram",
    "drop_outliers_iqr",
    "cohort_labels_all",
    "cohort_counts",
    "cohort_demographics",
    "availability",
    "missingness_long",
    "anchor_window",
    "timeline_hist",
    "time_features",
    "star_join",
    "dataset_assembly",
    "split_random",
    "split_temporal",
    "split_stratified",
    "kfold_assign",
    "roc_table",
    "feature_auc",
    "youden_cut",
    "youden_cv",
    "pr_area",
    "confusion_metrics",
    "method_compare",
    "linear_attribution",
    "rank_agreement",
    "mutual_information",
    "logit_rule_literature",
    "tree_attribution_forest",
    "sampled_attribution",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["value_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
