"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query runs to the end over all its rows and columns into a sink that discards them.
"""

from __future__ import annotations

import json
import os
import time

from claimlens.plans.catalog import QUERIES
from claimlens.session import build_session

HEADLINE = [
    "rank_adjusters_by_country",
    "clean_portfolio",
    "risk_features",
    "deduplicated_claims",
    "median_imputation",
    "repeat_claims",
    "payout_deciles",
    "decile_summary",
    "running_damage",
    "first_suspect_claims",
    "ratio_by_tier",
    "contractor_concentration",
    "adjuster_tracker",
    "contractor_tracker",
    "pareto_managers",
    "premium_deviation",
    "spike_trend",
    "payout_by_property_type",
    "payout_statistics",
    "portfolio_figures",
    "policy_review",
    "reporting_mart",
    "claim_paths",
    "walked_paths",
    "welch_test",
    "benford_test",
    "pearson_correlation",
    "spearman_correlation",
    "anomaly_scores",
    "column_profile",
    "null_counts",
    "insight_document",
    "streamed_review",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # The files are small: smaller splits, as far as their row groups allow, occupy the cores.
    settings = {"spark.sql.files.maxPartitionBytes": "2m", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"}
    spark = build_session("claimlens-bench", f"local[{cpus}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    # One run outside the clock starts the JVM's and the Python workers' machinery.
    QUERIES["portfolio_figures"](spark, folder).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
