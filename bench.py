"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES``
a comma-separated choice. Each query runs once to warm up and is then timed on a second, complete
run, planning included, with every output row produced.
"""

from __future__ import annotations

import json
import os
import time

from tallyfold.plans import run
from tallyfold.session import local_session

HEADLINE = (
    "dau", "conversion_rate", "average_check", "ltv_top_partners", "ltv_top_items",
    "retention_daily", "retention_cohort", "one_time_vs_repeat", "activity_by_age_band",
    "duration_profile", "seasonality", "top_places", "skill_demand", "quantile_linear",
    "percentile_trim", "iqr_outliers", "histogram", "missing_stats", "dedup_keep_first",
    "impute_group_mean", "distinct_count", "group_sum", "contingency_table", "phik_matrix",
    "growing_segments", "return_rate",
)


def seconds(name, spark, sf_dir):
    start = time.perf_counter()
    run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        seconds(name, spark, sf_dir)
        times[name] = round(seconds(name, spark, sf_dir), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
