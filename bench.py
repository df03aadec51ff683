"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores. Each query
runs once to warm up; its time is the median of the following runs.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from gaugework.plans.reports import metric_report
from gaugework.plans.groups import ReportBuilder
from gaugework.operators import profile
from gaugework.queries import QUERIES, inputs
from gaugework.session import local_session

RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "profile_wide", "profile_long", "profile_zeros", "profile_nulls", "profile_approx", "multi_source",
    "correlation_long", "correlation_many", "describe", "histogram", "kde", "kde_wide", "markers", "box_stats",
    "filter_contains", "filter_range", "group_all_tagged", "group_summary", "group_limit",
    "scale_standard", "scale_robust", "outlier_zscore", "outlier_iforest", "kmeans", "select_k", "fit_predict",
    "dbscan", "pca_points", "wiki_lines",
]


def groups_one_by_one(spark, folder):
    """The five shipped groups as five results, to compare with the tagged scan."""
    profiles = profile.profile(inputs.user_metrics(spark, folder)).persist()
    results = metric_report(ReportBuilder(profiles)).build_all()
    tagged = None
    for name, df in results.items():
        tagged = df if tagged is None else tagged.unionByName(df)
    return tagged


def groups_tagged(spark, folder):
    profiles = profile.profile(inputs.user_metrics(spark, folder)).persist()
    return metric_report(ReportBuilder(profiles)).build_tagged()


def timed(spark, function, folder: str) -> float:
    begun = time.perf_counter()
    function(spark, folder).write.format("noop").mode("overwrite").save()
    spent = time.perf_counter() - begun
    spark.catalog.clearCache()
    return spent


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "gaugework-bench")
    todo = {name: QUERIES[name] for name in HEADLINE}
    todo["report_groups_tagged"] = groups_tagged
    todo["report_groups_one_by_one"] = groups_one_by_one
    found = {}
    for name, function in todo.items():
        timed(spark, function, folder)
        found[name] = round(statistics.median(timed(spark, function, folder) for _ in range(RUNS)), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "total_query_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": scale}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
