"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]

Every query runs to the end and its whole result goes to the noop sink. ``queries`` holds the second run of each, the
first one, which also compiles the generated code, is under ``cold``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tarmac.plans import QUERIES
from tarmac.session import build_session

HEADLINE = [
    "arrival_throughput_zero_filled",
    "throughput_floor15",
    "throughput_joined_back",
    "distinct_per_bucket",
    "floor7_dedup_first",
    "exact_duplicates_dropped",
    "runway_enrichment",
    "outer_as_union",
    "weather_bucket_join",
    "semi_relevant_forecasts",
    "asof_observation_6h",
    "forecast_asof_corrected",
    "block16_fill",
    "weather_on_targets",
    "parse_observation_text",
    "parse_forecast_lines",
    "cloud_bands",
    "cloud_severity",
    "lead_features",
    "supervised_windows",
    "minmax_by_station",
    "sample_quantiles",
    "flight_feature_table",
    "submission_in_order",
    "polygon_levels",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), app="tarmac-bench")
    cold, warm = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        cold[name] = round(run(spark, name, folder), 3)
        warm[name] = round(run(spark, name, folder), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
