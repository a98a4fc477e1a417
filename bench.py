"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores;
BENCH_QUERIES=all times every registered query.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "rolling_mean_calendar",
    "rolling_mad_calendar",
    "anomaly_feature_matrix",
    "hrv_feature_matrix",
    "rolling_baseline",
    "vri",
    "data_quality",
    "gap_sessionize",
    "session_metrics",
    "point_in_interval_join",
    "pick_best_source",
    "daily_rollup",
    "minute_resample_mean",
    "cosinor",
    "npar",
    "nocturnal_dip",
    "sri",
    "chs",
    "condition_forecast",
    "weekly_insight",
    "cusum",
    "median_mad",
    "isolation_forest_score",
    "divergence_detect",
]


def main() -> None:
    from kymo import build_session, catalog

    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "kymo-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.checkpoint.dir": os.environ.get("BENCH_SHARED", "/tmp/kymo-bench"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    names = list(queries) if os.environ.get("BENCH_QUERIES") == "all" else [n for n in HEADLINE if n in queries]
    spark.read.parquet(f"{data}/events.parquet").count()  # start-up is not timed
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        queries[name](spark, data).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": data.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    with contextlib.suppress(BrokenPipeError):
        main()
