"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query after one warm-up (default 2)
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

HEADLINE = [
    "relu", "axpy", "average", "smallest_odd", "sum_of_pair_minima", "pixel_counts", "first_letter_counts",
    "prefix_sum", "partial_minimums", "maximum_subarray", "closest_to_pi", "contains", "kth_smallest", "sorted_ranks",
    "sort_ignoring_zeros", "gemm", "gemv", "spmm", "spmv", "solve", "lu_factors", "edge_filter", "jacobi_2d", "jacobi_1d",
    "convex_hull", "closest_pair", "smallest_triangle", "component_count", "hop_distance", "fft", "fft_of_all_events",
    "metric_table", "scaling_mpi", "flatten_runs", "clean_completions", "model_usage", "streamed_marks",
]


def main() -> None:
    from gridloom.catalog import QUERIES
    from gridloom.runtime import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "gridloom-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        samples = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt:
                samples.append(time.perf_counter() - start)
        times[name] = round(sum(samples) / len(samples), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    scale = pathlib.Path(folder).name.removeprefix("sf")
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale, "cpus": int(cpus), "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
