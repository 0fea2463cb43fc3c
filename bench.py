"""Benchmark the headline queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] (default 8): one untimed warm-up, then $BENCH_RUNS timed
runs (default 3) whose median is reported. A run executes the full plan into
Spark's no-op sink (nothing is collected to the driver); caches are cleared
between runs. Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "llm_difficulty", "pairwise_corr", "order_random", "order_interleaved", "knn_graph",
    "accuracy_by_category", "weight_distribution", "calibration", "eval_metrics", "all_orderings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")

    from quizspark.operators.position import release_positions
    from quizspark.plans.catalog import QUERIES
    from quizspark.session import checkpoint_dir, get_session

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus))
    checkpoint_dir(spark)

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        dt = time.perf_counter() - t0
        release_positions()
        spark.catalog.clearCache()
        return dt

    out = {}
    for name in names:
        run(name)  # warm-up: JVM JIT, parquet footers, Python workers
        out[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus, "runs": runs, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
