"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "bh_events",
    "bh_adjusted",
    "bh_threshold_by_type",
    "storey_pi0",
    "local_fdr",
    "lfdr_step_up",
    "running_mean_q",
    "rolling_by_rank",
    "roc_auc",
    "rank_p_values",
    "metrics_summary",
    "exact_quantiles",
    "empirical_null_density",
    "stratified_subsample",
    "k_folds",
    "kernel_row_sums",
    "median_length_scale",
    "kernel_by_pair_type",
    "pair_distances",
    "fit_three_steps",
    "predict_alpha",
    "fit_predict_reject",
    "cross_validation",
    "euclidean_cv_run",
    "graph_degrees",
    "graph_diffusion",
    "graph_alignment",
    "graph_smooth_fdr",
    "enrichment",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from hyposcape.queries import QUERIES

    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    QUERIES["bh_events"](spark, sf_dir).count()  # start the JVM's code paths before the clock runs
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
