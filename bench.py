"""Times the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the list below).
"""

from __future__ import annotations

import json
import os
import platform
import time

import pyspark

from strandwork.plans.queries import QUERIES
from strandwork.sources.session import local_session

HEADLINE = [
    "join_length_exclusive",
    "class_ratio",
    "balanced_down",
    "balanced_up",
    "bin_undersample",
    "shuffled_positions",
    "group_split",
    "standardized",
    "kgrams",
    "minhash_signatures",
    "lsh_pairs",
    "dedup_clusters",
    "dedup_rows",
    "encoded_tokens",
    "encoded_words",
    "classification_metrics",
    "regression_metrics",
    "spearman",
    "error_profile",
    "overlap_probability",
    "density_grid",
    "joint_bins",
    "metric_pivot",
    "batch_score",
    "classifier_data",
    "regressor_data",
    "prediction_report",
    "train_classifier",
    "train_regressor",
    "history_log",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cpus)
    spark.read.parquet(f"{folder}/region.parquet").count()  # start-up is not part of any query
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
                "config": {"cpus": cpus, "spark": pyspark.__version__, "python": platform.python_version()},
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
