"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES comma-separated names (default: the list below)
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

from contract.queries import REGISTRY
from skein.session import local_session

HEADLINE = [
    "scan_profile",
    "class_distribution",
    "encode_c2",
    "stratified_split",
    "cv_folds",
    "scale_manifold",
    "distinct_by_class",
    "zscore_detect",
    "detection_summary",
    "distance_describe",
    "distance_histogram",
    "classification_report",
    "auc_per_class",
    "auc_multiclass",
    "roc_points",
    "order_neighborhood",
    "knn_join",
    "bar_features",
    "order_bars",
    "baseline_summary",
    "w2_distance",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session("bench", cpus, spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-"))
    spark.range(1000).mapInPandas(lambda it: it, "id long").count()
    seconds = {}
    for name in names:
        start = time.time()
        # Every row and column is computed; nothing is written or brought to the driver.
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }
    print(json.dumps(out))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
