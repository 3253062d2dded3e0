"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries": {key: sec}, "sf"}.
Each query is fully materialised (Spark's no-op sink), so every row is computed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans.catalog import QUERIES  # noqa: E402
from tessera.session import build_session  # noqa: E402

HEADLINE = (
    "calibrate_rewrite_i",
    "calibrate_rewrite_both",
    "calibrate_with_rules",
    "decode_rewrite_both",
    "entity_f5_by_type",
    "detect_rules",
    "piece_labels",
    "ensemble_scores",
    "prepare_training_set",
    "kfold_split",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    keys = [k for k in (sys.argv[1:] or HEADLINE)]
    spark = build_session(f"local[{cpus}]", app="tessera-bench", shuffle_partitions=max(8, 2 * cpus))
    times: dict[str, float] = {}
    for k in keys:
        t0 = time.time()
        QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
        print(f"{k}: {times[k]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
