"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import all_entries  # noqa: E402
from netweave.session import build_session  # noqa: E402

HEADLINE = [
    "packet_features",
    "buffer_epochs",
    "fixed_count_sequences",
    "robust_scaler_fit",
    "robust_scaler_transform",
    "sequence_familiarity",
    "assembled_sequences",
    "sliding_sequences",
    "flagged_sequences",
    "subspace_model_scores",
    "dynamic_threshold_flags",
    "train_validation_split",
    "early_stopping",
    "raw_reject_reasons",
    "stage_router",
    "collection_latest_per_id",
    "running_counters",
    "anomaly_page",
    "feedback_labels",
    "training_window_join",
    "port_scan_windows",
    "udp_flood_windows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries = all_entries()
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            entries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    packets = spark.read.parquet(f"{folder}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds_warm_median",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "packets_per_second": round(packets / seconds["flagged_sequences"]) if "flagged_sequences" in seconds else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
