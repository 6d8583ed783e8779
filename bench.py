"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracelight.plans import catalog  # noqa: E402
from tracelight.session import get_session  # noqa: E402

HEADLINE = (
    "a3_json_reject_reasons",
    "a7_content_addressed_objects",
    "d1_missing_profile",
    "d5_duplicates_and_identities",
    "d7_conflicting_label_sets",
    "d13_consolidated_primary_tactic",
    "d14_window_features",
    "e2_split_label_counts",
    "e4_training_sample",
    "b14_standard_scores",
    "d18_quantile_bounds",
    "f3_overall_metrics",
    "f10_drift_summary",
    "g10_bulyan",
    "g11_update_indicators",
    "g17_nearest_prototypes",
    "h2_batch_scoring",
    "i2_session_continuity",
    "i6_admission_decisions",
    "i11_completeness_counts",
    "i16_report_gate",
    "j1_lineage_resolution",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = catalog.load()
    queries["d20_class_and_split_counts"](spark, folder).collect()  # loads classes and Python workers
    seconds = {}
    for name in HEADLINE:
        catalog.forget()  # every query pays for the derived tables it reads
        begin = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
