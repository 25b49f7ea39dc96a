"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/path BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tabwarden.plans import QUERIES, Tables  # noqa: E402
from tabwarden.session import local_session  # noqa: E402

HEADLINE = (
    "val_13_findings",
    "val_14_findings_cap",
    "val_15_validation_summary",
    "val_12_unique_texts",
    "val_lines",
    "cmp_05_diff_classify",
    "cmp_12_diff_summary",
    "cmp_14_cell_changes",
    "cmp_lines",
    "src_01_read_export_plain",
    "evd_04_evidence_budget",
    "ing_07_canonical_events",
    "ing_14_event_transitions",
    "run_06_retry_audit",
    "que_03_effective_lease",
    "que_12_job_state_fold",
    "ver_02_table_drift",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or [name for name in HEADLINE if name in QUERIES]
    spark = local_session(cpus)
    # Start the engine before the clock runs.
    spark.read.parquet(f"{folder}/region.parquet").groupBy("r_name").count().collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name].run(Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "total seconds of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(folder).name.removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
