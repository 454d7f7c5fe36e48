"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]
and print one JSON line.  Each query is forced to completion through the
``noop`` sink (full execution, nothing collected)."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "f00_all_features_lineitem",     # 32 features over the volume table
    "m07_quality_report_lineitem",   # full scoring chain + per-class report
    "m07_quality_report",            # flagship on events
    "e12_final_prediction",
    "c11_text_report",
    "p03_validate_all",
    "a01_quality_distribution",
    "a03_describe",
    "a07_hist_by_quality",
    "a06_corr_matrix",
    "j05_agency_compliance",
    "m01_stratified_split",
    "m05_preprocess",
    "m12_temperature_nll",
    "a15_classification_report",
    "t02_stream_window_report",
    "t04_stream_sessions",
    "m09_smote_resample",
    "m06_train_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    from limnos.plans import QUERIES, load_all
    from limnos.session import local_session

    spark = local_session(cpus=cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16,
                          app="limnos-bench")
    load_all()
    # warm-up: JIT / codegen caches on a tiny query
    QUERIES["a10_distinct_classes"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
