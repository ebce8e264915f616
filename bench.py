"""Benchmark of the headline catalogue queries.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line. Each query is executed in
full (``noop`` sink, nothing collected). The packed fixture archives are
prepared before timing (they stand in for the drives being scanned); the
catalogue build, the scan itself, extraction and all catalogue queries are
timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    # scan + register (listing, central directories, Parquet catalogue)
    "scan_job",
    # catalogue queries
    "search_combined", "search_like", "search_regex", "search_size_range", "topk_largest",
    "list_entries_limit", "lookup_by_name", "entries_by_uuid", "pick_nth", "pick_all",
    "summary", "archive_info", "list_archives_counts", "drive_rollup",
    "dup_by_hash", "merge_catalogs", "categories", "archive_stats",
    # real archives
    "scan_entries", "register", "extract_run", "extract_all", "dup_by_content", "search_text",
    "integrity_check", "stream_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from zipledger.session import get_session
    spark = get_session(f"local[{cpus}]", app="zipledger-bench", shuffle_partitions=int(cpus) * 2)
    from zipledger.plans.queries import REGISTRY
    from zipledger.sources.packer import pack_documents

    from zipledger.sources.derived import stored_derived_catalog

    pack_documents(spark, sf_dir)  # fixture preparation, not timed
    # untimed one-time start-up of the JVM code paths and the Python workers
    spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("lang").count().collect()
    spark.range(0, 64, 1, int(cpus)).mapInPandas(lambda it: it, "id long").count()
    timings: dict[str, float] = {}
    # building the catalogue derived from `documents` (read texts, register Parquet)
    t0 = time.perf_counter()
    stored_derived_catalog(spark, sf_dir, rebuild=True)
    timings["build_catalog"] = round(time.perf_counter() - t0, 3)
    for name in HEADLINE:
        if name not in REGISTRY:
            continue
        t0 = time.perf_counter()
        df = REGISTRY[name].run(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(timings.values()), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec",
                      "queries": timings, "sf": sf}))


if __name__ == "__main__":
    main()
