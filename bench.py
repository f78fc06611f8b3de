"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from weftgraph.catalogue import QUERIES

HEADLINE = [
    "bfs_module_depth",
    "module_edges",
    "edge_provenance",
    "ignored_closure",
    "contract_edges",
    "reachability",
    "transitive_module_edges",
    "longest_path_rank",
    "module_state_counts",
    "merge_spans",
    "access_backfill",
    "argusage_removable",
    "subterm_hashes",
    "csr_targets",
    "search_bigrams",
    "validate_graph",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="weftgraph-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{folder}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    try:
        QUERIES["bfs_module_depth"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles code first
        took = {}
        for name in HEADLINE:
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    finally:
        spark.stop()
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "total wall clock of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
